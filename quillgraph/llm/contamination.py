"""Test passages inside training texts: suffix arrays of the texts, searched for every test suffix.

Each task turns its share of the texts into shards of bounded size. Of a shard it builds
the suffix array over words once (ranks of a few words first, then of ranks, until the
order holds for at least ``min_run`` words) and looks up by binary search what every suffix
of every test passage begins with, equal beginnings once. The runs found are united to the
share of each passage that a text holds; of the pairs that hold enough, the longest
verbatim match is found by bisection over its length. Texts are never split, so nothing is
shuffled and the texts are read once, whatever the number of items, up to ``PASS_WORDS``
words of passages; more are searched in several passes, so that what is broadcast is bounded.

Texts are compared apart from letter case, punctuation, markup, invisible characters,
entities, and words parted by a hyphen at a line end (joined where the joined word occurs
in a passage, else taken as two).

Defined results: null or empty texts and passages, and passages of fewer than ``min_run``
words, match nothing; equal texts are reported under each of their ids; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import mix64, word_hashes

SHARD_WORDS = 1_000_000
#: Words of passages that are broadcast at once (four bytes each, and every distinct word once).
PASS_WORDS = 20_000_000
#: Places of runs in passages, and of passages in texts, that a task looks at in one go.
SLAB = 1 << 21

_INLINE = re.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[\[[^\]|\n]*\|")
_MARK = re.compile(r"[*`~\\]+")
_LEAD = re.compile(r"^[ \t>]*(?:(?:[-+*]|\d{1,3}[.)])[ \t]+)?(?:\[[ xX]\][ \t]+)?", re.M)
_PARTED = re.compile(r"([^\W_]+)[-‐‑][ \t]*\r?\n[ \t>]*([^\W_]+)")


def plain(text: str | None, known: set[str] | None = None) -> str:
    """The text without what comparison passes over, lower-cased; ``known``: words that parted halves may form."""
    t = text or ""
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if not t.isascii():
        t = unicodedata.normalize("NFC", _UNSEEN.sub("", t))
    t = t.lower()
    if "](" in t or "[[" in t:
        t = _LINK.sub("", t)
    t = _MARK.sub("", _LEAD.sub("", t))
    if known is not None and _PARTED.search(t):
        t = _PARTED.sub(lambda m: m[1] + m[2] if m[1] + m[2] in known else f"{m[1]} {m[2]}", t)
    return t


class Passages:
    """Passages as word numbers, end to end, and the runs that their suffixes begin with."""

    def __init__(self, ids: list[int], hashes: np.ndarray, count: np.ndarray, known: set[str], min_run: int):
        self.ids, self.count, self.known, self.min_run = np.array(ids, np.int64), count, known, min_run
        self.vocabulary = np.unique(hashes)
        self.words = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        self.begin = np.cumsum(count) - count

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; 0 for a word that no passage has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == hashes, k + 1, 0)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``runs, run, item, place``: distinct runs of some whole passages, and where each stands, sorted by item and place."""
        first = 0
        while first < len(self.ids):
            total = np.cumsum(self.count[first:])
            last = first + max(1, int(np.searchsorted(total, SLAB, "right")))
            per = np.maximum(self.count[first:last] - self.min_run + 1, 0)
            item = np.repeat(np.arange(first, last), per)
            place = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
            if len(item):
                every = self.words[(self.begin[item] + place)[:, None] + np.arange(self.min_run)].astype(np.int64)
                runs, run = np.unique(every, axis=0, return_inverse=True)
                yield runs, run.ravel(), item, place
            first = last


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` (non-negative numbers), ordered by at least the ``depth`` words that begin there.

    Positions whose first word is 0 are left out; the end sorts before every word.
    """
    n = len(words)
    starts = np.flatnonzero(words)
    bits = max(1, int(words.max(initial=0)).bit_length())
    per = max(1, min(depth, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(per):
        key <<= bits
        key[: n - k] |= words[k:]
    order = starts[np.argsort(key[starts], kind="stable")]
    reach = per
    while reach < depth and len(order):
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        rank = np.zeros(n + reach, np.int64)
        rank[order] = np.cumsum(new)
        key = rank[:n] << 31 | rank[reach : n + reach]
        order = starts[np.argsort(key[starts], kind="stable")]
        reach *= 2
    return order


def search(words: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted`` the range of ``order`` whose suffixes begin with it."""
    run = wanted.shape[1]
    padded = np.concatenate([words, np.zeros(run, np.int64)])

    def bound(after_equal: bool) -> np.ndarray:
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            less, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
            for k in range(run):
                have = padded[at + k]
                less |= equal & (have < wanted[:, k])
                equal &= have == wanted[:, k]
            right = (less | (equal if after_equal else False)) & (lo < hi)
            lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
        return lo

    return bound(False), bound(True)


def longest_match(text: np.ndarray, passage: np.ndarray, least: int) -> tuple[int, int]:
    """``length, place``: the longest run of ``passage`` in ``text`` and where it first stands; one of ``least`` words is known to."""
    up = np.cumprod(np.append(np.uint64(1), np.full(len(text) + len(passage), 0x100000001B3, np.uint64)), dtype=np.uint64)
    down = np.cumprod(np.append(np.uint64(1), np.full(len(text) + len(passage), pow(0x100000001B3, -1, 1 << 64), np.uint64)), dtype=np.uint64)

    def sums(x: np.ndarray) -> np.ndarray:
        return np.append(np.uint64(0), np.cumsum(mix64(x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64))

    in_text, in_passage = sums(text), sums(passage)

    def found(n: int) -> int:
        """The first place of a run of n words of the passage, or -1."""
        windows = [(c[n:] - c[:-n]) * down[: len(c) - n] for c in (in_text, in_passage)]
        for at in np.flatnonzero(np.isin(windows[0], windows[1])):
            for k in np.flatnonzero(windows[1] == windows[0][at]):
                if np.array_equal(text[at : at + n], passage[k : k + n]):
                    return int(at)
        return -1

    low, high, place = least, min(len(text), len(passage)), found(least)
    while low < high:
        mid = (low + high + 1) // 2
        at = found(mid)
        if at < 0:
            high = mid - 1
        else:
            low, place = mid, at
    return low, place


def _shard(docs: list[int], texts: list[str], tests: Passages, share: float) -> Iterator[list[np.ndarray]]:
    """``doc, item, words, covered, longest, at`` of the pairs that share enough, in blocks."""
    run_words = tests.min_run
    hashes, owner, _ = word_hashes(texts)
    words = tests.numbers(hashes)
    # one 0 between texts, so that no run goes from one into the next
    spread = np.arange(len(words)) + owner
    line = np.zeros(len(words) + len(texts), np.int64)
    line[spread] = words
    of = np.zeros(len(line), np.int64)
    of[spread] = owner
    size = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(size) - size
    order = suffix_array(line, run_words)
    if not len(order):
        return
    for runs, run, item, place in tests.blocks():
        lo, hi = search(line, order, runs)
        n = hi - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        # each run once per text that has it
        spot = order[np.repeat(lo[hit], n[hit]) + np.arange(n.sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])]
        held = np.unique(np.repeat(hit, n[hit]) * len(texts) + of[spot])
        in_run, in_doc = held // len(texts), held % len(texts)
        per = np.bincount(in_run, minlength=len(runs))
        start = np.cumsum(per) - per
        live = per[run] > 0
        run_, item_, place_ = run[live], item[live], place[live]
        upto = np.cumsum(per[run_])
        at = 0
        while at < len(run_):
            # whole items, about SLAB rows in one go
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLAB, "right")))
            edge = int(np.searchsorted(item_, item_[stop - 1], "left"))
            stop = edge if edge > at else int(np.searchsorted(item_, item_[at], "right"))
            k = per[run_[at:stop]]
            row = np.repeat(np.arange(at, stop), k)
            doc = in_doc[start[run_[row]] + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            seq = np.lexsort((place_[row], doc, item_[row]))
            d, i, p = doc[seq], item_[row][seq], place_[row][seq]
            new = np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]))
            # a run covers its words up to where the next one of the pair begins
            wide = np.append(np.where(new[1:], run_words, np.minimum(p[1:] - p[:-1], run_words)), run_words)
            head = np.flatnonzero(new)
            covered = np.add.reduceat(wide, head)
            d, i = d[head], i[head]
            enough = covered >= share * tests.count[i] - 1e-9
            d, i, covered = d[enough], i[enough], covered[enough]
            best = [longest_match(words[begin[x] : begin[x] + size[x]], tests.words[tests.begin[y] : tests.begin[y] + tests.count[y]], run_words) for x, y in zip(d, i)]
            yield [np.asarray(docs)[d], tests.ids[i], tests.count[i], covered, np.array([b[0] for b in best], np.int64), np.array([b[1] for b in best], np.int64)]
            at = stop


SCHEMA = "doc_id long, item_id long, words int, covered int, longest int, at_word int"


def _passes(items: DataFrame, min_run: int) -> Iterator[Passages]:
    """The items as word hashes, made by the tasks, in lots of about ``PASS_WORDS`` words."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [plain(p) for p in b.column("passage").to_pylist()]
            hashes, owner, _ = word_hashes(texts)
            ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
            raws = [x.tobytes() for x in np.split(hashes, ends[:-1])] if texts else []
            yield pa.record_batch([b.column("item_id").cast(pa.int64()), pa.array(raws, pa.binary()), pa.array([sorted(set(re.findall(r"[^\W_]+", t))) for t in texts], pa.list_(pa.string()))], ["item_id", "words", "known"])

    rows = items.filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").distinct().mapInArrow(prepare, "item_id long, words binary, known array<string>").orderBy("item_id").toLocalIterator()
    ids, parts, known, total = [], [], set(), 0
    for r in rows:
        words = np.frombuffer(r["words"], np.uint64)
        if len(words) < min_run:
            continue
        ids.append(r["item_id"])
        parts.append(words)
        known.update(r["known"])
        total += len(words)
        if total >= PASS_WORDS:
            yield Passages(ids, np.concatenate(parts), np.array([len(p) for p in parts]), known, min_run)
            ids, parts, known, total = [], [], set(), 0
    if ids:
        yield Passages(ids, np.concatenate(parts), np.array([len(p) for p in parts]), known, min_run)


def leaked(documents: DataFrame, items: DataFrame, min_run: int = 8, share: float = 0.3) -> DataFrame:
    """Every document and item whose shared runs of ``min_run`` words or more cover at least ``share`` of the passage.

    ``words``: of the passage; ``covered``: how many of them lie in shared runs;
    ``longest`` and ``at_word``: the longest verbatim match and where it begins in the document.
    """
    spark = documents.sparkSession
    out = spark.createDataFrame([], SCHEMA)

    def scan(tests: Passages) -> DataFrame:
        held = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = held.value
            docs: list[int] = []
            texts: list[str] = []
            chars = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for found in _shard(docs, texts, passages, share) if docs else ():
                    yield pa.record_batch([pa.array(c.astype(t)) for c, t in zip(found, [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32])], ["doc_id", "item_id", "words", "covered", "longest", "at_word"])

            for b in batches:
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    if d is None or not t:
                        continue
                    docs.append(d)
                    texts.append(plain(t, passages.known))
                    chars += len(texts[-1])
                    if chars > SHARD_WORDS * 6:
                        yield from flush()
                        docs, texts, chars = [], [], 0
            yield from flush()

        return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)

    for tests in _passes(items, min_run):
        out = out.unionByName(scan(tests))
    return out.distinct()


def without_leaks(documents: DataFrame, items: DataFrame, min_run: int = 8, share: float = 0.3) -> DataFrame:
    """The documents that contain no test passage."""
    return documents.join(leaked(documents, items, min_run, share).select("doc_id").distinct(), "doc_id", "left_anti")
