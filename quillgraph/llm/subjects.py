"""Subjects of documents: averaged word and subword embeddings with independent logistic outputs.

Training uses a bounded sample of labelled documents (``MAX_DOCS``, by a hash of the id).
Their word statistics are cut into ``PARTS`` partitions; in every step each partition
computes the gradient over its own examples, the gradients are summed, and the one set of
parameters moves on. Labels are of whole documents while the question is about sentences,
so after fitting documents the model is fitted to sentences, whose targets are the
sentence scores of the model before it, ``ROUNDS`` times.

Scoring reads every document whole. A word's contribution to each output is computed once
per distinct word; a sentence scores the mean over its words; a document has a subject if
at least ``share`` of its sentences score above ``bar``.

Sentences end at sentence marks, blank lines and list items; headings, tag lines and front
matter are none. Words of digits carry nothing.

Defined results: null and empty texts have no sentences and no subjects; without any
labelled document nothing has a subject; repeated documents give the same rows once;
labels of unknown subjects or documents are ignored; other columns are not looked at.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import LOT, code_points, hash_runs, letter_table
from quillgraph.session import stored

MAX_DOCS = 4_000
MAX_SUBJECTS = 1_000
PARTS = 4
DIM = 16
BUCKETS = 1 << 16
STEPS = 30
ROUNDS = 2
RATE = 0.1
BAR = 0.4
FIRST_BAR = 2.0
#: A sentence is an example of every subject that scores within this of its best.
MARGIN = 1.0

_FRONT = re.compile(r"\A---\n.*?\n---(?:\n|\Z)", re.S)
_SPLIT = re.compile(r"(?<=[.!?])[\"')*_]*\s+(?=[\"'(*_“]*[\w¿¡])|\n\s*\n|\n(?=\s*(?:[-*+>#|]|\d+\.\s))")
_NONE = re.compile(r"\s*(?:#{1,6}\s|(?:#[\w-]+\s*)+\Z|\Z|-{3,}\Z|```)")


def sentences(text: str | None) -> list[str]:
    t = _FRONT.sub("", (text or "").replace("\r", ""))
    return [s for s in _SPLIT.split(t) if not _NONE.match(s)]


def _unit_hash(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


@lru_cache(maxsize=200_000)
def units(word: str) -> tuple[int, ...]:
    """Buckets of a word and its runs of four and five letters, ends marked; none for digits."""
    if word[0].isdigit():
        return ()
    x = f"<{word}>"
    return tuple(_unit_hash(u) for u in [word, *(x[i : i + n] for n in (4, 5) for i in range(len(x) - n + 1))])


def lots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], int]]:
    """``word_number, sentence, new words, sentences``: words of sentences, numbered within each lot."""
    begin, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t) + 1
        if chars >= LOT or k == len(texts) - 1:
            codes, begins = code_points([x.lower() for x in texts[begin : k + 1]])
            hashes, owner, start = hash_runs(codes, begins)
            _, at, number = np.unique(hashes, return_index=True, return_inverse=True)
            outside = np.flatnonzero(~letter_table()[codes])
            ends = outside[np.searchsorted(outside, start[at])]  # a line end follows every text
            words = [codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start[at], ends)]
            yield number, owner, words, k + 1 - begin
            begin, chars = k + 1, 0


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _opened(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return dict(z)


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by owner (non-decreasing)."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(owner):
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[at]] = np.add.reduceat(values, at, axis=0)
    return out


def _features(texts: list[str | None], marks: np.ndarray) -> bytes:
    """Statistics of some labelled documents: words of sentences, sentences of documents, units of words."""
    lists = [sentences(t) for t in texts]
    flat = [s for x in lists for s in x]
    doc_of = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    index: dict[str, int] = {}
    numbers, owners, done = [], [], 0
    for number, owner, words, n in lots(flat):
        own = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        numbers.append(own[number])
        owners.append(owner + done)
        done += n
    word = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    sent = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    per = [units(w) for w in index]
    live = np.array([bool(u) for u in per], bool)
    keep = live[word] if len(word) else np.zeros(0, bool)
    return _packed(
        word=word[keep],
        sent=sent[keep],
        doc=doc_of,
        marks=marks,
        unit=np.array([u for us in per for u in us], np.int64),
        unit_word=np.repeat(np.arange(len(per)), [len(u) for u in per]),
        words=np.array(len(per)),
        by_word=np.argsort(word[keep], kind="stable").astype(np.int32),
        by_unit=np.argsort([u for us in per for u in us], kind="stable").astype(np.int32),
        targets=np.zeros((0, 0), np.float32),
    )


def _forward(f: dict[str, np.ndarray], table: np.ndarray, model: tuple, whole: bool) -> tuple:
    """Word vectors, means of documents or sentences, and the logistic inputs."""
    emb, out, bias = model
    per = np.maximum(np.bincount(f["unit_word"], minlength=int(f["words"])), 1).astype(np.float32)
    vec = _sums(emb[table[f["unit"]]], f["unit_word"], int(f["words"])) / per[:, None]
    owner = f["doc"][f["sent"]] if whole else f["sent"]
    n = len(f["marks"]) if whole else len(f["doc"])
    size = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float32)
    mean = _sums(vec[f["word"]], owner, n) / size[:, None]
    return vec, per, owner, size, mean, mean @ out + bias


def _gradient(f: dict[str, np.ndarray], table: np.ndarray, model: tuple, whole: bool, scale: float) -> list[np.ndarray]:
    emb, out, _ = model
    vec, per, owner, size, mean, z = _forward(f, table, model, whole)
    goal = f["marks"] if whole else f["targets"]
    dz = (1 / (1 + np.exp(-z)) - goal).astype(np.float32) * np.float32(scale)
    back = (dz @ out.T) / size[:, None]
    order = f["by_word"]
    dvec = _sums(back[owner[order]], f["word"][order], len(vec)) / per[:, None]
    # rows of units that are seen rise with the unit, so the order by unit is that by row
    slot, order = table[f["unit"]], f["by_unit"]
    return [_sums(dvec[f["unit_word"][order]], slot[order], len(emb)), mean.T @ dz, dz.sum(0)]


class SubjectModel:
    """``rows``: where a unit's vector lies (0: never seen); ``subjects``: ids in the order of outputs."""

    def __init__(self, subjects: list[int], rows: np.ndarray, model: tuple):
        self.subjects, self.rows, self.model = subjects, rows, model

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Contribution of each word to each output, and whether it counts."""
        emb, out, _ = self.model
        per = [units(w) for w in words]
        n = np.array([len(u) for u in per], np.int64)
        flat = np.array([u for us in per for u in us], np.int64)
        sums = _sums(emb[self.rows[flat]], np.repeat(np.arange(len(per)), n), len(per))
        return (sums / np.maximum(n, 1)[:, None]) @ out, n > 0

    def sentence_scores(self, texts: list[str]) -> np.ndarray:
        """Logistic inputs per sentence; minus infinity for sentences without words."""
        parts = []
        for number, owner, words, n in lots(texts):
            scores, live = self.word_scores(words)
            keep = live[number]
            size = np.bincount(owner[keep], minlength=n)
            mean = _sums(scores[number[keep]], owner[keep], n) / np.maximum(size, 1)[:, None] + self.model[2]
            mean[size == 0] = -np.inf
            parts.append(mean)
        return np.concatenate(parts) if parts else np.zeros((0, len(self.subjects)))


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_docs: int = MAX_DOCS) -> SubjectModel:
    """Fit to at most ``max_docs`` labelled documents."""
    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.select("subject_id").filter("subject_id IS NOT NULL").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    place = {s: k for k, s in enumerate(names)}
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("subject_id").isin(names or [None])).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_id")).alias("subjects"))
    # bounded: never more rows than max_docs, all of documents that are there and have a text
    there = documents.filter(F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id").distinct()
    sample = marked.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t, s) for b in batches for d, t, s in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("subjects").to_pylist()))
        if rows:
            goal = np.zeros((len(rows), len(names)), np.float32)
            for k, r in enumerate(rows):
                goal[k, [place[s] for s in r[2]]] = 1
            yield pa.record_batch([pa.array([rows[0][0]], pa.int64()), pa.array([_features([r[1] for r in rows], goal)], pa.binary())], ["part", "data"])

    parts = stored(texts.repartition(PARTS, "doc_id").mapInArrow(collect, "part long, data binary"), "features")

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("data").to_pylist():
                f = _opened(raw)
                yield pa.record_batch([pa.array([_packed(units=np.unique(f["unit"]), docs=np.array(len(f["marks"])), sents=np.array(len(f["doc"])))], pa.binary())], ["data"])

    seen = [_opened(r[0]) for r in parts.mapInArrow(used, "data binary").collect()]
    rows = np.zeros(BUCKETS, np.int64)
    found = np.unique(np.concatenate([s["units"] for s in seen])) if seen else np.zeros(0, np.int64)
    rows[found] = np.arange(1, len(found) + 1)
    rng = np.random.default_rng(7)
    start = (rng.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32)
    emb = np.concatenate([np.zeros((1, DIM), np.float32), start[found]])
    turn = (rng.normal(size=(DIM, len(names))) * 0.3).astype(np.float32)
    model = (emb, turn, np.full(len(names), -2, np.float32))
    if not seen:
        return SubjectModel(names, rows, model)

    def fit(parts: DataFrame, model: tuple, whole: bool, n: int) -> tuple:
        scale = 10 / max(1, n)
        model = [m.copy() for m in model]
        first, second = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model]
        for t in range(1, STEPS + 1):
            held = spark.sparkContext.broadcast((rows, tuple(model)))

            def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table, now = held.value
                for b in batches:
                    for part, raw in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
                        g = _gradient(_opened(raw), table, now, whole, scale)
                        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([_packed(e=g[0], o=g[1], b=g[2])], pa.binary())], ["part", "data"])

            got = [_opened(r["data"]) for r in sorted(parts.mapInArrow(step, "part long, data binary").collect(), key=lambda r: r["part"])]
            held.destroy()
            for k, name in enumerate("eob"):
                g = sum(x[name] for x in got)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
            model[0][0] = 0
        return tuple(m.astype(np.float32) for m in model)

    model = fit(parts, model, True, int(sum(s["docs"] for s in seen)))
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast((rows, model))

        def relabel(batches: Iterator[pa.RecordBatch], bar: float = FIRST_BAR if k == 0 else 0.0) -> Iterator[pa.RecordBatch]:
            table, now = held.value
            for b in batches:
                for part, raw in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
                    f = _opened(raw)
                    z = _forward(f, table, now, False)[-1]
                    f["targets"] = ((z > bar) & (z > z.max(1, keepdims=True) - MARGIN)).astype(np.float32)
                    yield pa.record_batch([pa.array([part], pa.int64()), pa.array([_packed(**f)], pa.binary())], ["part", "data"])

        parts = stored(parts.mapInArrow(relabel, "part long, data binary"), "features")
        model = fit(parts, (emb, turn, np.full(len(names), -2, np.float32)), False, int(sum(s["sents"] for s in seen)))
    return SubjectModel(names, rows, model)


def assign(documents: DataFrame, model: SubjectModel, share: float = 0.2, bar: float = BAR) -> DataFrame:
    """``doc_id, subject_id, sentences, about``: subjects that at least ``share`` of the sentences are about."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            lists = [sentences(t) if d is not None else [] for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            total = np.array([len(x) for x in lists], np.int64)
            z = m.sentence_scores([s for x in lists for s in x])
            about = _sums((z > bar).astype(np.int64), np.repeat(np.arange(len(lists)), total), len(lists))
            doc, subject = np.nonzero((about >= share * total[:, None] - 1e-9) & (about > 0))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                [pa.array(ids[doc].astype(np.int64)), pa.array(np.array(m.subjects, np.int64)[subject] if len(subject) else np.zeros(0, np.int64)), pa.array(total[doc].astype(np.int32)), pa.array(about[doc, subject].astype(np.int32))],
                ["doc_id", "subject_id", "sentences", "about"],
            )

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, subject_id long, sentences int, about int")
