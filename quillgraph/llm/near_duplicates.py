"""Near-duplicate texts by multiple-global-order filtering.

Two texts are linked when the Jaccard similarity of their distinct word runs reaches a
threshold t. Under any one global order of all runs, two such texts must share at least k
of the first ``n - a + k`` runs of each (n: its number of runs, a: the overlap t demands
of the pair, k up to a). The operator

1. counts runs over all texts in a count sketch of fixed size, merged block by block;
2. sorts each text's runs by three global orders - rare first by the sketch in classes that
   are fine, of powers of two and of powers of four, each broken by another hash - and posts
   the union of the prefixes with the position in each order;
3. joins postings by run, keeps a meeting only where it lies in a prefix of the pair under
   some order, counts meetings per pair and order, and intersects the filters: under
   *every* order a candidate pair needs its k meetings;
4. verifies candidates on their whole run sets.

The sketch only decides the order, never what is found: the result is exact, but for texts
or runs that share a 64-bit hash. Of copies the row of the smallest id is posted, however
many there are (see ``_firsts``).

Size of what moves: about half of each text's runs, once. Rows go by numbers, which lie
close together in a lot and so take a byte or two where the keys of texts take eight. Broadcast are the sketch
(``2 * 2**SKETCH_BITS`` bytes) and a Bloom filter of the candidates of at most
``2**FILTER_BITS`` bits; where that would be too small, a join does its work.

Defined results: null titles and bodies count as empty; texts whose body has fewer than
``min_words`` words are left out; null ids are ignored; repeated rows count once; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import mix64, ordered, shingles, word_hashes
from quillgraph.plans.skew import even_labels, lookup_join
from quillgraph.session import discard, release, stored

SKETCH_BITS = 22
BLOCK_BITS = 16
FILTER_BITS = 28
SHARED = 8
ORDERS = 3
#: Runs of a lot, whose postings one task holds in narrow columns.
LOT_POSTINGS = 4_000_000
#: Bytes of text worked on at once, postings and pairs of texts held before they are sent on.
SLICE = 1 << 21
POSTED = 600_000
MET = 1 << 20
#: A run of more texts than this is dealt to several tasks.
HOT = 20_000
#: Pairs looked at in one go.
SLAB = 1 << 18
LOT_SCHEMA = "lot int, data binary"


def _packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _slices(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, whatever a batch of Spark holds."""
    for b in batches:
        size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("title", "body"))
        at = np.cumsum(size) // (most or SLICE)
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        for s, e in zip(begin, np.append(begin[1:], b.num_rows)):
            yield b.slice(int(s), int(e - s))


def _runs(batch: pa.RecordBatch, size: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``run, row``: distinct runs of each row with enough words, sorted by row, then by value."""
    titles, bodies = batch.column("title").to_pylist(), batch.column("body").to_pylist()
    n = batch.num_rows
    words, owner, _ = word_hashes([f"{t or ''}\n{b or ''}" for t, b in zip(titles, bodies)])
    _, title_of, _ = word_hashes(titles)
    enough = np.bincount(owner, minlength=n) - np.bincount(title_of, minlength=n) >= min_words
    if not enough.all():
        words, owner = words[enough[owner]], owner[enough[owner]]
    runs, owner = shingles(words, owner, size)
    key = owner.astype(np.uint64) << np.uint64(44) | runs >> np.uint64(20)
    order = np.argsort(key)
    runs, owner, key = runs[order], owner[order], key[order]
    same = key[1:] == key[:-1]
    if (same & (runs[1:] != runs[:-1])).any() or n >= 1 << 20:  # equal up to the bits that fit: settle it in full
        order = np.lexsort((runs, owner))
        runs, owner = runs[order], owner[order]
        same = (runs[1:] == runs[:-1]) & (owner[1:] == owner[:-1])
    first = np.append(True, ~same) if len(runs) else np.zeros(0, bool)
    return runs[first], owner[first]


def _cells(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (runs & mask).astype(np.int64), ((runs >> np.uint64(SKETCH_BITS)) & mask).astype(np.int64)


#: What the 256 codes of a sketch cell stand for: exact up to 63, then steps of about a tenth.
LEVELS = np.concatenate([np.arange(64), np.unique(np.ceil(64 * 1.1 ** np.arange(192)).astype(np.int64))[:192]])


def _coded(counts: np.ndarray) -> np.ndarray:
    """The smallest code whose level is not below the count."""
    return np.minimum(np.searchsorted(LEVELS, counts, "left"), len(LEVELS) - 1).astype(np.uint8)


def _sketch(texts: DataFrame, size: int, min_words: int, firsts: Broadcast) -> np.ndarray:
    """Two rows of codes (see ``LEVELS``) of counts that never fall short of the true ones.

    A task counts all it reads into one array, so there are no more tasks than keep the
    cluster busy; blocks are summed and coded to one byte on the executors.
    """
    spark = texts.sparkSession
    tasks = max(256, 4 * spark.sparkContext.defaultParallelism)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << SKETCH_BITS), np.uint32)
        for b in _slices(_passed(batches, firsts)):
            runs, _ = _runs(b, size, min_words)
            for row, cell in enumerate(_cells(runs)):
                np.add.at(sums[row], cell, np.uint32(1))
        if sums.any():
            blocks = sums.reshape(-1, 1 << BLOCK_BITS)
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([_packed(x.tobytes()) for x in blocks], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                part = np.frombuffer(_unpacked(raw), np.uint32)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([_packed(_coded(x).tobytes()) for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    parts = texts.select("title", "body", "one").coalesce(tasks).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    out = np.zeros((2 << SKETCH_BITS) >> BLOCK_BITS << BLOCK_BITS, np.uint8).reshape(-1, 1 << BLOCK_BITS)
    for r in parts:
        out[r["block"]] = np.frombuffer(_unpacked(r["counts"]), np.uint8)
    return out.reshape(2, -1)


def _keyed(texts: DataFrame) -> DataFrame:
    """Texts with ``whole``, a key of title and body; copies have the same."""
    text = [F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))]
    return texts.filter(F.col("id").isNotNull()).select("id", "title", "body", F.xxhash64(*text).alias("whole"))


def _one(rows: DataFrame) -> DataFrame:
    """Rows with ``one``, a hash of a text and its id."""
    return rows.withColumn("one", F.xxhash64("whole", "id"))


def _passed(batches: Iterator[pa.RecordBatch], held: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """The rows whose ``one`` is in a filter of ``_filter``; all where there is none."""
    for b in batches:
        if held is not None:
            hit = np.ones(b.num_rows, bool)
            for at in _bits(b.column("one").to_numpy(), 8 * len(held.value)):
                hit &= (held.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            b = b.filter(pa.array(hit))
        yield b


def _firsts(members: DataFrame, filter_bits: int = FILTER_BITS) -> Broadcast:
    """A filter with the smallest id of each text of ``members`` (``whole, id``).

    It lets a copy through now and then, which costs a little work and changes no result: so
    its size has a bound, however many texts there are.
    """
    firsts = _one(members.groupBy("whole").agg(F.min("id").alias("id"))).select(F.col("one").alias("whole"))
    size = 1 << max(16, min(filter_bits, (10 * firsts.count()).bit_length()))
    return members.sparkSession.sparkContext.broadcast(_filter(firsts, size))


def _lots(place: np.ndarray, labels: list[int], docs: dict[str, np.ndarray], refs: tuple[str, ...], **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows cut by ``place``, the index of a label, into one compressed lot per label.

    ``docs`` are tables that the columns ``refs`` point into; each lot gets the part that it uses.
    """
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(len(labels) + 1))
    names, raws = [], []
    for k, label in enumerate(labels):
        mine = order[ends[k] : ends[k + 1]]
        if len(mine):
            part = {n: c[mine] for n, c in columns.items()}
            used, at = np.unique(np.concatenate([part[r] for r in refs]), return_inverse=True)
            part |= dict(zip(refs, np.split(at, len(refs)))) | {n: c[used] for n, c in docs.items()}
            # numbers of rows are in order, so their gaps are small
            part["docs"] = np.diff(part["docs"].astype(np.uint64), prepend=np.uint64(0))
            out = io.BytesIO()
            np.savez(out, **{n: _shrunk(c) for n, c in part.items()})
            names.append(label)
            raws.append(_packed(out.getvalue()))
    yield pa.record_batch([pa.array(names, pa.int32()), pa.array(raws, pa.binary())], ["lot", "data"])


def _shrunk(c: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type, byte by byte, which compresses better."""
    top = int(c.max(initial=0))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    return np.ascontiguousarray(c.astype(kind).view(np.uint8).reshape(len(c), -1).T)


def _grown(c: np.ndarray) -> np.ndarray:
    """The numbers, still in the narrowest type."""
    wide = np.ascontiguousarray(c.T)
    return wide.view(f"<u{wide.shape[1]}").ravel()


def _opened(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(_unpacked(raw))) as z:
        return {n: np.cumsum(_grown(z[n]), dtype=np.uint64) if n == "docs" else _grown(z[n]) for n in z.files}


#: A row's number: the number of its task above, its place among the rows of the task below.
ROW_BITS = 40


def _postings(texts: DataFrame, size: int, min_words: int, t: float, held: Broadcast, labels: list[int], firsts: Broadcast | None = None) -> DataFrame:
    """Lots of postings: ``group`` (gaps of sorted 40-bit run keys), ``at``, ``left0`` and so on, ``side``.

    ``at`` is a place in the tables ``docs`` and ``sizes``: numbers of rows and of their runs. What text has
    a number goes out once, in lots of labels below 0: ``docs`` and ``whole``.

    ``left``: how many runs of the text are not before this one in that order, 0 if it is
    beyond the prefix. A run of many texts is dealt to cells of pairs of blocks, each with at
    most two blocks of as many texts as the limit held with the sketch; ``side`` tells which of two different blocks a text is in.
    """
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, limit = held.value
        pending, posted, base = [], 0, 0
        context = TaskContext.get()
        task, rows = context.partitionId() if context else 0, 0
        for b in _slices(_passed(batches, firsts)):
            runs, owner = _runs(b, size, min_words)
            if not len(runs):
                continue
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            n = np.diff(np.append(begin, len(runs)))
            docs = np.uint64(task << ROW_BITS) + np.arange(rows, rows + len(begin), dtype=np.uint64)
            rows += len(begin)
            wholes = b.column("whole").to_numpy().view(np.uint64)[owner[begin]]
            at = np.repeat(np.arange(len(begin)), n)
            c0, c1 = _cells(runs)
            seen = LEVELS[np.minimum(counts[0][c0], counts[1][c1])]
            size_of = np.repeat(n, n)
            long = size_of - np.ceil(size_of * t - 1e-9).astype(np.int64) + SHARED
            left = []
            with np.errstate(over="ignore"):
                # runs are mixed already: an odd factor gives another order
                others = [runs * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            power = np.frexp(seen)[1]
            for high, bits, low in ((np.minimum(counts[0][c0], counts[1][c1]), 8, runs), (power, 6, others[0]), (power // 2, 5, others[1])):
                order = ordered(owner, high, bits, low)
                place = np.empty(len(runs), np.int64)
                place[order] = np.arange(len(runs)) - np.repeat(begin, n)
                left.append(np.where(place < long, size_of - place, 0))
            # a count of one is exact: nobody else has that run
            keep = (seen > 1) & (np.maximum.reduce(left) > 0)
            group, side = runs[keep], np.zeros(int(keep.sum()), np.int64)
            cols = [c[keep] for c in (at, *left)]
            hot = np.flatnonzero(seen[keep] > limit)
            if len(hot):
                blocks = -(-seen[keep][hot] // limit)
                mine = (mix64(docs[cols[0][hot]]) % blocks.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(hot)), blocks)
                other_block = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(mine[again], other_block), np.maximum(mine[again], other_block)
                with np.errstate(over="ignore"):
                    cell = mix64(group[hot][again] ^ mix64((low << 32 | high).astype(np.uint64) + np.uint64(1)))
                cold = np.ones(len(group), bool)
                cold[hot] = False
                side = np.concatenate([side[cold], np.where(low == high, 0, np.where(mine[again] == low, 1, 2))])
                group = np.concatenate([group[cold], cell])
                cols = [np.concatenate([c[cold], c[hot][again]]) for c in cols]
            pending.append((group, side.astype(np.uint8), docs, wholes, n.astype(np.uint32), *((c + (base if k == 0 else 0)).astype(np.uint32) for k, c in enumerate(cols))))
            posted, base = posted + len(group), base + len(docs)
            if posted >= POSTED:
                yield from sent(pending)
                pending, posted, base = [], 0, 0
        if pending:
            yield from sent(pending)

    def sent(pending: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        group, side, docs, wholes, n, *cols = (np.concatenate(x) for x in zip(*pending))
        yield from _lots(np.zeros(len(docs), np.int64), [~labels[int(docs[0] % np.uint64(len(labels)))]], {"docs": docs, "whole": wholes}, ("at",), at=np.arange(len(docs)))
        key = group >> np.uint64(24)
        place = (mix64(key) % np.uint64(len(labels))).astype(np.int64)
        order = np.argsort(key)
        place, key = place[order], key[order]
        # within a lot keys are sorted, so their gaps are small
        seq = np.argsort(place, kind="stable")
        gap = np.empty(len(key), np.uint64)
        sorted_key, sorted_place = key[seq], place[seq]
        step = np.append(sorted_key[:1], sorted_key[1:] - np.where(sorted_place[1:] == sorted_place[:-1], sorted_key[:-1], 0))
        gap[seq] = step
        names = ("at", *(f"left{k}" for k in range(ORDERS)))
        yield from _lots(place, labels, {"docs": docs, "sizes": n}, ("at",), group=gap, side=side[order], **dict(zip(names, (c[order] for c in cols))))

    return texts.select("title", "body", "whole", "one").mapInArrow(post, LOT_SCHEMA)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each label and all its lots, packed, one label after another."""
    by: dict[int, list[bytes]] = {}
    for b in batches:
        for k, raw in zip(b.column("lot").to_pylist(), b.column("data").to_pylist()):
            by.setdefault(k, []).append(raw)
    b = None
    for k in sorted(by):
        yield k, by.pop(k)


def _parts(raws: list[bytes]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """The texts of a label, and its postings by run (``group, doc, n, side, left...``) in parts of about ``POSTED``, each run in one part."""
    docs, cols, begin = [], [], 0
    while raws:
        x = _opened(raws.pop())
        at = x["at"].astype(np.int64)
        docs.append(x["docs"])
        cols.append((np.cumsum(x["group"], dtype=np.uint64), (at + begin).astype(np.uint32), x["sizes"][at], x["side"], *(x[f"left{k}"] for k in range(ORDERS))))
        begin += len(x["docs"])
    docs, number = np.unique(np.concatenate(docs), return_inverse=True)
    number = number.astype(np.uint32)
    whole = [np.concatenate(c) for c in zip(*cols)]
    del cols, x
    order = np.argsort(whole[0])
    at = 0
    while at < len(order):
        stop = min(at + POSTED, len(order))
        # all of the last run
        stop = int(np.searchsorted(whole[0], whole[0][order[stop - 1]], "right", sorter=order))
        mine = order[at:stop]
        at = stop
        group, doc, *rest = (c[mine] for c in whole)
        yield docs, (group, number[doc], *rest)


def _meetings(postings: tuple[np.ndarray, ...], t: float) -> Iterator[tuple[np.ndarray, ...]]:
    """``pair, votes...``: pairs of texts (numbers) that meet within a prefix, with their votes under every order, in slabs."""
    group, doc, n, side, *left = (c.astype(np.uint64 if k == 0 else np.int64) for k, c in enumerate(postings))
    order = np.lexsort((doc, n, group))
    group, doc, n, side, *left = (c[order] for c in (group, doc, n, side, *left))
    # a row that came twice with a run is one
    fresh = np.append(True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]))[: len(group)]
    group, doc, n, side, *left = (c[fresh] for c in (group, doc, n, side, *left))
    if not len(group):
        return
    number = np.cumsum(np.append(0, group[1:] != group[:-1]))
    wide = int(n.max()) + 1
    far = np.minimum(np.floor(n / t + 1e-9).astype(np.int64), wide - 1)
    end = np.searchsorted(number * wide + n, number * wide + far, "right")
    # the smaller text needs only the prefix for partners of at least its size
    short = np.maximum.reduce(left) > np.ceil(2 * n * t / (1 + t) - 1e-9).astype(np.int64) - SHARED
    count = np.where(short, end - np.arange(len(n)) - 1, 0)
    upto = np.cumsum(count)
    at = 0
    while at < len(n):
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + SLAB, "right")))
        i = np.repeat(np.arange(at, stop), count[at:stop])
        j = np.arange(len(i)) - np.repeat(upto[at:stop] - count[at:stop] - base, count[at:stop]) + i + 1
        at = stop
        if not len(i):
            continue
        need = np.ceil((n[i] + n[j]) * (t / (1 + t)) - 1e-9).astype(np.int64)
        slack = np.minimum(SHARED, need) - need
        votes = [np.minimum(x[i], x[j]) + slack > 0 for x in left]
        keep = np.logical_or.reduce(votes) & ((side[i] == 0) | (side[i] != side[j])) & (doc[i] != doc[j])
        # where the pair demands fewer than SHARED meetings, one is enough
        unit = np.where(need[keep] < SHARED, SHARED, 1).astype(np.uint8)
        low, high = np.minimum(doc[i[keep]], doc[j[keep]]), np.maximum(doc[i[keep]], doc[j[keep]])
        yield low << 32 | high, *(v[keep] * unit for v in votes)


def _added(pair: np.ndarray, *votes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Votes per pair, sorted by pair, kept at SHARED."""
    order = np.argsort(pair)
    pair = pair[order]
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    if not len(at):
        return pair, *votes
    return pair[at], *(np.minimum(np.add.reduceat(v[order], at, dtype=np.int64), SHARED).astype(np.uint8) for v in votes)


def _counted(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the pairs of a label that have their votes under every order; about ``MET`` pairs are added up at once."""
    lots = []
    while raws:
        lots.append(_opened(raws.pop()))
    cuts = -(-sum(len(x["a"]) for x in lots) // MET)
    for cut in range(cuts):
        found = []
        for x in lots:
            # the keys' own bits deal the pairs, apart from those that chose the label
            mine = slice(None) if cuts == 1 else (x["docs"][x["a"]] ^ mix64(x["docs"][x["b"]])) % np.uint64(cuts) == cut
            found.append((x["docs"][x["a"][mine]], x["docs"][x["b"][mine]], x["votes"][mine].astype(np.uint16)))
        a, b, packed = map(np.concatenate, zip(*found))
        del found
        docs, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        pair = number[: len(a)] << 32 | number[len(a) :]
        del a, b, number
        pair, *votes = _added(pair, *((packed >> 4 * k & 15).astype(np.uint8) for k in range(ORDERS)))
        pair = pair[np.minimum.reduce(votes) >= SHARED]
        yield docs[pair >> 32].astype(np.uint64).view(np.int64), docs[pair & 0xFFFFFFFF].astype(np.uint64).view(np.int64)


def candidate_keys(texts: DataFrame, members: DataFrame, size: int, min_words: int, t: float, most: int = HOT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``a, b``: keys of pairs that pass the filters of every order, from the texts of ``_keyed`` and their ``whole, id``."""
    spark = texts.sparkSession
    firsts, texts = _firsts(members, filter_bits), _one(texts)
    sketch = _sketch(texts, size, min_words, firsts)
    # as many lots as the runs counted ask for
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(LEVELS[sketch[0]].sum()) // LOT_POSTINGS + 1)
    labels = even_labels(spark, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, raws in _gathered(batches):
            if label < 0:
                yield pa.record_batch([pa.array([label] * len(raws), pa.int32()), pa.array(raws, pa.binary())], ["lot", "data"])
                continue
            docs, sums, pending = None, [], 0
            for docs, part in _parts(raws):
                for x in _meetings(part, t):
                    sums.append(x)
                    pending += len(x[0])
                    if pending > 2 * MET:
                        sums = [_added(*map(np.concatenate, zip(*sums)))]
                        pending = len(sums[0][0])
                        if pending > MET:  # votes of a pair may come in several lots
                            yield from met(docs, *sums[0])
                            sums, pending = [], 0
            if sums:
                yield from met(docs, *_added(*map(np.concatenate, zip(*sums))))

    def met(docs: np.ndarray, pair: np.ndarray, *votes: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        with np.errstate(over="ignore"):
            place = (mix64(docs[a] ^ mix64(docs[b])) % np.uint64(len(labels))).astype(np.int64)
        packed = sum(v.astype(np.uint16) << 4 * k for k, v in enumerate(votes))
        yield from _lots(place, labels, {"docs": docs}, ("a", "b"), a=a, b=b, votes=packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, raws in _gathered(batches):
            if label < 0:
                named = ((x["docs"].view(np.int64), x["whole"].astype(np.uint64).view(np.int64)) for x in map(_opened, raws))
            for a, b in _counted(raws) if label >= 0 else named:
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), label >= 0))], ["a", "b", "pair"])

    # counts below twice what chance puts into a cell say nothing
    chance = 2 * float(LEVELS[sketch].mean())
    held = spark.sparkContext.broadcast((sketch, max(most, int(chance))))
    lots = _postings(texts, size, min_words, t, held, labels, firsts)
    # one table of pairs of numbers and of the texts they stand for, from one run over the rows
    rows = stored(lots.repartition(parts, "lot").mapInArrow(meet, LOT_SCHEMA).repartition(parts, "lot").mapInArrow(count, "a long, b long, pair boolean"), "numbers")
    held.destroy()
    firsts.destroy()
    del lots
    release(spark)
    named = rows.filter("NOT pair")
    pairs = rows.filter("pair").select("a", "b").join(named.select("a", F.col("b").alias("x")), "a").join(named.select(F.col("a").alias("b"), F.col("b").alias("y")), "b")
    out = stored(pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    discard(rows)
    return out


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a key in a filter of ``size`` bits (a power of two)."""
    keys, mask = keys.view(np.uint64), np.uint64(size - 1)
    return mix64(keys) & mask, mix64(keys ^ np.uint64(0x5BD1E995)) & mask


def _filter(keys: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of ``size`` bits with the column ``whole`` of ``keys``, merged block by block on the executors."""
    block = min(size, 1 << 19)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [at for b in batches for at in _bits(b.column("whole").to_numpy(), size)]
        if not places:
            return
        places = np.unique(np.concatenate(places)).astype(np.int64)
        used, first = np.unique(places // block, return_index=True)
        raws = []
        for mine in np.split(places % block, first[1:]):
            cells = np.zeros(block, bool)
            cells[mine] = True
            raws.append(_packed(np.packbits(cells).tobytes()))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(raws, pa.binary())], ["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("bits").to_pylist()):
                part = np.frombuffer(_unpacked(raw), np.uint8)
                sums[k] = sums[k] | part if k in sums else part
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([_packed(x.tobytes()) for x in sums.values()], pa.binary())], ["block", "bits"])

    out = np.zeros((size // block, block >> 3), np.uint8)
    for r in keys.coalesce(64).mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary").collect():
        out[r["block"]] = np.frombuffer(_unpacked(r["bits"]), np.uint8)
    return out.ravel()


def run_sets(texts: DataFrame, size: int, min_words: int, keys: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``whole, runs`` of the texts among ``keys`` (``whole``, and one of its ids): their sorted run sets (binary).

    Only rows of that id are looked at, so copies cost nothing. A Bloom filter of ten bits a key and more lets through a few others too, which meet
    nobody later. Keys too many for ``2**filter_bits`` bits are joined instead.
    """
    spark = texts.sparkSession
    texts, keys = _one(texts).drop("id"), _one(keys).select("one")
    want = 1 << max(16, (10 * keys.count()).bit_length())
    held = spark.sparkContext.broadcast(_filter(keys.withColumnRenamed("one", "whole"), want)) if want <= 1 << filter_bits else None
    if held is None:
        texts = texts.join(keys.distinct(), "one", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(_passed(batches, held)):
            runs, owner = _runs(b, size, min_words)
            if not len(runs):
                continue
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            end = np.append(begin[1:], len(runs))
            whole = b.column("whole").to_numpy()[owner[begin]]
            yield pa.record_batch([pa.array(whole), pa.array([runs[s:e].tobytes() for s, e in zip(begin, end)], pa.binary())], ["whole", "runs"])

    return texts.select("title", "body", "whole", "one").mapInArrow(sets, "whole long, runs binary")


def _verify(pairs: DataFrame, t: float) -> DataFrame:
    """Pairs of run sets whose similarity reaches t, with the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("x").to_pylist(), b.column("y").to_pylist()
            sim = np.zeros(b.num_rows)
            for i, (p, q) in enumerate(zip(left, right)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                sim[i] = both / (len(p) + len(q) - both)
            keep = sim >= t
            yield pa.record_batch([b.column("wa").filter(pa.array(keep)), b.column("wb").filter(pa.array(keep)), pa.array(sim[keep])], ["wa", "wb", "similarity"])

    return pairs.select("wa", "wb", "x", "y").mapInArrow(check, "wa long, wb long, similarity double")


class NearDuplicates:
    """Links between different texts, and the ids of each text.

    ``members``: ``whole, id``; ``links``: ``wa, wb, similarity`` between distinct texts, wa < wb.
    """

    def __init__(self, texts: DataFrame, size: int = 5, min_words: int = 20, threshold: float = 0.8, most: int = HOT, filter_bits: int = FILTER_BITS):
        texts = _keyed(texts)
        self.members = stored(texts.select("whole", "id").distinct(), "members")
        candidates = candidate_keys(texts, self.members, size, min_words, threshold, most, filter_bits)
        release(texts.sparkSession)
        # texts under several ids are looked at again only to see whether they have enough words
        named = self.members.groupBy("whole").agg(F.min("id").alias("id"), F.max("id").alias("hi"))
        met = candidates.select(F.explode(F.array("a", "b")).alias("whole")).distinct().withColumn("met", F.lit(True))
        keys = stored(named.join(met, "whole", "left").filter("met OR id < hi").select("whole", "id"), "keys")
        sets = stored(run_sets(texts, size, min_words, keys, filter_bits), "sets")
        self.long_enough = sets.select("whole").distinct()
        # one exchange by key removes copies and serves both joins
        one = sets.repartition("whole").dropDuplicates(["whole"])
        left = one.select(F.col("whole").alias("a"), F.col("runs").alias("x"))
        right = one.select(F.col("whole").alias("b"), F.col("runs").alias("y"))
        pairs = candidates.join(left, "a").join(right, "b").select(F.least("a", "b").alias("wa"), F.greatest("a", "b").alias("wb"), "x", "y")
        self.links = stored(_verify(pairs, threshold).distinct(), "links")

    def pairs(self) -> DataFrame:
        """``id_a, id_b, similarity``, id_a < id_b: every pair of ids, copies among themselves included.

        As many rows as there are such pairs; ``groups`` says the same in one row per id. A
        text of many ids is spread over tasks. A pair can come more than once only by an id of
        several texts; all others go out as they are made, without an exchange.
        """
        several = self.members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("m"))
        members = stored(self.members.join(several, "id", "left").select("whole", "id", F.coalesce("m", F.lit(False)).alias("m")), "members")
        ma, mb = members.select(F.col("whole").alias("wa"), F.col("id").alias("x"), F.col("m").alias("mx")), members.select(F.col("whole").alias("wb"), F.col("id").alias("y"), F.col("m").alias("my"))
        cols = ["x", "y", "similarity", "mx", "my"]
        linked = lookup_join(mb, lookup_join(ma, self.links, ["wa"]), ["wb"]).select(cols)
        same = ma.join(self.long_enough.select(F.col("whole").alias("wa")), "wa", "left_semi")
        copies = lookup_join(same, mb.withColumnRenamed("wb", "wa"), ["wa"]).filter("x < y").withColumn("similarity", F.lit(1.0)).select(cols)
        found = linked.unionByName(copies).withColumns({"id_a": F.least("x", "y"), "id_b": F.greatest("x", "y")})
        # two filters, since each reaches the members while one of both would meet every pair again
        again = found.filter("mx").unionByName(found.filter("NOT mx AND my")).filter("x <> y").groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))
        return found.filter("NOT mx AND NOT my").select("id_a", "id_b", "similarity").unionByName(again)

    def groups(self) -> DataFrame:
        """``id, class_id, links``: one row per id; the class joins everything reachable over links.

        ``class_id`` is the smallest id of the class, ``links`` the number of different texts linked to the id's text.
        Copies are not expanded into pairs.
        """
        names = self.members.groupBy("whole").agg(F.min("id").alias("low"))
        ends = self.links.select(F.col("wa").alias("whole"), F.col("wb").alias("other")).unionByName(self.links.select(F.col("wb").alias("whole"), F.col("wa").alias("other")))
        degree = ends.groupBy("whole").agg(F.count(F.lit(1)).alias("links"))
        label = stored(ends.select("whole").distinct().join(names, "whole"), "label")
        while True:
            near = ends.join(label.select(F.col("whole").alias("other"), F.col("low").alias("near")), "other").groupBy("whole").agg(F.min("near").alias("near"))
            # hop: a label is itself the name of a text, whose own label may be smaller still
            step = label.join(near, "whole").select("whole", "low", F.least("low", "near").alias("new"))
            jump = step.join(label.join(names.withColumnRenamed("low", "name"), "whole").select(F.col("name").alias("new"), F.col("low").alias("via")), "new", "left")
            after = stored(jump.select("whole", F.least("new", F.coalesce("via", "new")).alias("low"), (F.least("new", F.coalesce("via", "new")) < F.col("low")).alias("moved")), "label")
            moved = after.filter("moved").take(1)
            discard(label)
            label = after.drop("moved")
            label._quillgraph_path = after._quillgraph_path
            if not moved:
                break
        joined = self.members.join(label.select("whole", F.col("low").alias("class_low")), "whole", "left").join(names, "whole").join(degree, "whole", "left")
        return joined.groupBy("id").agg(F.min(F.coalesce("class_low", "low")).alias("class_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"))
