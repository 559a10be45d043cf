"""Oversized texts into overlapping pieces, cut by content at natural boundaries.

A gear hash over the last 64 bytes marks landmarks: places that depend on nothing but the
bytes just before them. A piece ends at the first landmark between its smallest and its
largest size (else at the largest), moved to the nearest natural boundary of the strongest
kind in reach - a heading or blank line, a sentence or line end, a word - and inside a word
only where there is nothing else. So an edit changes the pieces around it; later landmarks,
and the pieces they end, stay as they were.

Sizes are UTF-8 bytes of the body without carriage returns and outer blanks. Every piece
begins with the last ``overlap`` bytes of the piece before it (up to three more, so as not
to cut a character) and is no larger than ``chunk_size``. The pieces without their
overlaps, in order, are the body.

Defined results: a null, empty or blank body has no pieces; a body within the limit is one
piece; ``overlap`` counts as at most half of ``chunk_size``, ``chunk_size`` as at least 16;
the smallest size as at most half of what is new in a piece, the last piece may be smaller;
a null or unknown ``config_id`` means the default configuration; repeated rows give the
same pieces once; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More configurations than this are not a parameter table and are refused.
MAX_CONFIGS = 10_000

HEADING, BLANK, SENTENCE, WORD, ANY = 4, 3, 2, 1, 0

_FENCE = re.compile(rb"\s*```")
_HEAD = re.compile(rb" {0,3}#{1,6}(?:\s|$)")
_SENTENCE = re.compile(rb"[.!?][\"')\]*_]*\s+")
_SPACE = re.compile(rb"\s+")


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """For each place the sum of table values of the last 64 bytes, each shifted by its distance."""
    h = _gear()[data]
    for k in (1, 2, 4, 8, 16, 32):
        h[k:] += h[:-k] << np.uint64(k) if len(h) > k else 0
    return h


def normal_body(body: str | None) -> bytes:
    return (body or "").replace("\r", "").strip().encode("utf-8", "surrogatepass")


def outline(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """Where headings and blank-line gaps end (a next block begins), and where the text of each block ends."""
    heads, gaps, ends = [], [], []
    at, fenced, blank = 0, False, False
    for line in data.split(b"\n"):
        if _FENCE.match(line):
            fenced = not fenced
            empty = False
        else:
            empty = not fenced and not line.strip()
        if empty:
            if not blank:
                ends.append(at)
            blank = True
        else:
            if blank:
                gaps.append(at)
                blank = False
            if not fenced and at and _HEAD.match(line):
                heads.append(at)
        at += len(line) + 1
    if not blank:
        ends.append(len(data))
    return heads, gaps, ends


def oversized_block_cut(data: bytes, cuts: list[int], gaps: list[int], ends: list[int], limit: int) -> bool:
    """Whether a cut lies in a block that alone, stripped, is over the limit: no piece can hold such a block, so every one is cut."""
    begins = [0, *gaps]
    for place in cuts:
        k = bisect_right(begins, place) - 1
        if begins[k] < place < ends[k] and len(data[begins[k] : ends[k]].decode("utf-8", "surrogatepass").strip().encode("utf-8", "surrogatepass")) > limit:
            return True
    return False


def _boundaries(data: bytes, heads: list[int], gaps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Natural boundaries and how good they are."""
    rank: dict[int, int] = {}
    for m in _SPACE.finditer(data):
        rank[m.end()] = SENTENCE if b"\n" in m.group() else WORD
    for m in _SENTENCE.finditer(data):
        rank[m.end()] = SENTENCE
    rank.update(dict.fromkeys(gaps, BLANK))
    rank.update(dict.fromkeys(heads, HEADING))
    places = np.fromiter(rank, np.int64, len(rank))
    order = np.argsort(places)
    return places[order], np.fromiter(rank.values(), np.int64, len(rank))[order]


def cut_places(data: bytes, limit: int, overlap: int, least: int, landmarks: np.ndarray, heads: list[int], gaps: list[int]) -> list[tuple[int, int]]:
    """Ends of the pieces and how good each boundary is."""
    limit = max(limit, 16)
    overlap = max(0, min(overlap, limit // 2))
    most = limit - overlap - (3 if overlap else 0)
    least = max(1, min(least, most // 2))
    reach = max(1, (most - least) // 3)
    places, ranks = _boundaries(data, heads, gaps)
    ends, begin, n = [], 0, len(data)
    while n - begin > most:
        # the first piece has no overlap of its own and must hold that of the second
        low, high = (begin + least, begin + most) if begin else (max(least, overlap), most + overlap)
        k = np.searchsorted(landmarks, low)
        aim = int(landmarks[k]) if k < len(landmarks) and landmarks[k] <= high else high
        i, j = np.searchsorted(places, low), np.searchsorted(places, high, "right")
        end, rank = 0, ANY
        if i < j:
            near, good = places[i:j], np.minimum(ranks[i:j], BLANK)
            far = np.abs(near - aim)
            inside = far <= reach
            if inside.any():
                near, good, far = near[inside], good[inside], far[inside]
            best = np.lexsort((near, far, -good))[0]
            end = int(near[best])
            rank = int(ranks[np.searchsorted(places, end)])
        else:
            end = aim
            while end > begin + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
        ends.append((end, rank))
        begin = end
    ends.append((n, HEADING))
    return ends


PIECES = "id string, config_id int, bytes int, cut string, pieces array<struct<piece_no:int,start_byte:int,new_byte:int,end_byte:int,boundary:int,text:string>>"


def _settings(configs: DataFrame) -> tuple[dict[int, tuple[int, int, int]], int]:
    rows = configs.select("config_id", "chunk_size", "overlap", "min_chunk_size", "is_default").limit(MAX_CONFIGS + 1).collect()
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} configurations")
    known = {r["config_id"]: (r["chunk_size"], r["overlap"] or 0, r["min_chunk_size"] or 1) for r in rows if r["config_id"] is not None and r["chunk_size"]}
    default = min([r["config_id"] for r in rows if r["is_default"] and r["config_id"] in known] or list(known) or [0])
    return known or {0: (1500, 0, 100)}, default


def split_documents(documents: DataFrame, configs: DataFrame, texts: bool = True) -> DataFrame:
    """``id, config_id, bytes, cut, pieces`` of every document with a body.

    ``cut``: null for one piece, ``inside`` if a piece ends within a block that alone is over the limit, else ``between``.
    ``boundary``: how a piece ends (4 heading or end, 3 blank line, 2 sentence or line, 1 word, 0 inside a word).
    Without ``texts`` the pieces have only their places.
    """
    settings, default = _settings(configs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            bodies = [normal_body(t) for t in b.column("body").to_pylist()]
            chosen = [c if c in settings else default for c in b.column("config_id").to_pylist()]
            large = [k for k, (t, c) in enumerate(zip(bodies, chosen)) if len(t) > settings[c][0]]
            # one pass of hashing over all texts that need it; 64 bytes of distance make them independent
            joined = b"".join(bodies[k] for k in large)
            hashed = gear_hash(np.frombuffer(joined, np.uint8)) if joined else np.zeros(0, np.uint64)
            offset, shift = 0, np.uint64(64)
            marks: dict[int, np.ndarray] = {}
            for k in large:
                size, overlap, least = settings[chosen[k]]
                bits = max(1, int(max(2, (size - min(overlap, size // 2) - least) // 2)).bit_length() - 1)
                own = hashed[offset : offset + len(bodies[k])]
                marks[k] = np.flatnonzero(own >> (shift - np.uint64(bits)) == 0) + 1
                marks[k] = marks[k][marks[k] >= 64]
                offset += len(bodies[k])
            for k, (i, data) in enumerate(zip(b.column("id").to_pylist(), bodies)):
                size, overlap, least = settings[chosen[k]]
                if i is None or not data:
                    continue
                if k not in marks:
                    ends, cut = [(len(data), HEADING)], None
                else:
                    heads, gaps, blocks = outline(data)
                    ends = cut_places(data, size, overlap, least, marks[k], heads, gaps)
                    cut = "inside" if oversized_block_cut(data, [e for e, _ in ends[:-1]], gaps, blocks, size) else "between"
                back = max(0, min(overlap, max(size, 16) // 2))
                pieces, new = [], 0
                for no, (end, rank) in enumerate(ends):
                    start = max(0, new - back)
                    while start and data[start] & 0xC0 == 0x80:
                        start -= 1
                    pieces.append((no, start, new, end, rank, data[start:end].decode("utf-8", "surrogatepass") if texts else None))
                    new = end
                rows.append((i, chosen[k], len(data), cut, pieces))
            ids, cfg, size_of, cuts, parts = zip(*rows) if rows else ((), (), (), (), ())
            kind = pa.list_(pa.struct([("piece_no", pa.int32()), ("start_byte", pa.int32()), ("new_byte", pa.int32()), ("end_byte", pa.int32()), ("boundary", pa.int32()), ("text", pa.string())]))
            names = ("piece_no", "start_byte", "new_byte", "end_byte", "boundary", "text")
            yield pa.record_batch(
                [pa.array(ids, pa.string()), pa.array(cfg, pa.int32()), pa.array(size_of, pa.int32()), pa.array(cuts, pa.string()), pa.array([[dict(zip(names, p)) for p in ps] for ps in parts], kind)],
                ["id", "config_id", "bytes", "cut", "pieces"],
            )

    return documents.select("id", "config_id", "body").mapInArrow(split, PIECES)


def pieces(documents: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per piece; repeated documents are dropped before they are split."""
    once = documents.groupBy("id", "config_id", F.xxhash64("body").alias("__h")).agg(F.first("body").alias("body"))
    return split_documents(once, configs).select("id", "config_id", F.explode("pieces").alias("p")).select("id", "config_id", "p.*")


def rebuilt(documents: DataFrame, configs: DataFrame) -> DataFrame:
    """What pieces put together again are: ``id, config_id, bytes, body_hash, over, lacking``.

    ``body_hash`` is of the new parts of the pieces, in order; ``over`` counts pieces above
    the limit, ``lacking`` pieces that share less than the overlap with the one before.
    """
    settings, default = _settings(configs)
    limits = configs.sparkSession.createDataFrame([(c, max(size, 16), max(0, min(overlap, max(size, 16) // 2))) for c, (size, overlap, _) in settings.items()], "config_id int, size int, back int")
    p = pieces(documents, configs).join(F.broadcast(limits), "config_id")
    # the text of a piece without what it shares
    new = F.substring(F.col("text").cast("binary"), F.col("new_byte") - F.col("start_byte") + 1, F.col("end_byte") - F.col("new_byte"))
    rows = p.groupBy("id", "config_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))).alias("parts"),
        F.count_if(F.octet_length("text") > F.col("size")).alias("over"),
        F.count_if((F.col("piece_no") > 0) & (F.col("new_byte") - F.col("start_byte") < F.col("back"))).alias("lacking"),
    )
    whole = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["new"]))
    return rows.select("id", "config_id", F.octet_length(whole).cast("bigint").alias("bytes"), F.sha2(whole, 256).alias("body_hash"), "over", "lacking")
