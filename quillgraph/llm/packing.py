"""Texts into containers of fixed token capacity: swap-based local search.

Texts are measured in tokens of a public tokenizer (a parameter; the file is opened where
it lies). Every text is one item; a text larger than the capacity becomes full containers
of its own and one item for the rest. Texts are dealt to shards of about ``shard`` texts
by a hash of their id - the number of shards follows the number of texts, so no task grows
with the data - and each shard is packed for itself: at most one badly filled container
per shard and capacity is lost to that.

A shard starts from best fit by falling size and is then improved: texts are exchanged one
for one and two for one between underfull containers, or moved, whenever the sum of
squared fills grows; a container that empties is gone. Every underfull container of the
shard is a partner of every other: the texts, and the pairs of texts, of those less full
are kept in order of size, so the one that fills best is found by bisection. The search
ends when a pass over the underfull containers finds nothing more.

Defined results: null and empty texts have no tokens and are put nowhere; a null id is
ignored; repeated ids count once (the longest text); a capacity below 1 or null is left out.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.skew import even_labels
from quillgraph.session import stored

SHARD = 10_000
MAX_LIMITS = 1_000
TASKS = 4_096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tokens`` of every document with a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer, pattern).encode_ordinary
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int32())], [key, "tokens"])

    return documents.select(key, text).filter(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(count, f"{key} {dict(documents.dtypes)[key]}, tokens int")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by container; ``sizes`` at most ``capacity`` each."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # free room and container, sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k == len(room):
            bins.append([i])
            left = (capacity - sizes[i], len(bins) - 1)
        else:
            free, b = room.pop(k)
            bins[b].append(i)
            left = (free - sizes[i], b)
        if left[0]:
            insort(room, left)
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int, passes: int | None = None) -> list[list[int]]:
    """Exchanges between underfull containers while they raise the sum of squared fills.

    Moving d tokens from a container filled y to one filled x changes it by 2d(x - y + d):
    any gain for x >= y. Containers are filled from the fullest down, each from those less
    full, by whatever leaves the least room: a text, a text for a smaller one, two texts for
    one. ``passes``: stop after so many; None: when a pass finds nothing, which it must,
    since the sum grows by whole numbers and is bounded.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    done = 0
    while passes is None or done < passes:
        done += 1
        order = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: (-fill[k], k))
        if not _pass(order, bins, fill, sizes, capacity):
            break
    return [b for b in bins if b]


def _pass(order: list[int], bins: list[list[int]], fill: list[int], sizes: list[int], capacity: int) -> bool:
    """One pass over the containers in ``order``; whether anything changed."""
    home = {i: k for k in order for i in bins[k]}
    single = sorted((sizes[i], i) for i in home)
    # pairs of texts of one container; those of a container that has changed since are passed over
    pairs = sorted((sizes[i] + sizes[j], i, j) for k in order for at, i in enumerate(bins[k]) for j in bins[k][:at])
    stale, changed = set(), False

    def forget(i: int) -> None:
        single.pop(bisect_left(single, (sizes[i], i)))

    for x in order:
        for i in bins[x]:
            forget(i)
        stale.add(x)
        while (free := capacity - fill[x]) and bins[x]:
            best = (0, (), ())  # gain, out of x, out of another
            k = bisect_left(single, (free + 1, -1)) - 1
            if k >= 0:
                best = (single[k][0], (), (single[k][1],))
            own = {sizes[i]: i for i in bins[x]}
            for s, i in own.items():
                if best[0] == free:
                    break
                k = bisect_left(single, (s + free + 1, -1)) - 1
                if k >= 0 and single[k][0] - s > best[0]:
                    best = (single[k][0] - s, (i,), (single[k][1],))
            for s, i in own.items():
                if best[0] == free:
                    break
                k = bisect_left(pairs, (s + free + 1, -1, -1)) - 1
                while k >= 0 and pairs[k][0] - s > best[0]:
                    if home[pairs[k][1]] not in stale:
                        best = (pairs[k][0] - s, (i,), pairs[k][1:])
                        break
                    k -= 1
            gain, out, into = best
            if not gain:
                break
            y = home[into[0]]
            stale.add(y)
            for i in into:
                forget(i)
                home[i] = x
            for i in out:
                insort(single, (sizes[i], i))
                home[i] = y
            bins[x] = [i for i in bins[x] if i not in out] + list(into)
            bins[y] = [i for i in bins[y] if i not in into] + list(out)
            fill[x] += gain
            fill[y] -= gain
            changed = True
    return changed


def pack(counts: DataFrame, limits: DataFrame, key: str = "doc_id", shard: int = SHARD, passes: int | None = None) -> DataFrame:
    """``limit_id, capacity, container, key, part, tokens``: which container holds what.

    ``part`` is 0 for a whole text; a text over the capacity has parts 1, 2, ... whose
    tokens add up to it. ``container`` is unique within its limit. ``passes``: see ``improve``.
    """
    rows = limits.filter("capacity_tokens >= 1").select("limit_id", "capacity_tokens").distinct().orderBy("limit_id").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} capacities")
    capacities = [(r[0], r[1]) for r in rows]
    kind = dict(counts.dtypes)[key]
    items = counts.filter(F.col(key).isNotNull() & (F.col("tokens") > 0)).groupBy(key).agg(F.max("tokens").alias("tokens"))
    items = stored(items, "items")
    shards = max(1, -(-items.count() // shard))
    number = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    # one shard per task; beyond TASKS shards several share one and are worked on one after another
    parts = min(shards, TASKS)
    labels = F.array(*[F.lit(k) for k in even_labels(items.sparkSession, parts)])
    spread = items.withColumn("shard", number).withColumn("task", F.get(labels, F.pmod("shard", F.lit(parts))))
    ordered = spread.repartition(parts, "task").drop("task").sortWithinPartitions("shard", key)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finish() -> Iterator[pd.DataFrame]:
            f = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            s, ids, sizes = int(f["shard"].iloc[0]), f[key].tolist(), f["tokens"].tolist()
            for limit, capacity in capacities:
                out, used = [], 0
                small, owner = [], []
                for i, n in zip(ids, sizes):
                    part = 0
                    while n > capacity or (part and n == capacity):
                        part += 1
                        out.append((limit, capacity, used, i, part, capacity))
                        used, n = used + 1, n - capacity
                    if n:
                        small.append(n)
                        owner.append((i, part + 1 if part else 0))
                for b in improve(best_fit(small, capacity), small, capacity, passes):
                    out.extend((limit, capacity, used, *owner[k], small[k]) for k in b)
                    used += 1
                d = pd.DataFrame(out, columns=["limit_id", "capacity", "container", key, "part", "tokens"])
                d["container"] = s * (1 << 40) + d["container"]
                yield d

        for f in frames:
            for s, g in f.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != s:
                    yield from finish()
                    held = []
                held.append(g)
        if held:
            yield from finish()

    return ordered.mapInPandas(fill, f"limit_id int, capacity int, container bigint, {key} {kind}, part int, tokens int")


def unused(packed: DataFrame) -> DataFrame:
    """Per limit: containers, tokens held, and the share of room left unused."""
    whole = packed.groupBy("limit_id", "capacity").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return whole.select("limit_id", "capacity", "containers", "tokens", F.round(1 - F.col("tokens") / room, 6).alias("unused"))
