"""Graph operators as rounds of joins: closures, paths, components, circles, ranks.

Edges are ``src, dst`` (strings) unless said otherwise. Each round ends in a table in the
shared folder (see ``stored``), so plans stay short and a lost executor costs one round;
tables of earlier rounds are deleted. Ends of paths and labels are ordered, so results do
not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.stats import first_per_group
from quillgraph.plans.skew import lookup_join
from quillgraph.session import discard, observed, stored

#: Adjacency lists up to this many edges are handed to tasks whole (four bytes an edge and some twenty a node); beyond, joins do the work.
BROADCAST_EDGES = 32_000_000
#: Lists of more edges than this are numbered and sorted by joins, and come to the driver in parts.
DRIVER_EDGES = 2_000_000
#: Rows of sources by nodes that are joined at once.
LOT_ROWS = 100_000_000


def _counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` as a table, and its rows, counted while they are written."""
    out, seen = observed(df, label, n=F.count(F.lit(1)))
    return out, seen["n"]


def _until_still(state: DataFrame, change, label: str) -> DataFrame:
    """Rounds of ``change`` (which adds ``moved``) until no row of a table moves."""
    while True:
        after, seen = observed(change(state), label, moved=F.count_if("moved"))
        discard(state)
        path, state = after._quillgraph_path, after.drop("moved")
        state._quillgraph_path = path
        if not seen["moved"]:
            return state


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id``: seeds (column id) and all that they reach along ``src, dst``; each node is visited once."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    front, n = _counted(seeds.select("id").distinct(), "front")
    seen = front
    while n:
        step = front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front, n = _counted(step.join(seen, "id", "left_anti"), "front")
        if n:
            before, seen = seen, stored(seen.unionByName(front), "seen")
            discard(before)
    return seen


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _steps(first: int, most: int | None) -> Iterator[int]:
    """``first, first + 1, ...`` up to ``most``, without end where that is None."""
    return iter(range(first, most + 1)) if most is not None else count(first)


class _Lists(NamedTuple):
    """Adjacency lists by number: the nodes of edges in dictionary order; ends and values of the edges from each, by number."""

    ids: pa.Array
    begin: np.ndarray
    ends: np.ndarray
    value: np.ndarray | None

    def numbers(self, ids: pa.Array) -> np.ndarray:
        """The number of each id, -1 where no edge has it."""
        own = ids.dictionary_encode()
        # looked up among the few given, not among those of all edges
        at = pc.fill_null(pc.index_in(self.ids, own.dictionary), -1).to_numpy(zero_copy_only=False)
        there = np.flatnonzero(at >= 0)
        out = np.full(len(own.dictionary) + 1, -1)
        out[at[there]] = there
        return out[pc.fill_null(own.indices, -1).to_numpy(zero_copy_only=False)]

    def steps(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every edge from the nodes of ``front``, in order: the place of its start in ``front``, and the edge."""
        n = self.begin[front + 1] - self.begin[front]
        upto = np.cumsum(n)
        return np.repeat(np.arange(len(front)), n), np.repeat(self.begin[front] - upto + n, n) + np.arange(upto[-1] if len(n) else 0)


def _lists(edges: DataFrame, value: str | None = None) -> Broadcast | None:
    """The adjacency lists of distinct edges (a table) for every task, or None where there are more than ``BROADCAST_EDGES``."""
    n = edges.count()
    if n > BROADCAST_EDGES:
        return None
    if n > DRIVER_EDGES:
        numbered = _numbered(edges, n, value)
        return numbered and edges.sparkSession.sparkContext.broadcast(numbered)
    rows = edges.toArrow()
    src, dst = (rows[c].combine_chunks().cast(pa.string()) for c in ("src", "dst"))
    ids = pc.unique(pa.concat_arrays([src, dst]))
    ids = ids.take(pc.sort_indices(ids))
    a, b = (pc.index_in(x, ids).to_numpy(zero_copy_only=False) for x in (src, dst))
    order = np.lexsort((b, a))
    begin = np.searchsorted(a[order], np.arange(len(ids) + 1))
    values = rows[value].to_numpy()[order] if value else None
    return edges.sparkSession.sparkContext.broadcast(_Lists(ids, begin, b[order], values))


def _numbered(edges: DataFrame, n: int, value: str | None) -> _Lists | None:
    """The same lists where the edges are too many for the driver to number: parts come to it one by one, in order.

    None where the ids of all nodes are more bytes than an array of strings holds.
    """
    first = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().orderBy("id")
    placed = stored(first.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ids")
    held = sorted(tuple(r) for r in placed.groupBy("part").agg(F.count(F.lit(1)), F.sum(F.octet_length("id"))).collect())
    if sum(size for _, _, size in held) >= 1 << 31:
        discard(placed)
        return None
    begins = np.cumsum([0, *(rows for _, rows, _ in held)]).tolist()
    begin_of = F.broadcast(edges.sparkSession.createDataFrame([(p, b) for (p, _, _), b in zip(held, begins)], "part int, begin long"))
    # the number of a row: its partition above 33 bits, its place in it below
    nodes = stored(placed.join(begin_of, "part").select("id", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("begin")).cast("int").alias("k")), "nodes")
    discard(placed)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("id").cast(pa.binary()).to_pylist()
            yield pa.record_batch([pa.array([np.array([len(x) for x in raw], np.int32).tobytes()]), pa.array([b"".join(raw)])], ["sizes", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([c.to_numpy(zero_copy_only=False).tobytes()]) for c in b.columns], names)

    offsets, data, at = np.zeros(begins[-1] + 1, np.int32), bytearray(), 0
    for r in nodes.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(texts, "sizes binary, data binary").toLocalIterator():
        sizes = np.frombuffer(r["sizes"], np.int32)
        offsets[at + 1 : at + 1 + len(sizes)] = len(data) + np.cumsum(sizes)
        data += r["data"]
        at += len(sizes)
    ids = pa.StringArray.from_buffers(begins[-1], pa.py_buffer(offsets), pa.py_buffer(data))
    names = ["a", "b", *([value] if value else [])]
    pairs = edges.join(nodes.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst").select(names)
    kind = {"int": np.int32, "bigint": np.int64}.get(dict(pairs.dtypes).get(value), np.float64)
    many, ends, values, at = np.zeros(len(ids) + 1, np.int32), np.empty(n, np.int32), np.empty(n if value else 0, kind), 0
    for r in pairs.repartitionByRange("a").sortWithinPartitions("a", "b").mapInArrow(pack, ", ".join(f"{c} binary" for c in names)).toLocalIterator():
        start, times = np.unique(np.frombuffer(r["a"], np.int32), return_counts=True)
        many[start + 1] += times.astype(np.int32)
        part = np.frombuffer(r["b"], np.int32)
        ends[at : at + len(part)] = part
        if value:
            values[at : at + len(part)] = np.frombuffer(r[value], kind)
        at += len(part)
    discard(nodes)
    return _Lists(ids, np.cumsum(many, dtype=np.int32), ends, values if value else None)


def _dealt(seeds: DataFrame) -> DataFrame:
    """Seeds in tasks of about equal numbers, several for each core."""
    return seeds.repartition(8 * max(6, seeds.sparkSession.sparkContext.defaultParallelism))


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``seed, id, depth``: what each seed reaches, at the least depth, without itself.

    ``seeds`` (column id): all sources where None. ``max_depth``: a limit on the steps, where one is wanted.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    first = edges if seeds is None else edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    front = stored(first.select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.lit(1).alias("depth")).filter("seed <> id"), "front")
    levels = [front]
    for depth in _steps(2, max_depth):
        seen = levels[0]
        for x in levels[1:]:
            seen = seen.unionByName(x)
        step = front.join(edges, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).filter("seed <> id").distinct()
        front, n = _counted(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if not n:
            break
        levels.append(front)
        if len(levels) > 6:  # few tables, however deep
            merged = stored(seen.unionByName(front), "seen")
            for x in levels[:-1]:
                discard(x)
            levels = [merged]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``seed, id, depth, path``: of the shortest paths from a seed the first in dictionary order.

    Up to ``BROADCAST_EDGES`` distinct edges every task holds the graph and goes from seed to
    seed, so nothing but the result is written; beyond, levels of all seeds are joined at once.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    held = _lists(edges)
    if held is not None:
        run = lambda batches: _paths_of(held.value, batches, max_depth)
        return _dealt(seeds.select("id").distinct()).mapInArrow(run, "seed string, id string, depth int, path array<string>")
    front = stored(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.array("id").alias("path")).distinct(), "front")
    seen = front
    for depth in _steps(1, max_depth):
        step = front.join(edges, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("seed", "id", "depth").agg(F.min("path").alias("path"))
        front, n = _counted(best.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), "front")
        if not n:
            break
        before, seen = seen, stored(seen.unionByName(front), "seen")
        if depth > 1:
            discard(before)
    return seen


#: Rows of paths, and cells of seeds by nodes, that a task holds at once.
PATH_ROWS = 50_000
CELLS = 1 << 24


def _paths_of(g: _Lists, batches: Iterator[pa.RecordBatch], max_depth: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of ``shortest_paths`` from the seeds of some batches.

    A level is kept in the order of its paths, and ends of edges are in order: so what comes
    to a node first is its first path.
    """
    names = ["seed", "id", "depth", "path"]
    seen, first = np.full(len(g.ids), -1, np.int32), np.empty(len(g.ids), np.int32)
    held, rows, turn = [], 0, 0

    def sent() -> pa.RecordBatch:
        n = np.array([len(p) for _, p in held])
        depth = np.repeat([p.shape[1] - 1 for _, p in held], n)
        flat = np.concatenate([p.ravel() for _, p in held])
        ends = np.cumsum(depth + 1)
        path = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), g.ids.take(pa.array(flat)))
        return pa.record_batch([g.ids.take(pa.array(np.repeat([s for s, _ in held], n))), g.ids.take(pa.array(flat[ends - 1])), pa.array(depth, pa.int32()), path], names)

    for b in batches:
        seeds = b.column("id").cast(pa.string())
        at = g.numbers(seeds)
        alone = seeds.filter(pa.array(at < 0))
        if len(alone):
            yield pa.record_batch([alone, alone, pa.array(np.zeros(len(alone)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(alone) + 1), pa.int32()), alone)], names)
        for s in at[at >= 0]:
            turn += 1
            paths = np.array([[s]])
            seen[s] = turn
            for depth in count(0):
                # a deep level of many paths goes out in pieces
                most = max(1, 5 * PATH_ROWS // (depth + 1))
                for k in range(0, len(paths), most):
                    held.append((s, paths[k : k + most]))
                    rows += held[-1][1].size
                    if rows >= 5 * PATH_ROWS:
                        yield sent()
                        held, rows = [], 0
                if depth == max_depth:
                    break
                start, edge = g.steps(paths[:, -1])
                end = g.ends[edge]
                new = seen[end] != turn
                start, end = start[new], end[new]
                if not len(end):
                    break
                place = np.arange(len(end))
                first[end[::-1]] = place[::-1]
                new = first[end] == place
                paths = np.column_stack([paths[start[new]], end[new]])
                seen[end] = turn
    if held:
        yield sent()


def all_shortest_paths(edges: DataFrame, pairs: DataFrame, max_paths: int = 3, max_depth: int | None = None) -> DataFrame:
    """``src, dst, rank, path``: up to ``max_paths`` shortest paths per pair, in dictionary order (a top-k report).

    The first paths of a pair go through first paths of every node on the way, so no more
    than ``max_paths`` are kept per node; a seed is given up once all its pairs are found.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    wanted = stored(pairs.select("src", "dst").distinct(), "pairs")
    order = F.row_number().over(Window.partitionBy("seed", "id").orderBy("path"))
    front = stored(wanted.select(F.col("src").alias("seed"), F.col("src").alias("id"), F.array("src").alias("path")).distinct(), "front")
    seen = front.select("seed", "id")
    found = stored(wanted.limit(0).withColumn("path", F.array("src")), "found")
    for _ in _steps(1, max_depth):
        open_ = wanted.join(found.select("src", "dst"), ["src", "dst"], "left_anti").select(F.col("src").alias("seed")).distinct()
        step = front.join(open_, "seed", "left_semi").join(edges, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front, n = _counted(step.join(seen, ["seed", "id"], "left_anti").withColumn("r", order).filter(F.col("r") <= max_paths).drop("r"), "front")
        if not n:
            break
        seen = stored(seen.unionByName(front.select("seed", "id").distinct()), "seen")
        found = stored(found.unionByName(front.select(F.col("seed").alias("src"), F.col("id").alias("dst"), "path").join(wanted, ["src", "dst"], "left_semi")), "found")
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy("path"))
    return found.withColumn("rank", rank).select("src", "dst", "rank", "path")


def ego(edges: DataFrame, centres: DataFrame, hops: int = 2) -> DataFrame:
    """``seed, id, depth``: nodes within some hops, in either direction."""
    return closure(symmetric(edges), centres, hops)


#: Kinds of edges that are drawn; links and similarity are not followed.
STRUCTURAL = ("parent", "depends_on", "soft_depends_on", "contributes_to", "closes", "supersedes")


def ego_extract(edges: DataFrame, centres: DataFrame, hops: int = 2, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """``seed, id, depth`` and ``seed, source, target, type``: what is near each centre, itself at 0, and all edges within.

    ``edges``: ``source, target, type``. Only structural kinds are followed, for 1 to 5 hops; the
    ``most`` nearest nodes are drawn, ties by id (a drawing has room for so many).
    """
    drawn = edges.filter(F.col("type").isin(*STRUCTURAL)).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    near = ego(drawn, centres, min(max(hops, 1), 5)).unionByName(centres.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())
    nodes = stored(first_per_group(near, "seed", [F.col("depth"), F.col("id")], most), "ego")
    ends = nodes.select("seed", "id")
    within = edges.join(ends.select("seed", F.col("id").alias("source")), "source").join(ends.select("seed", F.col("id").alias("target")), ["seed", "target"], "left_semi")
    return nodes, within.select("seed", "source", "target", "type")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id of the component; isolated nodes are their own.

    Alternating large-star and small-star: rounds grow with the logarithm of the nodes, and
    what is kept is never more than the edges.
    """
    # a checksum of the links tells whether a round changed any of them
    sums = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("u", "v"))}
    links, seen = observed(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "links", **sums)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # a node smaller than all its neighbours keeps them
        large = stored(large, "large")
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup_join(large, own, ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        before, old = seen, links
        links, seen = observed(small, "links", **sums)
        discard(large)
        discard(old)
        if seen == before:
            break
    return nodes.select("id").distinct().join(links.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _contracted(left: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges that circles may use, and the nodes taken out of chains in each round (``id, u, w``).

    Nodes without a way in or out go; of nodes with one way in, from u, and one out, to w,
    those with the smallest hash among their neighbours of that kind are bridged by u to w.
    Trees and chains vanish in a number of rounds that is the logarithm of their size.
    """
    left, n = _counted(left, "left")
    taken, before = [], 0
    while n and n != before:
        ends = left.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("string").alias("u"), F.col("dst").alias("w"))
        ends = ends.unionByName(left.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("u"), F.lit(None).cast("string").alias("w")))
        nodes = stored(ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("u").alias("u"), F.min("w").alias("w")), "degrees")
        thin = nodes.filter("i = 1 AND o = 1").select("id", "u", "w", F.xxhash64("id").alias("h"))
        beside = thin.select("id", "h")
        near = thin.join(beside.select(F.col("id").alias("u"), F.col("h").alias("hu")), "u", "left").join(beside.select(F.col("id").alias("w"), F.col("h").alias("hw")), "w", "left")
        gone, k = _counted(near.filter("(hu IS NULL OR h < hu) AND (hw IS NULL OR h < hw)").select("id", "u", "w"), "gone")
        dead = nodes.filter("i = 0 OR o = 0").select("id").unionByName(gone.select("id"))
        kept = left.join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
        old, before = left, n
        left, n = _counted(kept.unionByName(gone.filter("u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"))).distinct(), "left")
        discard(old)
        if k:
            taken.append(gone)
    return left, taken


def _largest_reaching(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``id, c``: the largest id that reaches each node of ``start``, itself included.

    What is the largest for that id is so for all it is the largest of, so labels jump and
    the rounds are far fewer than the steps of the longest way.
    """

    def push(state: DataFrame) -> DataFrame:
        pushed = lookup_join(edges, state.select(F.col("id").alias("src"), "c"), ["src"]).groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("p"))
        step = state.join(pushed, "id", "left").select("id", F.col("c").alias("was"), F.greatest("c", F.coalesce("p", "c")).alias("c"))
        jump = lookup_join(step, state.select(F.col("id").alias("c"), F.col("c").alias("far")), ["c"], "left")
        best = F.greatest("c", F.coalesce("far", "c"))
        return jump.select("id", best.alias("c"), (best > F.col("was")).alias("moved"))

    return _until_still(stored(start.select("id", F.col("id").alias("c")), "colour"), push, "colour")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``id, component, size`` of nodes on circles (components of two nodes and more; loops do not count).

    Trees and chains are contracted first. Each node left takes the largest id that reaches
    it as colour; within a colour, the nodes that reach its owner are one component, taken
    out before the next round. What was contracted follows the two ends of its bridge.
    """
    left = stored(edges.select("src", "dst").filter("src <> dst").distinct(), "left")
    bridges: list[DataFrame] = []
    out = edges.sparkSession.createDataFrame([], "id string, component string")
    while True:
        left, taken = _contracted(left)
        bridges += taken
        if not left.take(1):
            break
        colour = _largest_reaching(left, left.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
        tint = colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), colour.select(F.col("id").alias("dst"), F.col("c").alias("c2"))
        # backwards within a colour: its owner is the largest of its nodes
        back = stored(lookup_join(lookup_join(left, tint[0], ["src"]), tint[1], ["dst"]).filter("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inner")
        reached = _largest_reaching(back, colour.select("id"))
        found = stored(reached.join(colour.withColumnRenamed("c", "owner"), "id").filter("c = owner").select("id", F.col("c").alias("component")), "found")
        out = stored(out.unionByName(found), "components")
        gone = found.select("id")
        left = stored(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "left")
    # whoever was never placed is a component of its own
    for taken in reversed(bridges):
        cu, cw = out.select(F.col("id").alias("u"), F.col("component").alias("cu")), out.select(F.col("id").alias("w"), F.col("component").alias("cw"))
        ends = taken.join(cu, "u", "left").join(cw, "w", "left").select("id", F.coalesce("cu", "u").alias("cu"), F.coalesce("cw", "w").alias("cw")).filter("cu = cw").select("id", F.col("cu").alias("component"))
        out = stored(out.unionByName(ends), "components")
    # an owner that was left over alone has its own id as component
    named = out.unionByName(out.select(F.col("component").alias("id"), "component")).distinct()
    size = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low")).filter("size > 1")
    return lookup_join(named, size, ["component"]).select("id", F.col("low").alias("component"), "size")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``id, pagerank``: fixed rounds, parallel edges counted, the mass of dead ends spread evenly."""
    ids = stored(nodes.select("id").distinct(), "ids")
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    flow = stored(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("w")), "flow")
    dead = stored(ids.join(out.select(F.col("src").alias("id")), "id", "left_anti"), "dead")
    rank = stored(ids.withColumn("r", F.lit(1.0 / n)), "rank")
    for _ in range(rounds):
        lost = rank.join(dead, "id", "left_semi").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        got = flow.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("r")).alias("g"))
        after = stored(ids.join(got, "id", "left").select("id", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("g", F.lit(0.0))).alias("r")), "rank")
        discard(rank)
        rank = after
    return rank.select("id", F.round("r", 6).alias("pagerank"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, betweenness``: exact and directed, parallel edges as parallel paths, over (n-1)(n-2).

    Up to ``BROADCAST_EDGES`` distinct edges the adjacency lists go to every task, which
    handles its sources one by one, level by level, and writes its sums as an array; beyond,
    levels of lots of sources are joined, and a lot leaves only its sums. Either way the work
    is that of nodes times edges.
    """
    ids = stored(nodes.select("id").distinct(), "ids")
    flow = stored(edges.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("int").alias("k")), "flow")
    n = ids.count()
    scale = 1.0 / max(1, (n - 1) * (n - 2))
    held = _lists(flow, "k")
    if held is not None:
        blocks = _dealt(ids).mapInArrow(lambda batches: _blocks(_leans(held.value, batches)), "block int, parts binary")
        per = blocks.repartition("block").mapInArrow(lambda batches: _summed(held.value.ids, batches), "id string, b double")
    else:
        lots = max(1, -(-n * n // LOT_ROWS))
        per = ids.select("id", F.lit(0.0).alias("b")).limit(0)
        for lot in range(lots):
            sources = ids.filter(F.pmod(F.xxhash64("id"), F.lit(lots)) == lot)
            before, per = per, stored(per.unionByName(_leans_by_joins(sources, flow)).groupBy("id").agg(F.sum("b").alias("b")), "leans")
            discard(before)
    return ids.join(per, "id", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)) * scale, 6).alias("betweenness"))


def _leans_by_joins(sources: DataFrame, flow: DataFrame) -> DataFrame:
    """``id, b``: shares of shortest paths from ``sources`` that go through each node; its tables are deleted."""
    front = stored(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("ways"), F.lit(0).alias("depth")), "front")
    levels, seen = [front], stored(front.select("s", "id"), "seen")
    while True:
        step = front.join(flow, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum(F.col("ways") * F.col("k")).alias("ways"))
        front = stored(step.join(seen, ["s", "id"], "left_anti").withColumn("depth", F.lit(len(levels))), "front")
        if not front.take(1):
            break
        before, seen = seen, stored(seen.unionByName(front.select("s", "id")), "seen")
        discard(before)
        levels.append(front)
    discard(seen)
    discard(front)
    lean, sums = None, stored(sources.select("id", F.lit(0.0).alias("b")).limit(0), "sums")
    for low, high in zip(levels[-2::-1], levels[:0:-1]):
        above = high.withColumn("lean", F.lit(0.0)) if lean is None else lean
        up = above.select("s", F.col("id").alias("dst"), F.col("ways").alias("w2"), "lean").join(flow, "dst").join(low.select("s", F.col("id").alias("src"), "ways"), ["s", "src"])
        part = up.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("ways") * F.col("k") / F.col("w2") * (1 + F.col("lean"))).alias("lean"))
        old, lean = lean, stored(low.join(part, ["s", "id"], "left").na.fill(0.0, ["lean"]), "lean")
        before, sums = sums, stored(sums.unionByName(lean.filter("s <> id").groupBy("id").agg(F.sum("lean").alias("b"))).groupBy("id").agg(F.sum("b").alias("b")), "sums")
        for x in (high, before, *([old] if old is not None else [])):
            discard(x)
    for x in (levels[0], *([lean] if lean is not None else [])):
        discard(x)
    return sums


#: Nodes in a block of sums.
BLOCK = 1 << 16


def _blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``block, parts``: sums by node, cut into blocks; those of zeros are left out."""
    for k in range(0, len(total), BLOCK):
        if total[k : k + BLOCK].any():
            yield pa.record_batch([pa.array([k // BLOCK], pa.int32()), pa.array([total[k : k + BLOCK].tobytes()], pa.binary())], ["block", "parts"])


def _summed(ids: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, b``: the blocks of all tasks added up."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column("block").to_pylist(), b.column("parts")):
            part = np.frombuffer(raw.as_buffer(), np.float64)
            sums[k] = sums[k] + part if k in sums else part
    for k, total in sums.items():
        some = np.flatnonzero(total)
        yield pa.record_batch([ids.take(pa.array(some + k * BLOCK)), pa.array(total[some])], ["id", "b"])


def _leaning(g: _Lists, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, part``: ``_leans``, where it is not 0."""
    total = _leans(g, batches)
    some = np.flatnonzero(total)
    if len(some):
        yield pa.record_batch([g.ids.take(pa.array(some)), pa.array(total[some])], ["id", "part"])


def _leans(g: _Lists, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """By node, shares of shortest paths from the sources of some batches that go through it."""
    n = len(g.ids)
    # a parallel edge is one more entry of its list
    begin, ends = np.append(0, np.cumsum(g.value))[g.begin], np.repeat(g.ends, g.value).astype(np.int32)
    g = _Lists(g.ids, begin.astype(np.int32), ends, None)
    total, seen, at, place = np.zeros(n), np.full(n, -1, np.int32), np.empty(n, np.int32), np.arange(1 << 16, dtype=np.int32)
    turn = 0
    for b in batches:
        for s in g.numbers(b.column("id").cast(pa.string())):
            if s < 0 or g.begin[s] == g.begin[s + 1]:
                continue
            turn += 1
            front, ways, levels = np.array([s], np.int32), np.ones(1), []
            seen[s] = turn
            while True:
                low = g.begin[front]
                many = g.begin[front + 1] - low
                upto = np.cumsum(many, dtype=np.int32)
                if max(upto[-1], len(front)) > len(place):
                    place = np.arange(2 * max(int(upto[-1]), len(front)), dtype=np.int32)
                end = ends[np.repeat(low - upto + many, many) + place[: upto[-1]]]
                new = np.flatnonzero(seen[end] != turn)
                if not len(new):
                    break
                # the edges to nodes not seen before are those of shortest paths
                start, end = np.repeat(place[: len(front)], many)[new], end[new]
                at[end] = place[: len(end)]
                after = end[at[end] == place[: len(end)]]
                seen[after] = turn
                at[after] = place[: len(after)]
                end = at[end]
                levels.append((front, ways, start, end))
                front, ways = after, np.bincount(end, ways[start], len(after))
            lean = np.zeros(len(front))
            for before, came, start, end in reversed(levels):
                total[front] += lean
                lean = came * np.bincount(start, ((1 + lean) / ways)[end], len(before))
                front, ways = before, came
    return total


def least_over_reach(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """``id, least``: the smallest value among a node and all it reaches, by rounds until nothing changes."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    state = stored(nodes.select("id", F.col(value).alias("least")), "state")

    def step(state: DataFrame) -> DataFrame:
        seen = lookup_join(edges, state.select(F.col("id").alias("dst"), "least"), ["dst"]).groupBy(F.col("src").alias("id")).agg(F.min("least").alias("m"))
        return state.join(seen, "id", "left").select("id", F.least("least", "m").alias("least"), (~F.least("least", "m").eqNullSafe(F.col("least"))).alias("moved"))

    return _until_still(state, step, "state")


def inherit(nodes: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """``id, inherited``: the nearest value upwards, own first, along ``links`` (``id, parent``); null on circles without one.

    Pointer jumping: the rounds are the logarithm of the deepest climb. Climbs of all lengths
    up to the deepest occur, so a round in which none ends leaves only circles.
    """
    state = stored(nodes.select("id", F.col(value).alias("v")).join(links.select("id", "parent"), "id", "left").select("id", "v", F.when(F.col("v").isNull(), F.col("parent")).alias("ptr")), "state")
    left, before = state.filter("ptr IS NOT NULL").count(), 0
    while left and left != before:
        up = state.select(F.col("id").alias("ptr"), F.col("v").alias("v2"), F.col("ptr").alias("p2"))
        moved = state.filter("ptr IS NOT NULL").join(up, "ptr", "left").select("id", F.col("v2").alias("v"), F.when(F.col("v2").isNull() & (F.col("p2") != F.col("id")), F.col("p2")).alias("ptr"))
        after = stored(state.filter("ptr IS NULL").unionByName(moved), "state")
        discard(state)
        state, before = after, left
        left = after.filter("ptr IS NOT NULL").count()
    return state.select("id", F.col("v").alias("inherited"))


def damped_sum(edges: DataFrame, base: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``id, total``: sum over what a node reaches of base x path factor / depth.

    ``edges``: ``src, dst, factor``; ``base``: ``id, base``. Among shortest paths the one
    with the largest product of factors counts. Up to ``BROADCAST_EDGES`` distinct edges every
    task holds the graph and only equal terms of a sum are written; beyond, levels are joined.
    """
    edges = stored(edges.groupBy("src", "dst").agg(F.max("factor").alias("factor")).filter("src <> dst"), "edges")
    held = _lists(edges, "factor")
    if held is not None:
        known = base.select("id", F.col("base").cast("double").alias("base")).join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").toArrow()
        bases = edges.sparkSession.sparkContext.broadcast((known["id"].combine_chunks(), known["base"].combine_chunks()))
        run = lambda batches: _terms(held.value, bases.value, batches, max_depth)
        terms = _dealt(edges.select(F.col("src").alias("id")).distinct()).mapInArrow(run, "id string, term double, n long")
        total = F.sum(F.col("term").cast("decimal(30,12)") * F.col("n").cast("decimal(7,0)"))
        return terms.groupBy("id").agg(F.round(total, 2).cast("double").alias("total"))
    front = stored(edges.select(F.col("src").alias("seed"), F.col("dst").alias("id"), "factor", F.lit(1).alias("depth")), "front")
    seen = front
    for depth in _steps(2, max_depth):
        step = front.join(edges.withColumnRenamed("factor", "f"), F.col("id") == F.col("src")).filter("seed <> dst").groupBy("seed", F.col("dst").alias("id")).agg(F.max(F.col("factor") * F.col("f")).alias("factor"))
        front, n = _counted(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if not n:
            break
        seen = stored(seen.unionByName(front), "seen")
    return seen.join(base, "id").groupBy(F.col("seed").alias("id")).agg(F.round(F.sum((F.col("base") * F.col("factor") / F.col("depth")).cast("decimal(30,12)")), 2).cast("double").alias("total"))


def _terms(g: _Lists, bases: tuple[pa.Array, pa.Array], batches: Iterator[pa.RecordBatch], max_depth: int | None) -> Iterator[pa.RecordBatch]:
    """``id, term, n``: the terms of ``damped_sum`` of the seeds of some batches, each with how often a seed has it at a depth.

    As many seeds at once as there is room to mark what each has seen.
    """
    nodes = len(g.ids)
    at = g.numbers(bases[0].cast(pa.string()))
    base, there = np.full(nodes, np.nan), np.zeros(nodes, bool)
    base[at[at >= 0]], there[at[at >= 0]] = pc.fill_null(bases[1], np.nan).to_numpy(zero_copy_only=False)[at >= 0], True
    width = max(1, CELLS // max(1, nodes))
    seen = np.zeros(width * nodes, bool)
    for b in batches:
        numbers = g.numbers(b.column("id").cast(pa.string()))
        for k in range(0, len(numbers), width):
            seeds = numbers[k : k + width]
            cell, factor, marked = np.arange(len(seeds)) * nodes + seeds, np.ones(len(seeds)), []
            seen[cell] = True
            for depth in _steps(1, max_depth):
                marked.append(cell)
                start, edge = g.steps(cell % nodes)
                to, got = cell[start] // nodes * nodes + g.ends[edge], factor[start] * g.value[edge]
                new = ~seen[to]
                to, got = to[new], got[new]
                if not len(to):
                    break
                # of several ways the largest product
                order = np.lexsort((got, to))
                to, got = to[order], got[order]
                last = np.append(to[1:] != to[:-1], True)
                cell, factor = to[last], got[last]
                seen[cell] = True
                mine = there[cell % nodes]
                seed, term = cell[mine] // nodes, base[cell[mine] % nodes] * factor[mine] / depth
                if len(seed):
                    order = np.lexsort((term, seed))
                    seed, term = seed[order], term[order]
                    begin = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (term[1:] != term[:-1])))
                    yield pa.record_batch([g.ids.take(pa.array(seeds[seed[begin]])), pa.array(term[begin], from_pandas=True), pa.array(np.diff(np.append(begin, len(seed))))], ["id", "term", "n"])
            for cells in marked:
                seen[cells] = False
            seen[cell] = False
