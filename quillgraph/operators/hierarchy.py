"""Parent links to full hierarchies: path, depth, root, everything beneath, circles.

Deterministic hash splitters cut every long climb into short segments:

1. every node walks to its next stop above (a splitter or a root); the walk doubles its
   stride, so the rounds are the logarithm of the longest segment, and it carries the ids
   passed, whose number is bounded by the splitter spacing times ln(n);
2. the splitters alone, with their next stops, are a graph ``spacing`` times smaller; it is
   solved by pointer doubling (root, distance, and sizes of whole subtrees);
3. the segments are expanded with the solution: depth and root of every node, exact paths,
   and the number of nodes beneath each.

What never reaches a root lies on a circle or hangs from one. Those nodes, whether or not
their circle has a splitter, are solved apart: circles by doubling and a running minimum,
what hangs from them by the same three steps with the circle's nodes as roots.

Every round ends as a table in the shared folder, so plans stay short, a lost executor
costs one round, and a round's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.refs import reference_key
from quillgraph.operators.references import holding_state, node_keys
from quillgraph.plans.skew import LIGHT, lookup_join
from quillgraph.session import discard, observed, stored

SPACING = 8


def resolved_parents(nodes: DataFrame) -> DataFrame:
    """``id, parent`` with the parent's id, null where the written parent names no node."""
    states = stored(holding_state(nodes).select("id", "parent", "permalink", "recorded_at"))
    wanted = states.select("id", reference_key(F.col("parent")).alias("key"))
    keys = node_keys(states).select("key", F.col("id").alias("parent"))
    found = lookup_join(wanted.filter("key != ''"), keys, ["key"], "left").select("id", "parent")
    return found.unionByName(wanted.filter("key = ''").select("id", F.lit(None).cast("string").alias("parent")))


def _double(state: DataFrame, left: int) -> DataFrame:
    """The ``left`` unfinished rows of ``state`` with the rows they point at (``n_...``).

    Very wide nodes make hot pointers, so from ``LIGHT`` rows on the join is salted.
    """
    far = state.filter("NOT done")
    ahead = state.select(F.col("id").alias("ptr"), *[F.col(c).alias(f"n_{c}") for c in state.columns if c != "id"])
    return lookup_join(far, ahead, ["ptr"]) if left > LIGHT else far.join(ahead, "ptr")


def _round(df: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The table of a round and how many of its rows are not ``done``; the table before it is deleted."""
    out, seen = observed(df, "round", left=F.count_if(~F.col("done")))
    if before is not None:
        discard(before)
    return out, seen["left"]


def _next(before: DataFrame, after: DataFrame) -> DataFrame:
    """The table of the next round; that of the last one is deleted."""
    out = stored(after)
    discard(before)
    return out


def walk_to_stops(links: DataFrame, spacing: int = SPACING) -> DataFrame:
    """``id, ptr, hops, trail, done``: the next stop strictly above each node.

    ``trail`` holds the node itself and what it passes, without the stop. A root has a null
    ``ptr`` and is done with 0 hops. Rows still not done lead into a splitterless circle.
    """
    is_stop = F.pmod(F.xxhash64("id"), F.lit(spacing)) == 0
    stops = links.select(F.col("id").alias("parent"), (is_stop | F.col("parent").isNull()).alias("pstop"))
    at = lookup_join(links.select("id", "parent"), stops, ["parent"], "left")
    state, left = _round(at.select("id", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("hops"), F.array("id").alias("trail"), F.coalesce("pstop", F.lit(True)).alias("done")))
    while left:
        step = _double(state, left).select("id", F.col("n_ptr").alias("ptr"), (F.col("hops") + F.col("n_hops")).alias("hops"), F.concat("trail", "n_trail").alias("trail"), F.col("n_done").alias("done"))
        before = left
        state, left = _round(state.filter("done").unionByName(step), state)
        if left == before:  # distances to a stop have no gaps: nothing more will finish
            break
    return state


def _solve_reduced(reduced: DataFrame) -> DataFrame:
    """Pointer doubling over stops: ``id, root, dist, size`` for those that reach a root.

    ``reduced``: ``id, ptr, hops, weight``; ``size`` sums the weights of a stop and all stops beneath.
    """
    state, left = _round(reduced.select("id", "ptr", "hops", F.col("weight").alias("size"), F.col("ptr").isNull().alias("done"), F.col("id").alias("root")))
    while left:
        beneath = state.filter("NOT done").groupBy("ptr").agg(F.sum("size").alias("more")).withColumnRenamed("ptr", "id")
        moved = _double(state, left).select("id", F.col("n_ptr").alias("ptr"), (F.col("hops") + F.col("n_hops")).alias("hops"), "size", F.col("n_ptr").isNull().alias("done"), F.when(F.col("n_ptr").isNull(), F.col("n_root")).alias("root"))
        both = state.filter("done").unionByName(moved)
        before = left
        state, left = _round(both.join(beneath, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"), state)
        if left == before:
            break
    return state.filter("done").select("id", "root", F.col("hops").alias("dist"), "size")


def solve_forest(links: DataFrame, spacing: int = SPACING) -> DataFrame:
    """``id, root, depth, below, trail, stop`` for every node of ``links`` that reaches a root."""
    walked = walk_to_stops(links, spacing)
    ended = walked.filter("done")
    is_stop = (F.pmod(F.xxhash64("id"), F.lit(spacing)) == 0) | F.col("ptr").isNull()
    own = ended.filter(~is_stop).groupBy(F.col("ptr").alias("id")).agg(F.count(F.lit(1)).alias("w"))
    reduced = ended.filter(is_stop).select("id", "ptr", "hops").join(own, "id", "left").select("id", "ptr", "hops", (F.coalesce("w", F.lit(0)) + 1).alias("weight"))
    solved = _solve_reduced(reduced)
    tops = solved.select(F.col("id").alias("stop"), "root", "dist")
    stops = ended.filter(is_stop)
    low = lookup_join(ended.filter(~is_stop).withColumn("stop", F.col("ptr")), tops, ["stop"]).select("id", "root", (F.col("hops") + F.col("dist")).alias("depth"), "trail", "stop", F.lit(1).cast("bigint").alias("weight"))
    high = stops.join(solved, "id").select("id", "root", F.col("dist").alias("depth"), "trail", F.col("ptr").alias("stop"), F.col("size").alias("weight"))
    placed = stored(low.unionByName(high))
    sizes = placed.select(F.explode("trail").alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("size"))
    return placed.join(sizes, "id").select("id", "root", "depth", (F.col("size") - 1).alias("below"), "trail", "stop")


def circles(links: DataFrame) -> DataFrame:
    """``id, root, size`` of every node on a circle, for links none of which leads to a root.

    Doubling carries the smallest id passed. Once the stride is no less than the number of
    nodes, every pointer ends on a circle, and what a node of a circle has passed is all of it.
    """
    state, seen = observed(links.select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")), "ring", n=F.count(F.lit(1)))
    n, stride = seen["n"], 1
    if not n:
        return links.sparkSession.createDataFrame([], "id string, root string, size bigint")
    while stride < n:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("far"))
        step = lookup_join(state, ahead, ["ptr"]) if n > LIGHT else state.join(ahead, "ptr")
        state, stride = _next(state, step.select("id", F.col("next").alias("ptr"), F.least("low", "far").alias("low"))), stride * 2
    ring = state.join(state.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi").select("id", "low")
    members = ring.groupBy("low").agg(F.count(F.lit(1)).alias("size"))
    return ring.join(members, "low").select("id", F.col("low").alias("root"), "size")


def on_circles(links: DataFrame) -> DataFrame:
    """``id, root, size`` of nodes on circles of two and more, for any links (``id, parent``); trees are walked off first."""
    walked = walk_to_stops(links)
    reduced = walked.filter("done").select("id", "ptr", "hops", F.lit(1).cast("bigint").alias("weight"))
    rest = links.join(_solve_reduced(reduced).select("id"), "id", "left_anti")
    return circles(stored(rest, "rest")).filter("size > 1")


def hierarchy(links: DataFrame, spacing: int = SPACING) -> DataFrame:
    """One row per id of ``links`` (``id, parent``; parents null or themselves ids).

    ``root, depth, below, trail, stop, kind``: kind is ``tree``, ``circle`` (depth -1) or
    ``hanging`` (depth -2); the root of the last two is the smallest id on the circle.
    ``below`` counts the other nodes reachable downwards. ``trail`` and ``stop`` are the
    path segment upwards and where the path goes on. Null ids are ignored; of repeated ids
    one row must be given; an empty table gives an empty result.
    """
    links = stored(links)
    tree = stored(solve_forest(links, spacing))
    out = tree.select("id", "root", F.col("depth").cast("int").alias("depth"), F.col("below").cast("int").alias("below"), "trail", "stop", F.lit("tree").alias("kind"))
    rest = stored(links.join(tree.select("id"), "id", "left_anti"))
    if not rest.take(1):
        return out
    ring = stored(circles(rest))
    cutoff = rest.join(ring.select("id", F.lit(True).alias("on")), "id", "left").select("id", F.when(F.col("on").isNull(), F.col("parent")).alias("parent"))
    hung = stored(solve_forest(cutoff, spacing))
    reach = hung.join(ring.select(F.col("id").alias("root"), F.col("root").alias("low")), "root")
    total = reach.groupBy("low").agg((F.count(F.lit(1)) - 1).alias("others"))
    rings = reach.filter("depth = 0").join(total, "low").select("id", F.col("low").alias("root"), F.lit(-1).alias("depth"), F.col("others").cast("int").alias("below"), "trail", "stop", F.lit("circle").alias("kind"))
    hanging = reach.filter("depth > 0").select("id", F.col("low").alias("root"), F.lit(-2).alias("depth"), F.col("below").cast("int").alias("below"), "trail", "stop", F.lit("hanging").alias("kind"))
    return out.unionByName(rings).unionByName(hanging)


def _paths(solved: DataFrame) -> DataFrame:
    """``solved`` with ``path``: from where the climb ends, a root or a node of a circle, down to each node.

    Stops put their segments together by doubling, so the rounds are the logarithm of the
    stops on the longest path; one last join adds every node's own segment. The output
    itself has as many ids as the depths sum to.
    """
    used = solved.select(F.col("stop").alias("id")).filter("id IS NOT NULL").distinct()
    state, left = _round(solved.join(used, "id", "left_semi").select("id", F.col("stop").alias("ptr"), "trail", F.col("stop").isNull().alias("done")))
    while left:
        step = _double(state, left).select("id", F.col("n_ptr").alias("ptr"), F.concat("trail", "n_trail").alias("trail"), F.col("n_ptr").isNull().alias("done"))
        state, left = _round(state.filter("done").unionByName(step), state)
    above = state.select(F.col("id").alias("stop"), F.col("trail").alias("rest"))
    return lookup_join(solved, above, ["stop"], "left").select("id", "root", "depth", F.reverse(F.concat("trail", F.coalesce("rest", F.array().cast("array<string>")))).alias("path"))


def full_paths(solved: DataFrame) -> DataFrame:
    """``id, root, depth, path``: the exact path from the root down to each node of a tree."""
    return _paths(solved.filter("kind = 'tree'").select("id", "root", "depth", "trail", "stop"))


def all_paths(solved: DataFrame) -> DataFrame:
    """``full_paths`` of every node: what hangs from a circle has the path from its node of the circle, which alone is its own."""
    return _paths(solved.select("id", "root", "depth", "trail", "stop"))


def _beneath(paths: DataFrame) -> DataFrame:
    steps = F.size("path") - 1
    return paths.filter(steps > 0).select("id", steps.alias("deep"), F.posexplode(F.slice("path", F.lit(1), steps)).alias("at", "ancestor")).select("ancestor", "id", (F.col("deep") - F.col("at")).cast("int").alias("steps"))


def descendants(solved: DataFrame) -> DataFrame:
    """``ancestor, id, steps``: every node beneath every node of a tree, as rows."""
    return _beneath(full_paths(solved))


def all_descendants(solved: DataFrame, links: DataFrame) -> DataFrame:
    """``descendants`` of every node, at the least steps: circles and what hangs from them count as in ``below``.

    A circle is cut at its smallest id and solved as a chain, which gives the steps from each
    of its nodes to every other. The output has as many rows as ``below`` sums to.
    """
    paths = stored(all_paths(solved), "paths")
    ring = solved.filter("kind = 'circle'").select("id", "root")
    if not ring.take(1):
        return _beneath(paths)
    chain = links.join(ring, "id").select("id", F.when(F.col("id") != F.col("root"), F.col("parent")).alias("parent"))
    size = F.count(F.lit(1)).over(Window.partitionBy("root"))
    placed = stored(solve_forest(stored(chain, "chain")).select("id", "root", F.col("depth").alias("place"), size.alias("members")), "ring")
    held = paths.filter("depth < 0").select("id", F.get("path", F.lit(0)).alias("own"), (F.size("path") - 1).alias("deep"))
    at = held.join(placed.select(F.col("id").alias("own"), "root", "place"), "own")
    over = placed.select(F.col("id").alias("ancestor"), "root", F.col("place").alias("top"), "members")
    around = at.join(over, "root").filter("ancestor <> own").select("ancestor", "id", (F.pmod(F.col("place") - F.col("top"), F.col("members")) + F.col("deep")).cast("int").alias("steps"))
    return _beneath(paths).unionByName(around)
