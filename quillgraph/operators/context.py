"""What surrounds a node: descendants, local context, trees in reading order, checks of proposed links, duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import graph, retrieval, stats
from quillgraph.plans.skew import lookup_join


def descendants_where(children: DataFrame, current: DataFrame, keep: Column, max_depth: int | None = None) -> DataFrame:
    """``seed, id, depth``: nodes beneath each node that satisfy ``keep``; those that do not are passed through.

    ``children``: ``src`` parent, ``dst`` child.
    """
    below = graph.closure(children, max_depth=max_depth)
    return below.join(current.filter(keep).select("id"), "id", "left_semi").select("seed", "id", "depth")


def closing_links(edges: DataFrame, proposed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``src, dst, path`` of proposed links that would close a circle: the way from ``dst`` back to ``src``.

    A link from a node to itself closes one with the path of that node.
    """
    ends = proposed.select(F.col("dst").alias("id")).distinct()
    back = graph.shortest_paths(edges, ends, max_depth).select(F.col("seed").alias("dst"), F.col("id").alias("src"), "path")
    return proposed.select("src", "dst").distinct().join(back, ["src", "dst"])


#: Kinds of neighbours, and the edge that makes them: from the node, or to it.
_AHEAD = {"parent": "parents", "depends_on": "needs", "contributes_to": "serves", "similar_to": "similar"}
_BEHIND = {"parent": "children", "depends_on": "waiting", "contributes_to": "served_by"}


def context_rows(edges: DataFrame, most: int = 5) -> DataFrame:
    """``id, kind, other, total``: what is around each node, all of it but for siblings and children, of which ``most``.

    Siblings are the other children of a node's parent, of several the first. They are read
    off the first children of each parent, so no two children ever meet.
    """
    out = edges.filter(F.col("type").isin(*_AHEAD)).select(F.col("source").alias("id"), F.coalesce(*[F.when(F.col("type") == t, n) for t, n in _AHEAD.items()]).alias("kind"), F.col("target").alias("other"))
    into = edges.filter(F.col("type").isin(*_BEHIND)).select(F.col("target").alias("id"), F.coalesce(*[F.when(F.col("type") == t, n) for t, n in _BEHIND.items()]).alias("kind"), F.col("source").alias("other"))
    every = out.unionByName(into)
    totals = every.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("total"))
    kids = into.filter("kind = 'children'")
    # one more than is shown, since a node is not its own sibling
    first = stats.first_per_group(kids, "id", [F.col("other")], most + 1)
    some = stats.first_per_group(kids, "id", [F.col("other")], most)
    up = edges.filter("type = 'parent'").groupBy(F.col("source").alias("id")).agg(F.min("target").alias("p"))
    heads = first.groupBy(F.col("id").alias("p")).agg(F.array_sort(F.collect_list("other")).alias("heads")).join(totals.filter("kind = 'children'").select(F.col("id").alias("p"), "total"), "p")
    beside = lookup_join(up, heads, ["p"]).select("id", F.lit("siblings").alias("kind"), F.explode(F.slice(F.filter("heads", lambda x: x != F.col("id")), 1, most)).alias("other"), (F.col("total") - 1).alias("total"))
    rest = every.filter("kind <> 'children'").unionByName(some.select("id", "kind", "other"))
    return lookup_join(rest, totals, ["id", "kind"]).select("id", "kind", "other", "total").unionByName(beside)


def local_context(edges: DataFrame, current: DataFrame, most: int = 5) -> DataFrame:
    """One row per node for display: the first ``most`` of each kind of neighbour, and how many there are."""
    some = stats.first_per_group(context_rows(edges, most).withColumn("g", F.concat_ws("\x1f", "kind", "id")), "g", [F.col("other")], most)
    near = some.groupBy("id", "kind").agg(F.array_sort(F.collect_list("other")).alias("some"), F.max("total").alias("n"))
    columns = []
    for name in [*_AHEAD.values(), *_BEHIND.values(), "siblings"]:
        columns += [F.first(F.when(F.col("kind") == name, F.col("some")), True).alias(name), F.coalesce(F.max(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}")]
    return current.select("id").join(near.groupBy("id").agg(*columns), "id", "left")


def reading_order(edges: DataFrame, tops: DataFrame, max_depth: int = 4) -> DataFrame:
    """``seed, id, depth, order``: what hangs from each top, depth first, each node where it is nearest.

    ``edges``: ``src, dst, rank`` (kinds in the order they are shown).
    """
    paths = graph.shortest_paths(edges.select("src", "dst"), tops, max_depth)
    rank = edges.groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    last = paths.select("seed", "id", "depth", "path", F.explode(F.when(F.size("path") > 1, F.sequence(F.lit(2), F.size("path"))).otherwise(F.array(F.lit(0)))).alias("i"))
    step = last.select("seed", "id", "depth", "i", F.when(F.col("i") > 0, F.element_at("path", F.greatest(F.col("i") - 1, F.lit(1)))).alias("src"), F.when(F.col("i") > 0, F.element_at("path", F.greatest(F.col("i"), F.lit(1)))).alias("dst"))
    keyed = step.join(rank, ["src", "dst"], "left").groupBy("seed", "id", "depth").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("dst", F.lit("")).alias("dst")))).alias("key"))
    return keyed.withColumn("order", F.row_number().over(Window.partitionBy("seed").orderBy("key"))).select("seed", "id", "depth", "order")


def duplicate_groups(rows: DataFrame, title: float = 0.7, semantic: float | None = None, key: str = "id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``id, group, size``: nodes joined by similar titles and, where ``semantic`` is set, similar vectors; groups of two and more."""
    linked, members = retrieval.title_links(rows, title, key, label)
    # a title is joined to its copies through one of them
    pairs = linked.select(F.col("na").alias("src"), F.col("nb").alias("dst")).unionByName(members.select(F.col("name").alias("src"), F.col(key).alias("dst")).filter("src <> dst"))
    if semantic is not None:
        near = retrieval.similarity_join(rows.select(key, vector), semantic, key, vector).filter("a <> b")
        # classes of equal vectors stand for all their members
        equal = rows.filter(F.col(vector).isNotNull()).groupBy(vector).agg(F.min(key).alias("name"))
        members = rows.join(equal, vector).select(F.col("name").alias("src"), F.col(key).alias("dst")).filter("src <> dst")
        pairs = pairs.unionByName(near.select(F.col("a").alias("src"), F.col("b").alias("dst"))).unionByName(members)
    parts = graph.connected_components(rows.select(F.col(key).alias("id")), pairs)
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return parts.join(size, "component").select("id", F.col("component").alias("group"), "size")


def cluster_scores(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``group, size, best, pairs``: the largest score between members of each group, and how many pairs scored. ``pairs``: ``a, b, score``."""
    of = groups.select(F.col("id").alias("a"), "group", "size")
    return pairs.join(of, "a").groupBy("group", "size").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("pairs"))


def canonical_members(groups: DataFrame, rows: DataFrame, created: Column, children: Column, words: Column) -> DataFrame:
    """``group, id``: the oldest (unknown counts as oldest), then more children, more words, the smallest id."""
    r = rows.select("id", created.alias("c"), children.alias("n"), words.alias("w"))
    best = F.struct(F.coalesce(F.col("c").cast("string"), F.lit("")).alias("c"), (-F.coalesce("n", F.lit(0))).alias("n"), (-F.coalesce("w", F.lit(0))).alias("w"), F.col("id"))
    return groups.join(r, "id").groupBy("group").agg(F.min(best).alias("b")).select("group", "b.id")


def without_reach(tops: DataFrame, children: DataFrame, hit: DataFrame) -> DataFrame:
    """Tops (column id) for which neither they nor anything beneath is among ``hit`` (column id)."""
    above = graph.spread(children.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hit)
    return tops.select("id").distinct().join(above, "id", "left_anti")


def spread_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id``: seeds and everything they reach along ``src, dst``: a mark that is handed on."""
    return graph.spread(edges, seeds)


def recall(entries: DataFrame, query: list[float], types: list[str], tags: list[str], k: int = 10, over: int = 3) -> DataFrame:
    """Search ``over * k`` first, then keep types and tags, then the first ``k``: the order in which the report is defined."""
    from quillgraph.operators.filters import tagged

    wide = retrieval.search(entries, query, k * over).select("entry_id", "score")
    rows = tagged(entries.filter(F.col("doc_type").isin(types)) if types else entries, tags).select("entry_id", "title", "doc_type").dropDuplicates(["entry_id"])
    return stats.top_by(wide.join(rows, "entry_id"), "score", k, "entry_id")


def append_block(body: Column, block: Column, stamp: Column, section: str | None = None) -> Column:
    """Body with a stamped block at the end, or at the end of the section with that heading where it exists."""
    piece = F.concat(F.lit("\n\n["), stamp, F.lit("] "), block, F.lit("\n"))
    trimmed = F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+$", "")
    if section is None:
        return F.concat(trimmed, piece)
    import re

    head = rf"(?ms)\A(.*?^#{{1,6}}[ \t]+{re.escape(section)}[ \t]*$.*?)(\s*)((?:^#{{1,6}}[ \t].*)?)\z"
    found = trimmed.rlike(head)
    rest = F.regexp_extract(trimmed, head, 3)
    return F.when(found, F.concat(F.regexp_extract(trimmed, head, 1), piece, F.when(rest == "", "").otherwise(F.concat(F.lit("\n"), rest)))).otherwise(F.concat(trimmed, F.lit(f"\n\n## {section}"), piece))
