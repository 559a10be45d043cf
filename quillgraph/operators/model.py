"""Nodes, resolved edges and what follows from them: the tables every graph operator takes.

``nodes``: one row per id (the state recorded last). ``edges``: distinct
``source, target, type`` with the target resolved to an id; loops and what resolves to
nothing are left out. Everything is joins and aggregations over long tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.refs import reference_key, strip_blanks
from quillgraph.functions.text import list_or_commas, markdown_links, wikilinks
from quillgraph.operators.references import node_keys
from quillgraph.plans.skew import lookup_join
from quillgraph.session import stored


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The state of each id recorded last; ties go to the one not deleted."""
    rest = [c for c in nodes.columns if c not in ("id", "recorded_at", "deleted_at")]
    state = F.struct("recorded_at", F.col("deleted_at").isNull().alias("live"), "deleted_at", *rest)
    return nodes.filter("id IS NOT NULL").groupBy("id").agg(F.max(state).alias("s")).select("id", "s.recorded_at", "s.deleted_at", *[f"s.{c}" for c in rest])


def resolution(current: DataFrame) -> DataFrame:
    """``key, id``: case-folded ids and permalinks; an id wins over a permalink, then the smallest id."""
    return node_keys(current.select("id", "permalink", "parent", "recorded_at")).select("key", "id")


def resolve(refs: DataFrame, column: str, keys: DataFrame, how: str = "inner", out: str = "resolved") -> DataFrame:
    """``refs`` with the id that ``column`` names."""
    return lookup_join(refs.withColumn("key", reference_key(F.col(column))), keys.withColumnRenamed("id", out), ["key"], how).drop("key")


def resolve_flexible(queries: DataFrame, current: DataFrame, column: str = "query") -> DataFrame:
    """Exact id, then alias, then without ``.md``, then file stem, then path: the first that matches."""
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.md$", "")
    kinds = F.array(*[F.struct(F.lit(p).alias("rank"), v.alias("key")) for p, v in enumerate([F.col("id"), F.lower(strip_blanks(F.col("permalink"))), F.lower("id"), F.lower(stem), F.lower("path")])])
    keys = current.select("id", F.explode(kinds).alias("k")).select("id", "k.rank", "k.key").filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("rank", "id")).alias("b")).select("key", "b.rank", "b.id")
    raw = F.col(column)
    tries = F.explode(F.array_distinct(F.array(raw, F.lower(raw), F.regexp_replace(F.lower(raw), r"\.md$", ""), reference_key(raw)))).alias("key")
    return queries.select(column, tries).join(keys, "key").groupBy(column).agg(F.min(F.struct("rank", "id")).alias("b")).select(column, "b.id")


def resolved_edges(edges: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct ``source, target, type`` between existing nodes, without loops."""
    rows = resolve(edges.select("source", "type", "target"), "target", resolution(current), out="to")
    return rows.filter("source <> to").select("source", F.col("to").alias("target"), "type").distinct()


def ghosts(edges: DataFrame, current: DataFrame) -> DataFrame:
    """``id, node_type, references``: what is referred to and is no node; the type is read off the prefix."""
    keys = resolution(current)
    missing = edges.select(reference_key(F.col("target")).alias("key")).filter("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("references")).join(keys, "key", "left_anti")
    kind = F.expr("CASE WHEN key LIKE 'epic-%' OR key LIKE 'proj%-%' THEN 'epic' WHEN key LIKE 'goal-%' OR key LIKE 'targ%-%' THEN 'goal' WHEN key LIKE 'task-%' THEN 'task' WHEN key LIKE 'pr-%' THEN 'pr' END")
    return missing.select(F.col("key").alias("id"), kind.alias("node_type"), "references")


def inverses(edges: DataFrame) -> DataFrame:
    """Per node the sorted sources of each kind of edge that ends there."""
    by = lambda t: F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("source"))))
    return edges.groupBy(F.col("target").alias("id")).agg(by("parent").alias("children"), by("depends_on").alias("blocks"), by("soft_depends_on").alias("soft_blocks"), by("contributes_to").alias("contributed_by"))


def leaves(current: DataFrame, edges: DataFrame, subtask: str = r"^(.+)\.(\d+)$") -> DataFrame:
    """``id, children, subtasks, leaf``: numbers of children apart from subtasks (``<id>.n``), of subtasks, and whether there are no children."""
    kids = edges.filter("type = 'parent'").select(F.col("target").alias("id"), (F.regexp_extract("source", subtask, 1) == F.col("target")).alias("sub"))
    per = kids.groupBy("id").agg(F.count_if(~F.col("sub")).alias("children"), F.count_if("sub").alias("subtasks"))
    return current.select("id").join(per, "id", "left").na.fill(0, ["children", "subtasks"]).withColumn("leaf", F.col("children") == 0)


#: Fields of frontmatter that name other notes, the edge they make, and whether it points back.
FIELDS = {
    "parent": ("parent", False), "depends_on": ("depends_on", False), "soft_depends_on": ("soft_depends_on", False), "contributes_to": ("contributes_to", False),
    "closes": ("closes", False), "supersedes": ("supersedes", False), "children": ("parent", True), "blocks": ("depends_on", True), "soft_blocks": ("soft_depends_on", True),
}


def document_edges(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """``source, target, type``: edges that documents write into frontmatter (``FIELDS``) and, as links, into their bodies.

    ``keys``: see ``resolution``. Loops and what names nothing are left out; each edge comes once.
    """
    named = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(back).alias("back"), list_or_commas(F.get_json_object("frontmatter", f"$.{f}")).alias("refs")) for f, (t, back) in FIELDS.items()])
    links = F.array(F.struct(F.lit("link").alias("type"), F.lit(False).alias("back"), F.concat(wikilinks(F.col("body")), markdown_links(F.col("body"))).alias("refs")))
    refs = documents.select("id", F.explode(F.concat(named, links)).alias("f")).select("id", "f.type", "f.back", F.explode("f.refs").alias("ref")).distinct()
    found = resolve(stored(refs, "refs"), "ref", keys, out="to")
    ends = found.select(F.when(F.col("back"), F.col("to")).otherwise(F.col("id")).alias("source"), F.when(F.col("back"), F.col("id")).otherwise(F.col("to")).alias("target"), "type")
    return ends.filter("source <> target").distinct()


def task_index(current: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """``id, parent, children, depends_on, blocks, similar, state``: relations seen from both ends, sorted.

    ``similar`` holds either way round; ``states``: ``id, state``.
    """
    both = edges.filter("type = 'similar_to'")
    ends = edges.select(F.col("source").alias("id"), F.concat(F.lit(">"), "type").alias("kind"), F.col("target").alias("other")).unionByName(edges.filter("type <> 'similar_to'").select(F.col("target").alias("id"), F.concat(F.lit("<"), "type").alias("kind"), F.col("source").alias("other")))
    ends = ends.unionByName(both.select(F.col("target").alias("id"), F.lit(">similar_to").alias("kind"), F.col("source").alias("other")))
    by = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("other"))))
    per = ends.groupBy("id").agg(F.min(F.when(F.col("kind") == ">parent", F.col("other"))).alias("parent"), by("<parent").alias("children"), by(">depends_on").alias("depends_on"), by("<depends_on").alias("blocks"), by(">similar_to").alias("similar"))
    return current.select("id").join(per, "id", "left").join(states, "id", "left")


def degrees(current: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree; parallel edges of different types all count."""
    ends = edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    per = ends.groupBy("id").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    return current.select("id").join(per, "id", "left").na.fill(0, ["indegree", "outdegree"])


def backlinks_by_type(current: DataFrame, edges: DataFrame) -> DataFrame:
    """How many nodes of each type point at each node."""
    return edges.join(current.select(F.col("id").alias("source"), F.coalesce("node_type", F.lit("none")).alias("source_type")), "source").groupBy(F.col("target").alias("id"), "source_type").agg(F.countDistinct("source").alias("sources"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in either direction; where both hold, the outgoing side is named."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), F.lit(0).alias("d")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), F.lit(1).alias("d")))
    return both.groupBy("id", "neighbour").agg(F.min("d").alias("d")).select("id", "neighbour", F.when(F.col("d") == 0, "out").otherwise("in").alias("side"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among ``kept`` (column id)."""
    ends = kept.select("id").distinct()
    return edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "type")


def roots(current: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent that exists."""
    return current.select("id").join(edges.filter("type = 'parent'").select(F.col("source").alias("id")).distinct(), "id", "left_anti")


def orphans(current: DataFrame, edges: DataFrame, needs_parent: tuple[str, ...] = ("task", "epic", "learn", "pr")) -> DataFrame:
    """Nodes without a parent that are of a type that needs one, or are touched by no edge at all but similarity."""
    lone = roots(current, edges).join(current.select("id", "node_type"), "id")
    touched = edges.filter("type <> 'similar_to'").select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("touched", F.lit(True))
    return lone.join(touched, "id", "left").filter(F.coalesce(F.col("node_type").isin(*needs_parent), F.lit(False)) | F.col("touched").isNull()).select("id", "node_type")
