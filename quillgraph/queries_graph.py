"""Queries of the graph, retrieval, quality and statistics operators, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.functions.duck import EDGES, KEYS, NODES, key
from quillgraph.functions.refs import reference_key
from quillgraph.functions.vectors import normalised
from quillgraph.operators import changes, context, filters, graph, model, quality, retrieval, stats
from quillgraph.operators.chunkers import chunked
from quillgraph.operators.filters import FilterSet
from quillgraph.session import stored, table
from quillgraph.streaming.telemetry import windowed

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split("\n"))
        return f

    return add


_N, _K, _E = NODES, KEYS, EDGES
BASE = f"{_N}, {_K}, {_E}"


def levels(n: int, first: str, step: str) -> str:
    """``f0 AS (first), f1 AS (step), ...``: rounds of SQL written out, each over the one before (``{k}``, ``{j}`` = k - 1)."""
    return ", ".join(f"f{k} AS MATERIALIZED ({(step if k else first).format(k=k, j=k - 1)})" for k in range(n + 1))


def every(n: int, columns: str, first: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM f{k}" for k in range(first, n + 1))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return model.current_nodes(table(spark, sf, "graph_nodes"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return model.resolved_edges(table(spark, sf, "edges"), _nodes(spark, sf))


def _links(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    e = _edges(spark, sf)
    return (e.filter(F.col("type").isin(*types)) if types else e).select(F.col("source").alias("src"), F.col("target").alias("dst"))


# ---- model and joins


@query(f"WITH {BASE} SELECT source, target, type FROM e")
def g1_edges(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {_N}, {_K} SELECT r.key AS id, CASE WHEN r.key LIKE 'epic-%' OR r.key LIKE 'proj%-%' THEN 'epic' WHEN r.key LIKE 'goal-%' OR r.key LIKE 'targ%-%' THEN 'goal' WHEN r.key LIKE 'task-%' THEN 'task' WHEN r.key LIKE 'pr-%' THEN 'pr' END AS node_type, r.n AS references FROM (SELECT {key('target')} AS key, count(*) AS n FROM edges GROUP BY 1) r WHERE r.key <> '' AND r.key NOT IN (SELECT key FROM k)")
def g2_ghosts(spark, sf):
    return model.ghosts(table(spark, sf, "edges"), _nodes(spark, sf))


@query(f"WITH {BASE} SELECT target AS id, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (type = 'parent')), ','), '') AS children, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (type = 'depends_on')), ','), '') AS blocks, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (type = 'contributes_to')), ','), '') AS contributed_by FROM e GROUP BY target")
def g3_inverses(spark, sf):
    i = model.inverses(_edges(spark, sf))
    return i.select("id", *[F.array_join(c, ",").alias(c) for c in ("children", "blocks", "contributed_by")])


@query(f"WITH {BASE} SELECT n.id, coalesce(i.d, 0) AS indegree, coalesce(o.d, 0) AS outdegree FROM n LEFT JOIN (SELECT target, count(*) AS d FROM e GROUP BY 1) i ON i.target = n.id LEFT JOIN (SELECT source, count(*) AS d FROM e GROUP BY 1) o ON o.source = n.id")
def a4_degrees(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    return model.degrees(n, model.resolved_edges(table(spark, sf, "edges"), n))


@query(f"WITH {BASE} SELECT e.target AS id, coalesce(n.node_type, 'none') AS source_type, count(DISTINCT e.source) AS sources FROM e JOIN n ON n.id = e.source GROUP BY 1, 2")
def j11_backlinks(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    return model.backlinks_by_type(n, model.resolved_edges(table(spark, sf, "edges"), n))


@query(f"WITH {BASE} SELECT id, neighbour, CASE WHEN min(d) = 0 THEN 'out' ELSE 'in' END AS side FROM (SELECT source AS id, target AS neighbour, 0 AS d FROM e UNION ALL SELECT target, source, 1 FROM e) GROUP BY 1, 2")
def f10_neighbours(spark, sf):
    return model.neighbours(_edges(spark, sf))


@query(f"WITH {_N}, {_K} SELECT f.req_id, d.ref, k.id FROM (SELECT DISTINCT req_id, unnest(depends_on) AS ref FROM doc_fields) d JOIN k ON {key('d.ref')} = k.key JOIN (SELECT DISTINCT req_id FROM doc_fields) f ON f.req_id = d.req_id")
def j1_resolved_references(spark, sf):
    refs = table(spark, sf, "doc_fields").select("req_id", F.explode("depends_on").alias("ref")).distinct()
    return model.resolve(refs, "ref", model.resolution(_nodes(spark, sf)), out="id").select("req_id", "ref", "id")


@query(f"WITH {BASE} SELECT n.id FROM n WHERE n.id NOT IN (SELECT source FROM e WHERE type = 'parent')")
def g16_roots(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    return model.roots(n, model.resolved_edges(table(spark, sf, "edges"), n))


@query(f"WITH {BASE}, touched AS (SELECT source AS id FROM e WHERE type <> 'similar_to' UNION SELECT target FROM e WHERE type <> 'similar_to') SELECT n.id, n.node_type FROM n WHERE n.id NOT IN (SELECT source FROM e WHERE type = 'parent') AND (coalesce(n.node_type IN ('task', 'epic', 'learn', 'pr'), false) OR n.id NOT IN (SELECT id FROM touched))")
def g13_orphans(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    return model.orphans(n, model.resolved_edges(table(spark, sf, "edges"), n))


@query(f"WITH {BASE}, q AS (SELECT DISTINCT source FROM e WHERE type = 'supersedes') SELECT e.source, e.target, e.type FROM e WHERE e.source IN (SELECT source FROM q) AND e.target IN (SELECT source FROM q)")
def j10_induced_edges(spark, sf):
    e = stored(_edges(spark, sf), "edges")
    return model.induced(e, e.filter("type = 'supersedes'").select(F.col("source").alias("id")))


# ---- graph


@query(f"WITH RECURSIVE {BASE}, d AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE type = 'depends_on'), c AS (SELECT src AS seed, dst AS id, 1 AS depth FROM d UNION SELECT c.seed, d.dst, c.depth + 1 FROM c JOIN d ON d.src = c.id) SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM c WHERE seed <> id GROUP BY 1, 2")
def g4_dependency_closure(spark, sf):
    return graph.closure(_links(spark, sf, "depends_on"))


@query(f"WITH RECURSIVE {BASE}, d AS (SELECT DISTINCT target AS src, source AS dst FROM e WHERE type = 'depends_on'), c AS (SELECT src AS seed, dst AS id, 1 AS depth FROM d UNION SELECT c.seed, d.dst, c.depth + 1 FROM c JOIN d ON d.src = c.id WHERE c.depth < 3) SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM c WHERE seed <> id GROUP BY 1, 2")
def g5_blocks_closure(spark, sf):
    """Within three steps, the default of the report."""
    e = _links(spark, sf, "depends_on")
    return graph.closure(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth=3)


@query(f"WITH RECURSIVE {BASE}, d AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE type IN ('parent', 'contributes_to', 'closes')), c AS (SELECT src AS seed, dst AS id FROM d UNION SELECT c.seed, d.dst FROM c JOIN d ON d.src = c.id) SELECT seed AS id, array_to_string(list_sort(list(DISTINCT id)), ',') AS ancestors FROM c WHERE seed <> id GROUP BY 1")
def g19_target_ancestors(spark, sf):
    c = graph.closure(_links(spark, sf, "parent", "contributes_to", "closes"))
    return c.groupBy(F.col("seed").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(c["id"])), ",").alias("ancestors"))


@query(f"WITH RECURSIVE {BASE}, u AS (SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e), s AS (SELECT DISTINCT target AS id FROM e WHERE type = 'supersedes'), c AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT c.seed, u.dst, c.depth + 1 FROM c JOIN u ON u.src = c.id WHERE c.depth < 2) SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2 HAVING seed <> id")
def g11_ego(spark, sf):
    """Two hops around every node that was superseded."""
    e = stored(_edges(spark, sf), "edges")
    links = e.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return graph.ego(links, e.filter("type = 'supersedes'").select(F.col("target").alias("id")), 2)


@query(f"WITH RECURSIVE {BASE}, u AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE type IN ('supersedes', 'closes') UNION SELECT target, source FROM e WHERE type IN ('supersedes', 'closes')), c AS (SELECT id, id AS r FROM n UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.r) SELECT id, min(r) AS component FROM c GROUP BY id")
def g14_components(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n).filter("type IN ('supersedes', 'closes')")
    return graph.connected_components(n, e.select(F.col("source").alias("src"), F.col("target").alias("dst")))


@query(f"WITH RECURSIVE {BASE}, u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), c AS (SELECT id, id AS r FROM n UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.r) SELECT id, min(r) AS component FROM c GROUP BY id")
def g14_all_components(spark, sf):
    """Over edges of every kind, where ``g14_components`` follows two."""
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n)
    return graph.connected_components(n, e.select(F.col("source").alias("src"), F.col("target").alias("dst")))


_RANKS = levels(
    20,
    "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n",
    "SELECT n.id, (0.15 + 0.85 * (SELECT coalesce(sum(r), 0) FROM f{j} WHERE id NOT IN (SELECT src FROM o))) / (SELECT count(*) FROM n) + 0.85 * coalesce(g.g, 0) AS r FROM n LEFT JOIN (SELECT w.dst AS id, sum(w.w * f{j}.r) AS g FROM w JOIN f{j} ON f{j}.id = w.src GROUP BY 1) g ON g.id = n.id",
)


@query(f"WITH {BASE}, o AS (SELECT source AS src, count(*) AS k FROM e GROUP BY 1), w AS (SELECT e.source AS src, e.target AS dst, count(*)::DOUBLE / any_value(o.k) AS w FROM e JOIN o ON o.src = e.source GROUP BY 1, 2), {_RANKS} SELECT id, round(r, 6) AS pagerank FROM f20")
def g23_pagerank(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n)
    return graph.pagerank(n, e.select(F.col("source").alias("src"), F.col("target").alias("dst")))


#: Rounds of SQL, more than the longest of the shortest ways in the smallest tables.
_FAR = 40
_WAYS = levels(
    _FAR,
    "SELECT id AS s, id, 1.0::DOUBLE AS ways FROM n",
    "SELECT s, id, sum(ways) AS ways FROM (SELECT f{j}.s, w.dst AS id, f{j}.ways * w.k AS ways FROM f{j} JOIN w ON w.src = f{j}.id) x WHERE NOT EXISTS (SELECT 1 FROM seen{j} z WHERE z.s = x.s AND z.id = x.id) GROUP BY 1, 2), seen{k} AS MATERIALIZED (SELECT s, id FROM seen{j} UNION ALL SELECT s, id FROM f{k}",
).replace(", f1 AS", ", seen0 AS (SELECT s, id FROM f0), f1 AS", 1)
_LEANS = ", ".join(
    f"b{k} AS MATERIALIZED (SELECT f{k}.s, f{k}.id, any_value(f{k}.ways) AS ways, "
    + (f"coalesce(sum(f{k}.ways * w.k / b{k + 1}.ways * (1 + b{k + 1}.lean)), 0) AS lean FROM f{k} LEFT JOIN w ON w.src = f{k}.id LEFT JOIN b{k + 1} ON b{k + 1}.s = f{k}.s AND b{k + 1}.id = w.dst" if k < _FAR else f"0.0::DOUBLE AS lean FROM f{k}")
    + " GROUP BY 1, 2)"
    for k in range(_FAR, 0, -1)
)


@query(f"WITH {BASE}, w AS (SELECT source AS src, target AS dst, count(*) AS k FROM e GROUP BY 1, 2), {_WAYS}, {_LEANS} SELECT n.id, round(coalesce(x.b, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 6) AS betweenness FROM n LEFT JOIN (SELECT id, sum(lean) AS b FROM ({' UNION ALL '.join(f'SELECT id, lean FROM b{k}' for k in range(1, _FAR + 1))}) GROUP BY 1) x ON x.id = n.id")
def g24_betweenness(spark, sf):
    """Over edges of every kind; edges of several kinds between two nodes are parallel paths."""
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n)
    return graph.betweenness(n, e.select(F.col("source").alias("src"), F.col("target").alias("dst")))


@query(f"WITH RECURSIVE {BASE}, d AS (SELECT DISTINCT target AS src, source AS dst FROM e WHERE type = 'depends_on'), c AS (SELECT id, id AS r FROM n UNION SELECT c.id, d.dst FROM c JOIN d ON d.src = c.r) SELECT c.id, min(n.priority) AS least FROM c JOIN n ON n.id = c.r GROUP BY c.id")
def g28_least_priority(spark, sf):
    """The most urgent priority among a node and all that wait for it."""
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n).filter("type = 'depends_on'")
    return graph.least_over_reach(n, e.select(F.col("target").alias("src"), F.col("source").alias("dst")), "priority")


@query(f"WITH RECURSIVE {_N}, {_K}, p AS (SELECT n.id, k.id AS parent, n.project FROM n LEFT JOIN k ON {key('n.parent')} = k.key AND {key('n.parent')} <> ''), c AS (SELECT id, id AS at, project, parent, 0 AS depth FROM p UNION ALL SELECT c.id, p.id, p.project, p.parent, c.depth + 1 FROM c JOIN p ON p.id = c.parent WHERE c.project IS NULL AND c.depth < 3000) SELECT id, max(project) AS inherited FROM c GROUP BY id")
def g21_inherited_project(spark, sf):
    from quillgraph.operators.hierarchy import resolved_parents

    return graph.inherit(stored(_nodes(spark, sf), "nodes"), resolved_parents(table(spark, sf, "graph_nodes")), "project")


_DOWN = levels(
    40,
    "SELECT src AS seed, dst AS id, factor FROM d",
    "SELECT seed, id, max(factor) AS factor FROM (SELECT f{j}.seed, d.dst AS id, f{j}.factor * d.factor AS factor FROM f{j} JOIN d ON d.src = f{j}.id WHERE f{j}.seed <> d.dst) x WHERE NOT EXISTS (SELECT 1 FROM seen{j} s WHERE s.seed = x.seed AND s.id = x.id) GROUP BY 1, 2), seen{k} AS MATERIALIZED (SELECT seed, id FROM seen{j} UNION ALL SELECT seed, id FROM f{k}",
).replace(", f1 AS", ", seen0 AS (SELECT seed, id FROM f0), f1 AS", 1)


@query(f"WITH {BASE}, d AS (SELECT target AS src, source AS dst, max(CASE type WHEN 'depends_on' THEN 1.0 WHEN 'soft_depends_on' THEN 0.3 ELSE 0.5 END)::DOUBLE AS factor FROM e WHERE type IN ('depends_on', 'soft_depends_on', 'parent') GROUP BY 1, 2), {_DOWN} SELECT x.seed AS id, CAST(round(sum(CAST(greatest(0, 5 - coalesce(n.priority, 4)) * x.factor / x.depth AS DECIMAL(30,12))), 2) AS DOUBLE) AS total FROM ({' UNION ALL '.join(f'SELECT seed, id, factor, {k + 1} AS depth FROM f{k}' for k in range(41))}) x JOIN n ON n.id = x.id GROUP BY 1")
def g27_downstream_weight(spark, sf):
    """What hangs on a node: priorities of what it leads to, damped by kind of edge and distance."""
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n)
    factor = F.when(F.col("type") == "depends_on", 1.0).when(F.col("type") == "soft_depends_on", 0.3).when(F.col("type") == "parent", 0.5)
    down = e.withColumn("factor", factor).filter("factor IS NOT NULL").select(F.col("target").alias("src"), F.col("source").alias("dst"), "factor")
    return graph.damped_sum(down, n.select("id", F.greatest(F.lit(0), 5 - F.coalesce("priority", F.lit(4))).cast("double").alias("base")))


_NEAR4 = levels(
    4,
    "SELECT DISTINCT target AS seed, target AS id, [target] AS path FROM e WHERE type = 'supersedes'",
    "SELECT seed, id, min(path) AS path FROM (SELECT f{j}.seed, u.dst AS id, list_append(f{j}.path, u.dst) AS path FROM f{j} JOIN u ON u.src = f{j}.id) x WHERE NOT EXISTS (SELECT 1 FROM seen{j} s WHERE s.seed = x.seed AND s.id = x.id) GROUP BY 1, 2), seen{k} AS MATERIALIZED (SELECT seed, id FROM seen{j} UNION ALL SELECT seed, id FROM f{k}",
).replace(", f1 AS", ", seen0 AS (SELECT seed, id FROM f0), f1 AS", 1)


@query(f"WITH {BASE}, u AS (SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e), {_NEAR4} SELECT seed, id, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM ({every(4, 'seed, id, path')})")
def g9_shortest_paths(spark, sf):
    """From every superseded node to all within four steps, over edges of any kind."""
    e = stored(_edges(spark, sf), "edges")
    links = graph.symmetric(e.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    top = e.filter("type = 'supersedes'").select(F.col("target").alias("id")).distinct()
    return graph.shortest_paths(links, top, 4).select("seed", "id", "depth", F.array_join("path", ">").alias("path"))


# ---- filters, lists, sorts


@query(f"WITH {_N} SELECT id, label, priority FROM n WHERE status = 'ready' AND priority >= 2 AND list_contains(tags, 'urgent') AND lower(project) IN ('proj-capture', 'proj-atlas', 'proj-elm') ")
def f2_filter_set(spark, sf):
    f = FilterSet(status="ready", priority_gte=2, tags=("urgent",), project=("proj-capture", "PROJ-ATLAS", "proj-elm"))
    return f.apply(_nodes(spark, sf)).select("id", "label", "priority")


@query(f"WITH {_N} SELECT id FROM n WHERE coalesce(date_diff('day', try_cast(substr(created, 1, 10) AS DATE), DATE '2025-06-01') >= 365, true) AND contains(lower(label), 'notes')")
def f2_older_than(spark, sf):
    from datetime import date

    return FilterSet(older_than_days=365, title_contains="Notes", as_of=date(2025, 6, 1)).apply(_nodes(spark, sf)).select("id")


@query("SELECT DISTINCT id, title FROM pkb_documents WHERE len(list_filter(tags, lambda x: lower(x) IN ('urgent', 'pattern'))) > 0 AND lower(doc_type) = 'task'")
def f3_list_documents(spark, sf):
    d = table(spark, sf, "pkb_documents")
    return filters.list_documents(d, ["Urgent", "pattern"], "TASK").select("id", "title").distinct()


@query("SELECT DISTINCT id FROM pkb_documents WHERE len(list_filter(tags, lambda x: lower(x) = 'urgent')) > 0 AND len(list_filter(tags, lambda x: lower(x) = 'log')) > 0")
def f4_all_tags(spark, sf):
    return filters.tagged(table(spark, sf, "pkb_documents"), ["urgent", "Log"]).select("id").distinct()


@query("SELECT action, count(*) AS n FROM (SELECT d.id AS d, CASE WHEN d.id IS NULL THEN 'delete' WHEN i.id IS NULL THEN 'embed' WHEN coalesce(i.chunks, 0) = 0 THEN 'embed' WHEN d.f IS NOT DISTINCT FROM i.f THEN 'keep' WHEN d.b IS NOT DISTINCT FROM i.b THEN 'metadata' ELSE 'embed' END AS action FROM (SELECT id, min(file_hash) AS f, min(content_hash) AS b FROM pkb_documents GROUP BY id) d FULL JOIN (SELECT id, min(file_hash) AS f, min(body_hash) AS b, max(len(chunk_embeddings)) AS chunks FROM document_entries GROUP BY id) i ON d.id = i.id) GROUP BY action")
def j12_reconcile(spark, sf):
    d = table(spark, sf, "pkb_documents").groupBy("id").agg(F.min("file_hash").alias("file_hash"), F.min("content_hash").alias("body_hash"))
    i = table(spark, sf, "document_entries").groupBy("id").agg(F.min("file_hash").alias("file_hash"), F.min("body_hash").alias("body_hash"), F.max(F.size("chunk_embeddings")).alias("chunks"))
    return retrieval.reconcile(d, i).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS entries, count(*) FILTER (coalesce(len(chunk_embeddings), 0) = 0) AS without_chunks FROM (SELECT DISTINCT entry_id, chunk_embeddings FROM document_entries)")
def f13_missing_embeddings(spark, sf):
    e = table(spark, sf, "document_entries").select("entry_id", "chunk_embeddings").distinct()
    return e.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.coalesce(F.size("chunk_embeddings"), F.lit(0)) <= 0).alias("without_chunks"))


@query(f"WITH {_N} SELECT id, word_count FROM n ORDER BY word_count DESC NULLS LAST, id LIMIT 20")
def r10_top_words(spark, sf):
    return stats.top_by(_nodes(spark, sf), "word_count", 20).select("id", "word_count")


@query(f"WITH {_N} SELECT project, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY coalesce(priority, 4), id) AS r FROM n WHERE project IS NOT NULL) WHERE r <= 5")
def w1_first_per_project(spark, sf):
    n = _nodes(spark, sf).filter("project IS NOT NULL")
    return stats.first_per_group(n, "project", [F.coalesce("priority", F.lit(4)), F.col("id")], 5).select("project", "id", "priority")


# ---- aggregations


@query(f"WITH {BASE} SELECT *, round(edges / greatest(nodes, 1), 4) AS mean_degree FROM (SELECT count(*) AS nodes, count(deleted_at) AS deleted, count(node_type) AS typed, count(*) FILTER (parent IS NULL AND project IS NULL) AS loose, count(DISTINCT project) AS projects FROM n), (SELECT count(*) AS edges, count(DISTINCT type) AS edge_types, count(*) FILTER (type = 'parent') AS parent_edges FROM e)")
def a1_graph_stats(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    return stats.graph_stats(n, model.resolved_edges(table(spark, sf, "edges"), n))


@query(f"WITH {_N} SELECT 'status' AS column, coalesce(status, '(null)') AS value, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'node_type', coalesce(node_type, '(null)'), count(*) FROM n GROUP BY 2 UNION ALL SELECT 'priority', coalesce(CAST(priority AS VARCHAR), '(null)'), count(*) FROM n GROUP BY 2")
def a1_distribution(spark, sf):
    return stats.distribution(_nodes(spark, sf), ["status", "node_type", "priority"])


@query("SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pkb_documents) GROUP BY 1")
def a2_tag_frequency(spark, sf):
    return stats.tag_frequency(table(spark, sf, "pkb_documents"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, CAST(floor(avg(value)) AS BIGINT) AS mean, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def a3_rollup(spark, sf):
    return stats.rollup(table(spark, sf, "events"), "event_type", "value", "error")


@query("SELECT label, array_to_string(list(m ORDER BY i), ',') AS centroid FROM (SELECT label, i, CAST(CAST(round(avg(CAST(x AS DOUBLE)) * 1000) AS BIGINT) AS VARCHAR) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def a5_centroids(spark, sf):
    """Means in thousandths, as text."""
    flat = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")) * 1000).cast("bigint").cast("string").alias("m"))
    return flat.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]), ",").alias("centroid"))


@query("SELECT event_type, max(value) FILTER (k = CAST(round((n - 1) * 0.5) AS BIGINT)) AS p50, max(value) FILTER (k = CAST(round((n - 1) * 0.95) AS BIGINT)) AS p95, max(value) FILTER (k = CAST(round((n - 1) * 0.99) AS BIGINT)) AS p99, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1")
def a13_percentiles(spark, sf):
    return stats.percentiles(table(spark, sf, "events"), "event_type", "value")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_windowed_events(spark, sf):
    """An extension: tumbling days, the same operator on tables and streams."""
    return windowed(table(spark, sf, "events"))


@query("SELECT source, target, type, min(edge_id) AS edge_id FROM edges GROUP BY 1, 2, 3")
def a14_distinct_edges(spark, sf):
    return table(spark, sf, "edges").groupBy("source", "target", "type").agg(F.min("edge_id").alias("edge_id"))


# ---- retrieval


@query("SELECT query, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 10")
def r6_nearest(spark, sf):
    """The ten nearest of every row whose id divides by 20, among all rows."""
    e = table(spark, sf, "embeddings")
    return retrieval.nearest(e, e.filter("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 5))


@query("SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35")
def j6_within(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.within(e, e.filter("vec_id % 20 = 0"), 0.35).withColumn("score", F.round("score", 5))


_CLASSES = "v AS (SELECT embedding, CAST(embedding AS DOUBLE[]) AS e, min(vec_id) AS name, count(DISTINCT vec_id) AS n FROM embeddings GROUP BY 1)"


@query(f"WITH {_CLASSES} SELECT a.name AS a, b.name AS b, round(list_cosine_similarity(a.e, b.e), 5) AS score FROM v a JOIN v b ON a.name < b.name WHERE list_cosine_similarity(a.e, b.e) >= 0.35 UNION ALL SELECT name, name, 1.0 FROM v WHERE n > 1")
def j6_similarity_join(spark, sf):
    """All pairs of classes of equal vectors from a threshold on; at 0.85, the default, these vectors have none."""
    return retrieval.similarity_join(table(spark, sf, "embeddings"), 0.35).withColumn("score", F.round("score", 5))


@query("SELECT DISTINCT m.name, e.vec_id AS member FROM embeddings e JOIN (SELECT embedding, min(vec_id) AS name FROM embeddings GROUP BY 1) m ON m.embedding = e.embedding")
def j6_members(spark, sf):
    """Rows of equal vectors, under the name that ``j6_similarity_join`` has for them."""
    return retrieval.equal_classes(table(spark, sf, "embeddings"))


@query("SELECT entry_id, score FROM (SELECT entry_id, round(max(list_cosine_similarity(CAST(v AS DOUBLE[]), [0.6, 0.0, 0.8])), 4) AS score FROM (SELECT entry_id, unnest(chunk_embeddings) AS v FROM (SELECT DISTINCT entry_id, chunk_embeddings, modified FROM document_entries WHERE substr(modified, 1, 10) >= '2024-01-01')) GROUP BY 1) ORDER BY score DESC, entry_id LIMIT 50")
def v1_search(spark, sf):
    e = table(spark, sf, "document_entries")
    e = e.dropDuplicates(["entry_id"])
    return retrieval.search(e, [0.6, 0.0, 0.8], 50, since="2024-01-01", digits=4).select("entry_id", "score")


@query(f"WITH {_N}, w AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(label, '')), '\\s+'), lambda x: x <> ''))) AS s FROM n) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM w a JOIN w b ON a.id < b.id WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.7")
def j9_title_pairs(spark, sf):
    return retrieval.title_pairs(_nodes(spark, sf))


_TOP10 = "t AS (SELECT query, vec_id, rank FROM (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 10)"


@query(f"WITH {_TOP10}, s AS (SELECT label, count(DISTINCT vec_id) AS n FROM embeddings GROUP BY 1), h AS (SELECT t.query, min(t.rank) AS first, count(*) AS hits FROM t JOIN embeddings a ON a.vec_id = t.query JOIN embeddings b ON b.vec_id = t.vec_id WHERE a.label = b.label GROUP BY 1), q AS (SELECT e.vec_id AS query, s.n - 1 AS wanted FROM embeddings e JOIN s ON s.label = e.label WHERE e.vec_id % 20 = 0 AND s.n > 1) SELECT count(*) AS queries, round(avg(coalesce(1.0 / h.first, 0)), 6) AS mrr, round(avg(coalesce(h.hits / q.wanted, 0)), 6) AS recall, round(avg(CASE WHEN h.hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM q LEFT JOIN h ON h.query = q.query")
def v14_evaluate(spark, sf):
    """Nearest neighbours as results; what was wanted are the other rows of the same label."""
    e = table(spark, sf, "embeddings")
    got = retrieval.nearest(e, e.filter("vec_id % 20 = 0"), 10).select("query", F.col("vec_id").alias("id"), "rank")
    labels = e.select(F.col("vec_id").alias("id"), "label").distinct()
    return retrieval.evaluate_labels(got, labels.filter("id % 20 = 0").withColumnRenamed("id", "query"), labels)


@query("SELECT id, concat_ws(chr(10) || chr(10), title, 'type: ' || doc_type, CASE WHEN len(tags) > 0 THEN 'tags: ' || array_to_string(tags, ', ') END, nullif(body, '')) AS text FROM (SELECT DISTINCT id, title, doc_type, tags, body FROM pkb_documents)")
def v4_embedding_text(spark, sf):
    d = table(spark, sf, "pkb_documents").select("id", "title", "doc_type", "tags", "body").distinct()
    return d.select("id", t.embedding_text(F.col("title"), F.col("doc_type"), F.col("tags"), F.col("body")).alias("text"))


@query()
def v5_markdown_chunks(spark, sf):
    d = table(spark, sf, "pkb_documents").select("id", "body").distinct()
    return d.select("id", F.posexplode(chunked(F.col("body"))).alias("chunk_idx", "text"))


@query()
def v6_fixed_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(chunked(F.col("text"), "fixed")).alias("chunk_idx", "text"))


@query("SELECT vec_id, CAST(round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 3) AS DOUBLE) AS before, 1.0::DOUBLE AS after FROM embeddings")
def v3_normalised(spark, sf):
    from quillgraph.functions.vectors import norm

    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 3).alias("before"), F.round(norm(normalised(F.col("embedding"))), 3).alias("after"))


# ---- text


@query("SELECT DISTINCT id, unnest(list_filter(list_transform(regexp_extract_all(body, '\\[\\[([^\\]|#\\n]+)', 1), lambda x: trim(x)), lambda x: x <> '')) AS link FROM pkb_documents WHERE body IS NOT NULL")
def x_wikilinks(spark, sf):
    return table(spark, sf, "pkb_documents").select("id", F.explode(t.wikilinks(F.col("body"))).alias("link")).distinct()


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '(?:^|\\s)#(\\p{L}[\\p{L}\\p{N}_-]*)', 1)) AS tag FROM documents")
def x_hashtags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(t.hashtags(F.col("text"))).alias("tag")).distinct()


@query("SELECT DISTINCT id, regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pkb_documents")
def x_slugs(spark, sf):
    return table(spark, sf, "pkb_documents").select("id", t.slugify(F.col("title"), 1_000_000).alias("slug")).distinct()


@query(f"WITH {_N} SELECT id, effort, CAST(ceil(CASE WHEN NOT regexp_matches(s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)[hdw]?$') THEN NULL WHEN s LIKE '%w' THEN 7 * x WHEN s LIKE '%h' THEN x / 8 ELSE x END) AS BIGINT) AS days FROM (SELECT *, lower(trim(effort)) AS s, TRY_CAST(regexp_replace(lower(trim(effort)), '[hdw]$', '') AS DOUBLE) AS x FROM n)")
def x_effort_days(spark, sf):
    return _nodes(spark, sf).select("id", "effort", t.effort_days(F.col("effort")).alias("days"))


@query("SELECT DISTINCT doc_id, sha256(replace(text, chr(13), '')) AS hash FROM documents")
def x_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.content_hash(F.col("text")).alias("hash")).distinct()


@query("SELECT DISTINCT id, json_extract_string(frontmatter, '$.id') AS fm_id, json_extract_string(frontmatter, '$.title') AS fm_title FROM pkb_documents")
def f1_frontmatter(spark, sf):
    d = table(spark, sf, "pkb_documents")
    return d.select("id", F.get_json_object("frontmatter", "$.id").alias("fm_id"), F.get_json_object("frontmatter", "$.title").alias("fm_title")).distinct()


# ---- quality


@query("SELECT rule, count(*) AS n FROM (SELECT DISTINCT path, 'doc-no-type' AS rule FROM pkb_documents WHERE trim(coalesce(doc_type, '')) = '' UNION ALL SELECT DISTINCT path, 'task-no-status' FROM pkb_documents WHERE trim(coalesce(status, '')) = '' UNION ALL SELECT DISTINCT path, 'fm-missing-project' FROM pkb_documents WHERE trim(coalesce(project, '')) = '' UNION ALL SELECT DISTINCT path, 'md-no-final-newline' FROM pkb_documents WHERE length(body) > 0 AND NOT ends_with(body, chr(10))) GROUP BY 1")
def l_lint_counts(spark, sf):
    report = quality.lint(table(spark, sf, "pkb_documents"), ["no_type", "no_status", "no_project", "no_final_newline"])
    return report.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_N} SELECT id FROM n WHERE {key('parent')} = lower(id)")
def l_self_parents(spark, sf):
    return quality.self_parents(_nodes(spark, sf), reference_key)


# ---- changes and sets


@query(f"WITH {_N} SELECT id, 'update' AS action, 'priority' AS field, CAST(priority AS VARCHAR) AS old, CAST(least(coalesce(priority, 4), 2) AS VARCHAR) AS new FROM n WHERE CAST(priority AS VARCHAR) IS DISTINCT FROM CAST(least(coalesce(priority, 4), 2) AS VARCHAR)")
def u_priority_changes(spark, sf):
    return changes.set_field(_nodes(spark, sf), "priority", F.least(F.coalesce("priority", F.lit(4)), F.lit(2)))


@query("WITH m AS (SELECT DISTINCT id, recorded_at, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS r FROM (SELECT DISTINCT id, recorded_at FROM graph_nodes)) SELECT id, recorded_at FROM m WHERE r = 1")
def u_latest_states(spark, sf):
    return changes.latest(table(spark, sf, "graph_nodes").select("id", "recorded_at"), "id", "recorded_at")


@query("SELECT DISTINCT d.cluster_id, d.id, c.canonical AS survivor FROM duplicate_entries d JOIN (SELECT DISTINCT cluster_id, canonical FROM duplicate_clusters) c ON c.cluster_id = d.cluster_id WHERE c.canonical IS NOT NULL AND d.id <> c.canonical")
def u_merge_plan(spark, sf):
    c = table(spark, sf, "duplicate_clusters").select("cluster_id", F.col("canonical").alias("survivor")).filter("survivor IS NOT NULL").distinct()
    return table(spark, sf, "duplicate_entries").select("cluster_id", "id").distinct().join(c, "cluster_id").filter("id <> survivor")


@query("SELECT c AS id FROM (SELECT DISTINCT id AS c FROM document_entries) WHERE c NOT IN (SELECT id FROM pkb_documents)")
def u7_tombstones(spark, sf):
    return table(spark, sf, "document_entries").select("id").distinct().join(table(spark, sf, "pkb_documents").select("id"), "id", "left_anti")


@query("SELECT DISTINCT id, round(0.9 * exp(-0.05 * greatest(date_diff('day', try_cast(substr(created, 1, 10) AS DATE), DATE '2025-06-01'), 0)), 6) AS weight FROM graph_nodes WHERE try_cast(substr(created, 1, 10) AS DATE) IS NOT NULL")
def g36_decay(spark, sf):
    day = t.day_prefix(F.col("created"))
    n = table(spark, sf, "graph_nodes").select("id", day.alias("d")).filter("d IS NOT NULL")
    return n.select("id", F.round(changes.decayed(F.lit(0.9), F.col("d"), F.lit("2025-06-01").cast("date")), 6).alias("weight")).distinct()


# ---- context


@query(f"WITH RECURSIVE {BASE}, c AS (SELECT DISTINCT target AS src, source AS dst FROM e WHERE type = 'parent'), r AS (SELECT src AS seed, dst AS id FROM c UNION SELECT r.seed, c.dst FROM r JOIN c ON c.src = r.id) SELECT seed, r.id FROM r JOIN n ON n.id = r.id WHERE seed <> r.id AND n.deleted_at IS NULL")
def g6_live_descendants(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n).filter("type = 'parent'")
    return context.descendants_where(e.select(F.col("target").alias("src"), F.col("source").alias("dst")), n, F.col("deleted_at").isNull()).select("seed", "id")


@query(f"WITH {BASE}, x AS (SELECT source AS id, target AS other, type AS kind FROM e UNION ALL SELECT target, source, '<' || type FROM e), s AS (SELECT a.source AS id, b.source AS other FROM (SELECT source, min(target) AS target FROM e WHERE type = 'parent' GROUP BY 1) a JOIN e b ON b.target = a.target AND b.source <> a.source WHERE b.type = 'parent'), c AS (SELECT id, count(*) FILTER (kind = 'parent') AS p, count(*) FILTER (kind = '<parent') AS k, count(*) FILTER (kind = 'depends_on') AS d, count(*) FILTER (kind = '<depends_on') AS w, array_to_string(list_sort(list(other) FILTER (kind = 'parent'))[1:5], ',') AS ps FROM x GROUP BY id) SELECT n.id, c.p AS n_parents, c.k AS n_children, c.d AS n_needs, c.w AS n_waiting, (SELECT count(*) FROM s WHERE s.id = n.id) AS n_siblings, nullif(c.ps, '') AS parents FROM n JOIN c ON c.id = n.id WHERE c.p + c.k + c.d + c.w > 0")
def g42_local_context(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    c = context.local_context(model.resolved_edges(table(spark, sf, "edges"), n), n)
    some = c.filter("n_parents + n_children + n_needs + n_waiting > 0")
    return some.select("id", "n_parents", "n_children", "n_needs", "n_waiting", "n_siblings", F.array_join("parents", ",").alias("parents"))


@query(f"WITH RECURSIVE {BASE}, c AS (SELECT DISTINCT target AS src, source AS dst FROM e WHERE type = 'parent'), t AS (SELECT id FROM n WHERE node_type = 'epic'), r AS (SELECT id AS seed, id FROM t UNION SELECT r.seed, c.dst FROM r JOIN c ON c.src = r.id), h AS (SELECT DISTINCT e.source AS id FROM e JOIN n ON n.id = e.target WHERE e.type = 'contributes_to' AND n.node_type IN ('target', 'goal')) SELECT id FROM t WHERE id NOT IN (SELECT seed FROM r WHERE id IN (SELECT id FROM h))")
def g40_disconnected_epics(spark, sf):
    n = stored(_nodes(spark, sf), "nodes")
    e = stored(model.resolved_edges(table(spark, sf, "edges"), n), "edges")
    kids = e.filter("type = 'parent'").select(F.col("target").alias("src"), F.col("source").alias("dst"))
    aims = n.filter("node_type IN ('target', 'goal')").select(F.col("id").alias("target"))
    hit = e.filter("type = 'contributes_to'").join(aims, "target", "left_semi").select(F.col("source").alias("id"))
    return context.without_reach(n.filter("node_type = 'epic'").select("id"), kids, hit)


@query(f"WITH RECURSIVE {BASE}, d AS (SELECT DISTINCT target AS src, source AS dst FROM e WHERE type = 'depends_on'), r AS (SELECT id FROM n WHERE status = 'blocked' UNION SELECT d.dst FROM r JOIN d ON d.src = r.id) SELECT DISTINCT id FROM r")
def g17_held_up(spark, sf):
    """Blocked nodes and all that wait for them, directly or not."""
    n = stored(_nodes(spark, sf), "nodes")
    e = model.resolved_edges(table(spark, sf, "edges"), n).filter("type = 'depends_on'")
    return context.spread_from(e.select(F.col("target").alias("src"), F.col("source").alias("dst")), n.filter("status = 'blocked'").select("id"))


@query(f"WITH RECURSIVE {_N}, w AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(label, '')), '\\s+'), lambda x: x <> ''))) AS s FROM n), j AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id < b.id WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.7), u AS (SELECT a, b FROM j UNION SELECT b, a FROM j), c AS (SELECT DISTINCT a AS id, a AS r FROM u UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.r), m AS (SELECT id, min(r) AS g FROM c GROUP BY id), z AS (SELECT m.id, m.g, count(*) OVER (PARTITION BY m.g) AS size, row_number() OVER (PARTITION BY m.g ORDER BY coalesce(n.created, ''), -coalesce(n.word_count, 0), m.id) AS r FROM m JOIN n ON n.id = m.id) SELECT z.id, z.g AS \"group\", z.size, y.id AS canonical FROM z JOIN z y ON y.g = z.g AND y.r = 1")
def g38_duplicate_groups(spark, sf):
    """Nodes joined by similar titles, with the one to keep."""
    n = stored(_nodes(spark, sf), "nodes")
    groups = stored(context.duplicate_groups(n), "groups")
    best = context.canonical_members(groups, n, F.col("created"), F.lit(0), F.col("word_count"))
    return groups.join(best.select("group", F.col("id").alias("canonical")), "group").select("id", "group", "size", "canonical")


_TREE4 = levels(
    4,
    "SELECT id AS seed, id, [id] AS path FROM tp",
    "SELECT seed, id, min(path) AS path FROM (SELECT f{j}.seed, t.dst AS id, list_append(f{j}.path, t.dst) AS path FROM f{j} JOIN t ON t.src = f{j}.id) x WHERE NOT EXISTS (SELECT 1 FROM seen{j} s WHERE s.seed = x.seed AND s.id = x.id) GROUP BY 1, 2), seen{k} AS MATERIALIZED (SELECT seed, id FROM seen{j} UNION ALL SELECT seed, id FROM f{k}",
).replace(", f1 AS", ", seen0 AS (SELECT seed, id FROM f0), f1 AS", 1)


@query(
    f"WITH {BASE}, t AS (SELECT target AS src, source AS dst, min(CASE type WHEN 'depends_on' THEN 0 WHEN 'soft_depends_on' THEN 1 ELSE 2 END) AS rank FROM e WHERE type IN ('depends_on', 'soft_depends_on', 'parent') GROUP BY 1, 2), tp AS (SELECT id FROM n WHERE id NOT IN (SELECT source FROM e WHERE type = 'parent') AND id IN (SELECT src FROM t) AND id NOT IN (SELECT dst FROM t)), {_TREE4},"
    f" st AS (SELECT seed, id, path, unnest(range(2, len(path) + 1)) AS i FROM ({every(4, 'seed, id, path', 1)})), ky AS (SELECT st.seed, st.id, CAST(len(any_value(st.path)) - 1 AS INTEGER) AS depth, list({{'i': i, 'rank': t.rank, 'dst': t.dst}} ORDER BY i) AS key FROM st JOIN t ON t.src = st.path[i - 1] AND t.dst = st.path[i] GROUP BY 1, 2 UNION ALL SELECT id, id, 0, [{{'i': 0, 'rank': 0, 'dst': ''}}] FROM tp) SELECT seed, id, depth, CAST(row_number() OVER (PARTITION BY seed ORDER BY key) AS INTEGER) AS \"order\" FROM ky"
)
def g43_reading_order(spark, sf):
    """What hangs from the roots that have children, depth first, four levels deep."""
    n = stored(_nodes(spark, sf), "nodes")
    e = stored(model.resolved_edges(table(spark, sf, "edges"), n), "edges")
    kinds = F.when(F.col("type") == "depends_on", 0).when(F.col("type") == "soft_depends_on", 1).when(F.col("type") == "parent", 2)
    tree = e.withColumn("rank", kinds).filter("rank IS NOT NULL").select(F.col("target").alias("src"), F.col("source").alias("dst"), "rank")
    tops = model.roots(n, e).join(tree.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(tree.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return context.reading_order(tree, tops, 4)


@query("SELECT DISTINCT entry_id, best, chunks FROM (SELECT entry_id, len(chunk_embeddings) AS chunks, list_position(s, list_max(s)) - 1 AS best FROM (SELECT *, list_transform(chunk_embeddings, lambda v: list_cosine_similarity(CAST(v AS DOUBLE[]), [0.0, 1.0, 0.0])) AS s FROM document_entries WHERE len(chunk_embeddings) > 0))")
def a6_best_chunk(spark, sf):
    """The chunk of every entry that is nearest to a direction, the first of equals."""
    from quillgraph.functions.vectors import cosine

    q = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    e = table(spark, sf, "document_entries").filter(F.size("chunk_embeddings") > 0)
    best = F.array_max(F.transform("chunk_embeddings", lambda v, i: F.struct(cosine(v, q).alias("s"), (-i).alias("i"))))
    return e.select("entry_id", (-best["i"]).cast("bigint").alias("best"), F.size("chunk_embeddings").cast("bigint").alias("chunks")).distinct()


@query("SELECT f.req_id, f.id, CASE WHEN d.status IS NULL AND f.status IS NOT NULL THEN 'added' WHEN f.status IS NULL AND d.status IS NOT NULL THEN 'cleared' WHEN f.status IS DISTINCT FROM d.status THEN 'changed' ELSE 'same' END AS change FROM (SELECT DISTINCT req_id, id, status FROM doc_fields WHERE id IS NOT NULL) f JOIN (SELECT DISTINCT id, status FROM pkb_documents) d ON d.id = f.id")
def u6_status_requests(spark, sf):
    """What each request to write would do to the status of the document it names."""
    f = table(spark, sf, "doc_fields").filter("id IS NOT NULL").select("req_id", "id", F.col("status").alias("new")).distinct()
    d = table(spark, sf, "pkb_documents").select("id", F.col("status").alias("old")).distinct()
    kind = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "added").when(F.col("new").isNull() & F.col("old").isNotNull(), "cleared").when(~F.col("new").eqNullSafe(F.col("old")), "changed").otherwise("same")
    return f.join(d, "id").select("req_id", "id", kind.alias("change"))


@query("SELECT DISTINCT cluster_id, coalesce(array_to_string(list_sort(list(DISTINCT status) FILTER (status IS NOT NULL)), ','), '') AS statuses FROM duplicate_entries GROUP BY cluster_id")
def u1_merged_lists(spark, sf):
    """Union of the values of each cluster, in order."""
    e = table(spark, sf, "duplicate_entries")
    return e.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


@query("WITH s AS (SELECT entry_id, round(max(list_cosine_similarity(CAST(v AS DOUBLE[]), [0.6, 0.0, 0.8])), 6) AS score FROM (SELECT entry_id, unnest(chunk_embeddings) AS v FROM (SELECT DISTINCT entry_id, chunk_embeddings FROM document_entries)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) SELECT s.entry_id, s.score, d.title, d.doc_type FROM s JOIN (SELECT DISTINCT entry_id, title, doc_type FROM document_entries) d ON d.entry_id = s.entry_id WHERE d.doc_type IN ('memory', 'note') ORDER BY s.score DESC, s.entry_id LIMIT 10")
def r7_recall(spark, sf):
    e = table(spark, sf, "document_entries").dropDuplicates(["entry_id"])
    return context.recall(e, [0.6, 0.0, 0.8], ["memory", "note"], [], 10)


@query(f"WITH {BASE}, u AS (SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e), c AS (SELECT DISTINCT source AS id FROM e WHERE type = 'supersedes'), o AS (SELECT c.id AS query, u.dst AS id FROM c JOIN u ON u.src = c.id), q AS (SELECT query, id, min(depth) AS depth FROM (SELECT query, id, 1 AS depth FROM o UNION ALL SELECT o.query, u.dst, 2 FROM o JOIN u ON u.src = o.id) WHERE query <> id GROUP BY 1, 2), s AS (SELECT entry_id, any_value(id) AS id, round(max(list_cosine_similarity(CAST(v AS DOUBLE[]), [0.6, 0.0, 0.8])), 6) AS score FROM (SELECT entry_id, id, unnest(chunk_embeddings) AS v FROM (SELECT DISTINCT entry_id, id, chunk_embeddings FROM document_entries)) GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100), h AS (SELECT id, max(score) AS score FROM s GROUP BY 1) SELECT query, id, CAST(round(sum(CAST(p AS DECIMAL(20,9))), 6) AS DOUBLE) AS score FROM (SELECT c.id AS query, h.id, 0.5 * h.score AS p FROM h, c UNION ALL SELECT query, id, CASE depth WHEN 1 THEN 0.3 ELSE 0.15 END FROM q) GROUP BY 1, 2")
def v13_hybrid(spark, sf):
    """Entries near a direction or near, in the graph, to the nodes that superseded others."""
    n = stored(_nodes(spark, sf), "nodes")
    e = stored(model.resolved_edges(table(spark, sf, "edges"), n), "edges")
    links = e.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    centre = stored(e.filter("type = 'supersedes'").select(F.col("source").alias("id")).distinct(), "centres")
    near = graph.ego(links, centre, 2).select(F.col("seed").alias("query"), "id", "depth")
    entries = table(spark, sf, "document_entries").dropDuplicates(["entry_id"])
    hits = retrieval.search(entries, [0.6, 0.0, 0.8], 100).crossJoin(centre.select(F.col("id").alias("query"))).groupBy("query", "id").agg(F.max("score").alias("score"))
    return retrieval.hybrid(hits, near)


@query(f"WITH {_N} SELECT id, nullif(regexp_extract(id, '^([a-z]+)-[0-9a-z]', 1), '') AS prefix, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS stem FROM n")
def x_id_parts(spark, sf):
    return _nodes(spark, sf).select("id", t.id_prefix(F.col("id")).alias("prefix"), t.stem(F.col("path")).alias("stem"))


@query("SELECT DISTINCT id, 'doc-' || substr(sha256(id || chr(31) || path), 1, 8) AS minted FROM pkb_documents")
def x_seeded_ids(spark, sf):
    return table(spark, sf, "pkb_documents").select("id", t.seeded_id("doc", F.col("id"), F.col("path")).alias("minted")).distinct()


@query("SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024) ELSE b || ' B' END AS size FROM (SELECT DISTINCT doc_id, strlen(text) AS b FROM documents)")
def x_readable_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.readable_bytes(F.octet_length("text")).alias("size")).distinct()
