"""Queries of lists, states, ancestors, exports, rules and reports, with SQL for comparison."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.functions import vocabulary as voc
from quillgraph.functions.duck import EDGES, KEYS, NODES, PARENTS, key, words
from quillgraph.functions.refs import reference_key
from quillgraph.operators import changes, context, filters, graph, model, quality, retrieval, stats, tasks
from quillgraph.operators.hierarchy import on_circles, resolved_parents
from quillgraph.session import stored, table
from quillgraph.sources.writers import graph_json, graphml

QUERIES: dict = {}
ORACLES: dict = {}

BASE = f"{NODES}, {KEYS}, {EDGES}"
AS_OF = date(2025, 6, 1)
_DONE = f"coalesce(status IN {words([*voc.COMPLETED, *voc.STATUS_ALIASES['done'].split(), *voc.STATUS_ALIASES['cancelled'].split()])}, false)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Current nodes and resolved edges, each kept as a table."""
    n = stored(model.current_nodes(table(spark, sf, "graph_nodes")), "nodes")
    return n, stored(model.resolved_edges(table(spark, sf, "edges"), n), "edges")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return model.current_nodes(table(spark, sf, "graph_nodes"))


# ---- lists


@query(f"WITH {NODES} SELECT id, status FROM n WHERE node_type IN {words(voc.TASK_TYPES)} AND NOT {_DONE}")
def f7_open_tasks(spark, sf):
    return tasks.listed(_nodes(spark, sf)).select("id", "status")


@query(f"WITH RECURSIVE {BASE}, d AS (SELECT source, target FROM e WHERE type = 'depends_on'), h AS (SELECT d.source AS id FROM d JOIN n ON n.id = d.target WHERE NOT {_DONE} UNION SELECT id FROM n WHERE status = 'blocked' UNION SELECT d.source FROM h JOIN d ON d.target = h.id) SELECT id, 'blocked' AS state FROM h UNION ALL SELECT id, 'ready' FROM n WHERE status IN ('ready', 'queued') AND node_type = 'task' AND id NOT IN (SELECT id FROM h) AND id NOT IN (SELECT target FROM e WHERE type = 'parent')")
def f9_states(spark, sf):
    """What is ready and what is held up, directly or not."""
    return tasks.states(*_graph(spark, sf))


@query("SELECT DISTINCT id, title FROM pkb_documents WHERE doc_type IN ('memory', 'note', 'insight', 'observation') AND len(list_filter(tags, lambda x: lower(x) = 'log')) > 0 ORDER BY title, id LIMIT 20")
def f5_memories(spark, sf):
    """The first twenty by title, as the report shows them."""
    d = table(spark, sf, "pkb_documents").filter(F.col("doc_type").isin(voc.MEMORY_TYPES))
    return filters.tagged(d, ["log"]).select("id", "title").distinct().orderBy("title", "id").limit(20)


@query(f"WITH {NODES} SELECT id, {_DONE} AS completed, coalesce(status IN ('done', 'cancelled', 'archived'), false) AS closed, coalesce(node_type IN ('target', 'goal'), false) AS strategic, coalesce(priority BETWEEN 0 AND 4, false) AS priority_fits FROM n")
def f14_predicates(spark, sf):
    n = _nodes(spark, sf)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return n.select("id", tasks.is_completed(F.col("status")).alias("completed"), tasks.is_closed(F.col("status")).alias("closed"), yes(F.col("node_type").isin(voc.STRATEGIC_TYPES)).alias("strategic"), yes(F.col("priority").between(0, 4)).alias("priority_fits"))


@query(f"WITH {NODES} SELECT n.id, n.created FROM n WHERE n.node_type IN {words(voc.CONSOLIDATED_TYPES)} AND n.id IN (SELECT id FROM pkb_documents WHERE NOT coalesce(consolidated, false)) ORDER BY coalesce(created, '9999-99-99'), id LIMIT 1")
def f15_consolidation_seed(spark, sf):
    """The oldest note not yet consolidated: one row, as the operator is defined."""
    open_ = table(spark, sf, "pkb_documents").filter(~F.coalesce("consolidated", F.lit(False))).select("id")
    n = _nodes(spark, sf).filter(F.col("node_type").isin(voc.CONSOLIDATED_TYPES)).join(open_, "id", "left_semi")
    return tasks.sorted_by(n, "created").select("id", "created").limit(1)


@query(f"WITH {NODES} SELECT id, severity, priority FROM n WHERE node_type IN {words(voc.TASK_TYPES)} AND NOT {_DONE} ORDER BY severity DESC NULLS LAST, coalesce(priority, 4), id LIMIT 30")
def r5_most_severe(spark, sf):
    """A named sort, cut as the report is."""
    return tasks.sorted_by(tasks.listed(_nodes(spark, sf)), "severity").select("id", "severity", "priority").limit(30)


@query(f"WITH RECURSIVE {BASE}, u AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE type IN ('supersedes', 'closes') UNION SELECT target, source FROM e WHERE type IN ('supersedes', 'closes')), c AS (SELECT id, id AS r FROM n UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.r), m AS (SELECT id, min(r) AS component FROM c GROUP BY id) SELECT component, count(*) AS size FROM m GROUP BY 1 ORDER BY size DESC, component LIMIT 20")
def r11_largest_components(spark, sf):
    n, e = _graph(spark, sf)
    links = e.filter("type IN ('supersedes', 'closes')").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return stats.top_by(graph.connected_components(n, links).groupBy("component").agg(F.count(F.lit(1)).alias("size")), "size", 20, "component")


# ---- structure


@query(f"WITH {BASE}, q AS (SELECT target AS id, count(*) FILTER (regexp_replace(source, '\\.\\d+$', '') <> target) AS children, count(*) FILTER (regexp_replace(source, '\\.\\d+$', '') = target) AS subtasks FROM e WHERE type = 'parent' GROUP BY 1) SELECT n.id, coalesce(children, 0) AS children, coalesce(subtasks, 0) AS subtasks, coalesce(children, 0) = 0 AS leaf FROM n LEFT JOIN q ON q.id = n.id")
def g3_leaves(spark, sf):
    return model.leaves(*_graph(spark, sf))


_REFS = f"r AS (SELECT id, 'depends_on' AS type, unnest(CASE WHEN json_type(frontmatter, '$.depends_on') = 'ARRAY' THEN json_extract_string(frontmatter, '$.depends_on[*]') WHEN json_extract_string(frontmatter, '$.depends_on') IS NOT NULL THEN [json_extract_string(frontmatter, '$.depends_on')] END) AS ref FROM pkb_documents UNION SELECT id, 'link', unnest(regexp_extract_all(body, '\\[\\[([^\\]|#\\n]+)', 1)) FROM pkb_documents UNION SELECT id, 'link', unnest(list_filter(regexp_extract_all(body, '\\]\\(([^)\\s]+)\\)', 1), lambda x: NOT starts_with(x, 'http') AND NOT starts_with(x, '#'))) FROM pkb_documents)"


@query(f"WITH {NODES}, {KEYS}, {_REFS} SELECT DISTINCT r.id AS source, k.id AS target, r.type FROM r JOIN k ON k.key = {key('r.ref')} WHERE r.id <> k.id")
def g1_document_edges(spark, sf):
    """Edges that documents write themselves; of the fields only ``depends_on`` occurs in these documents."""
    return model.document_edges(table(spark, sf, "pkb_documents"), model.resolution(_nodes(spark, sf)))


@query(f"WITH RECURSIVE {NODES}, {KEYS}, {PARENTS}, g AS (SELECT id FROM n WHERE node_type = 'goal'), w AS (SELECT id, parent AS up, 1 AS steps, id || '>' || parent AS chain FROM p WHERE parent IS NOT NULL UNION ALL SELECT w.id, p.parent, w.steps + 1, w.chain || '>' || p.parent FROM w JOIN p ON p.id = w.up WHERE p.parent IS NOT NULL AND w.up NOT IN (SELECT id FROM g) AND w.steps < 1500) SELECT id, up AS ancestor, CAST(steps AS INTEGER) AS steps, chain FROM w WHERE up IN (SELECT id FROM g)")
def g7_chains_to_goal(spark, sf):
    """The nearest goal above every node, with the chain of parents up to it."""
    nodes = table(spark, sf, "graph_nodes")
    found = tasks.nearest_above(stored(resolved_parents(nodes), "links"), model.current_nodes(nodes).filter("node_type = 'goal'"))
    return found.select("id", "ancestor", "steps", F.array_join("chain", ">").alias("chain"))


@query(f"WITH RECURSIVE {NODES}, {KEYS}, {PARENTS}, g AS (SELECT id FROM n WHERE node_type = 'epic'), w AS (SELECT id, parent AS up, 1 AS steps FROM p WHERE parent IS NOT NULL UNION ALL SELECT w.id, p.parent, w.steps + 1 FROM w JOIN p ON p.id = w.up WHERE p.parent IS NOT NULL AND w.up NOT IN (SELECT id FROM g) AND w.steps < 1500) SELECT n.node_type, count(*) AS nodes, count(w.id) AS below_an_epic, CAST(max(w.steps) AS INTEGER) AS farthest FROM n LEFT JOIN (SELECT * FROM w WHERE up IN (SELECT id FROM g)) w ON w.id = n.id GROUP BY 1")
def g41_below_an_epic(spark, sf):
    """Per type: how many nodes have an epic above them, and how far at most."""
    nodes = table(spark, sf, "graph_nodes")
    n = stored(model.current_nodes(nodes), "nodes")
    above = tasks.nearest_above(stored(resolved_parents(nodes), "links"), n.filter("node_type = 'epic'")).select("id", "steps")
    return n.select("id", "node_type").join(above, "id", "left").groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"), F.count("steps").alias("below_an_epic"), F.max("steps").alias("farthest"))


_DRAWN = "u AS (SELECT source AS src, target AS dst FROM e WHERE type NOT IN ('link', 'similar_to') UNION SELECT target, source FROM e WHERE type NOT IN ('link', 'similar_to')), s AS (SELECT DISTINCT target AS id FROM e WHERE type = 'closes'), c AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT c.seed, u.dst, c.depth + 1 FROM c JOIN u ON u.src = c.id WHERE c.depth < 2), m AS (SELECT seed, id, min(depth) AS depth FROM c GROUP BY 1, 2), g AS (SELECT seed, id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS r FROM m) WHERE r <= 100)"


@query(f"WITH RECURSIVE {BASE}, {_DRAWN} SELECT a.seed, e.source, e.target, e.type FROM e JOIN g a ON a.id = e.source JOIN g b ON b.id = e.target AND b.seed = a.seed")
def g12_ego_edges(spark, sf):
    """What is drawn around every node that was closed: the edges among the nearest."""
    _, e = _graph(spark, sf)
    return graph.ego_extract(e, e.filter("type = 'closes'").select(F.col("target").alias("id")).distinct())[1]


@query(f"WITH RECURSIVE {BASE}, o AS (SELECT id, node_type FROM n WHERE status IS NOT NULL AND NOT {_DONE}), l AS (SELECT id FROM o WHERE node_type IN {words(voc.TASK_TYPES)} AND id NOT IN (SELECT target FROM e WHERE type = 'parent' AND source IN (SELECT id FROM o))), r AS (SELECT id FROM l UNION SELECT e.target FROM r JOIN e ON e.source = r.id WHERE e.type IN ('parent', 'depends_on', 'soft_depends_on', 'contributes_to')) SELECT id FROM r")
def g18_reachable(spark, sf):
    return tasks.reachable(*_graph(spark, sf))


_LIST = "coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({f})), ','), '')"
_ENDS = "x AS (SELECT source AS id, '>' || type AS kind, target AS other FROM e UNION SELECT target, '<' || type, source FROM e WHERE type <> 'similar_to' UNION SELECT target, '>similar_to', source FROM e WHERE type = 'similar_to')"


@query(
    f"WITH {BASE}, {_ENDS}, h AS (SELECT d.source AS id FROM e d JOIN n ON n.id = d.target WHERE d.type = 'depends_on' AND NOT {_DONE} UNION SELECT id FROM n WHERE status = 'blocked'), "
    f"q AS (SELECT id, min(other) FILTER (kind = '>parent') AS parent, {_LIST.format(c='other', f="kind = '<parent'")} AS children, {_LIST.format(c='other', f="kind = '>depends_on'")} AS depends_on, {_LIST.format(c='other', f="kind = '<depends_on'")} AS blocks, {_LIST.format(c='other', f="kind = '>similar_to'")} AS similar FROM x GROUP BY 1) "
    "SELECT n.id, q.parent, coalesce(q.children, '') AS children, coalesce(q.depends_on, '') AS depends_on, coalesce(q.blocks, '') AS blocks, coalesce(q.similar, '') AS similar, CASE WHEN n.id IN (SELECT id FROM h) THEN 'blocked' WHEN n.status IN ('ready', 'queued') AND n.node_type = 'task' AND n.id NOT IN (SELECT target FROM e WHERE type = 'parent') THEN 'ready' END AS state FROM n LEFT JOIN q ON q.id = n.id"
)
def k6_task_index(spark, sf):
    """Relations seen from both ends, with states that are not handed on."""
    n, e = _graph(spark, sf)
    index = model.task_index(n, e, tasks.states(n, e, handed_on=False))
    return index.select("id", "parent", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("children", "depends_on", "blocks", "similar")], "state")


@query(f"WITH RECURSIVE {BASE}, s AS (SELECT id FROM n WHERE status = 'blocked'), c AS (SELECT id FROM s UNION SELECT e.target FROM c JOIN e ON e.source = c.id WHERE e.type = 'parent') SELECT id, false AS context FROM s UNION ALL SELECT id, true FROM c WHERE id NOT IN (SELECT id FROM s) AND id IN (SELECT id FROM n WHERE node_type = 'epic')")
def g52_with_context(spark, sf):
    """Blocked nodes with the epics above them."""
    n, e = _graph(spark, sf)
    return tasks.with_context(n.filter("status = 'blocked'"), n, e)


@query(f"WITH {NODES}, {KEYS}, {PARENTS}, m AS (SELECT p.id, p.parent FROM p JOIN n ON n.id = p.parent WHERE n.node_type IN ('target', 'goal')) SELECT id, 'migrate' AS action, 'parent' AS field, parent AS old, NULL::VARCHAR AS new FROM m UNION ALL SELECT id, 'migrate', 'contributes_to', NULL, parent FROM m")
def g47_strategic_parents(spark, sf):
    nodes = table(spark, sf, "graph_nodes")
    return tasks.strategic_parents(model.current_nodes(nodes), stored(resolved_parents(nodes), "links"))


_AROUND = "x AS (SELECT source AS id, CASE type WHEN 'parent' THEN 'parents' WHEN 'depends_on' THEN 'needs' WHEN 'contributes_to' THEN 'serves' WHEN 'similar_to' THEN 'similar' END AS kind, target AS other FROM e UNION ALL SELECT target, CASE type WHEN 'parent' THEN 'children' WHEN 'depends_on' THEN 'waiting' WHEN 'contributes_to' THEN 'served_by' END, source FROM e UNION ALL SELECT a.id, 'siblings', b.source FROM (SELECT source AS id, min(target) AS p FROM e WHERE type = 'parent' GROUP BY 1) a JOIN e b ON b.target = a.p AND b.type = 'parent' AND b.source <> a.id)"


@query(f"WITH {BASE}, {_AROUND} SELECT id, kind, other, total FROM (SELECT *, count(*) OVER (PARTITION BY id, kind) AS total, row_number() OVER (PARTITION BY id, kind ORDER BY other) AS r FROM x WHERE kind IS NOT NULL) WHERE r <= 5 OR kind NOT IN ('siblings', 'children')")
def g42_context_rows(spark, sf):
    return context.context_rows(_graph(spark, sf)[1])


# ---- edits


_RENAMED = "rn AS (SELECT target AS old, min(source) AS new FROM e WHERE type = 'supersedes' GROUP BY 1)"


@query(f"WITH {BASE}, {_RENAMED}, {_REFS.replace(' UNION SELECT id, ' + chr(39) + 'link' + chr(39) + ', unnest(list_filter', ' UNION SELECT id, ' + chr(39) + 'md' + chr(39) + ', unnest(list_filter')} SELECT DISTINCT r.id AS source, coalesce(CASE WHEN r.type <> 'md' THEN m.id END, k.id) AS target, replace(r.type, 'md', 'link') AS type FROM r LEFT JOIN rn ON lower(rn.old) = {key('r.ref')} LEFT JOIN n m ON m.id = rn.new LEFT JOIN k ON k.key = {key('r.ref')} WHERE coalesce(CASE WHEN r.type <> 'md' THEN m.id END, k.id) <> r.id")
def k13_renamed(spark, sf):
    """Edges that documents write after every superseded note was renamed to the first that superseded it."""
    n, e = _graph(spark, sf)
    renames = e.filter("type = 'supersedes'").groupBy(F.col("target").alias("old")).agg(F.min("source").alias("new"))
    docs = stored(changes.rename_ids(table(spark, sf, "pkb_documents").select("id", "frontmatter", "body"), renames), "renamed")
    return model.document_edges(docs, model.resolution(n))


@query("SELECT DISTINCT id, CASE WHEN json_type(frontmatter) = 'OBJECT' THEN len(json_keys(frontmatter)) - CASE WHEN json_extract_string(frontmatter, '$.due') IS NULL AND NOT list_contains(json_keys(frontmatter), 'due') THEN 0 ELSE 1 END + CASE WHEN list_contains(json_keys(frontmatter), 'status') THEN 0 ELSE 1 END ELSE 1 END AS keys, 'review' AS status FROM pkb_documents")
def k9_updated(spark, sf):
    """Documents whose due day was taken out and whose status was set."""
    docs = table(spark, sf, "pkb_documents").select("id", "frontmatter").distinct()
    pairs = F.explode(F.array(F.struct(F.lit("due").alias("field"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("status").alias("field"), F.lit('"review"').alias("value")))).alias("p")
    out = changes.updated(docs, docs.select("id", pairs).select("id", "p.*"))
    return out.select("id", F.size(F.json_object_keys("frontmatter")).cast("bigint").alias("keys"), F.get_json_object("frontmatter", "$.status").alias("status")).distinct()


@query(f"WITH {NODES}, {KEYS}, r AS (SELECT DISTINCT req_id, id, title, doc_type, status, parent, {key('parent')} AS key FROM doc_fields) SELECT r.req_id, coalesce(nullif(trim(r.id), ''), coalesce(r.doc_type, 'document') || '-' || substr(sha256(concat_ws(chr(31), CAST(r.req_id AS VARCHAR), r.title)), 1, 8)) AS id, coalesce(r.doc_type, 'document') AS doc_type, k.id AS parent, CASE WHEN trim(coalesce(r.title, '')) = '' THEN 'no title' WHEN r.doc_type NOT IN {words(voc.NODE_TYPES)} THEN 'unknown type' WHEN r.status NOT IN {words([*voc.STATUSES, *(w for ws in voc.STATUS_ALIASES.values() for w in ws.split())])} THEN 'unknown status' WHEN r.key <> '' AND k.id IS NULL THEN 'unknown parent' WHEN r.key = '' AND r.doc_type IN ('task', 'pr') THEN 'no parent' END AS problem FROM r LEFT JOIN k ON k.key = r.key AND r.key <> ''")
def k8_created(spark, sf):
    """What each request to write a document would add, or why it may not."""
    return tasks.created(table(spark, sf, "doc_fields"), model.resolution(_nodes(spark, sf))).drop("permalink")


@query(f"WITH {BASE}, o AS (SELECT id FROM n WHERE NOT {_DONE}), x AS (SELECT id FROM n WHERE status = 'review'), h AS (SELECT source AS id, min(target) AS p FROM e WHERE type = 'parent' AND source IN (SELECT id FROM x) GROUP BY 1), b AS (SELECT h.id, e.source AS other, row_number() OVER (PARTITION BY h.id ORDER BY e.source) AS r FROM h JOIN e ON e.target = h.p AND e.type = 'parent' WHERE e.source IN (SELECT id FROM o) AND e.source NOT IN (SELECT id FROM x)), f AS (SELECT target AS id, source AS other, row_number() OVER (PARTITION BY target ORDER BY source) AS r FROM e WHERE type = 'depends_on' AND target IN (SELECT id FROM x) AND source NOT IN (SELECT source FROM e WHERE type = 'depends_on' AND target IN (SELECT id FROM o) AND target NOT IN (SELECT id FROM x))) SELECT source AS id, 'parent' AS kind, target AS other FROM e WHERE type = 'parent' AND source IN (SELECT id FROM x) UNION ALL SELECT target, 'child', source FROM e WHERE type = 'parent' AND target IN (SELECT id FROM x) UNION ALL SELECT id, 'sibling', other FROM b WHERE r <= 3 UNION ALL SELECT id, 'unblocked', other FROM f WHERE r <= 5")
def g49_around_change(spark, sf):
    """What to look at once all that is under review is finished."""
    n, e = _graph(spark, sf)
    return tasks.around_change(n.filter("status = 'review'"), n, e)


@query(f"WITH {BASE} SELECT n.id, n.status, n.priority, b.blocked_by FROM n JOIN (SELECT e.source AS id, array_to_string(list_sort(list(DISTINCT e.target)), ',') AS blocked_by FROM e JOIN n ON n.id = e.target WHERE e.type = 'depends_on' AND NOT {_DONE} GROUP BY 1) b ON b.id = n.id WHERE n.node_type IN {words(voc.TASK_TYPES)} AND NOT {_DONE.replace('status', 'n.status', 1)}")
def t3_blocked_tasks(spark, sf):
    """Open tasks that wait, with what they wait for."""
    n, e = _graph(spark, sf)
    return tasks.listed(n).select("id", "status", "priority").join(tasks.with_blockers(n, e), "id").withColumn("blocked_by", F.array_join("blocked_by", ","))


@query("SELECT entry_id, score FROM (SELECT entry_id, round(max(list_cosine_similarity(CAST(v AS DOUBLE[]), [0.0, 0.6, 0.8])), 4) AS score FROM (SELECT entry_id, unnest(chunk_embeddings) AS v FROM (SELECT DISTINCT entry_id, chunk_embeddings, doc_type FROM document_entries WHERE doc_type IN ('task', 'epic', 'learn', 'pr'))) GROUP BY 1) ORDER BY score DESC, entry_id LIMIT 20")
def t2_task_search(spark, sf):
    e = table(spark, sf, "document_entries").dropDuplicates(["entry_id"])
    return retrieval.search(e, [0.0, 0.6, 0.8], 20, where=F.col("doc_type").isin(voc.TASK_TYPES), digits=4).select("entry_id", "score")


# ---- reports


@query(f"WITH {NODES} SELECT id, round(coalesce(word_count, 0) / (SELECT max(word_count) FROM n), 6) AS share FROM n")
def a7_share_of_longest(spark, sf):
    return stats.normalised_by_max(stored(_nodes(spark, sf), "nodes"), "word_count", "share").select("id", F.round("share", 6).alias("share"))


@query(f"WITH {NODES} SELECT count(*) AS matched, count(*) FILTER (CAST(priority AS VARCHAR) IS DISTINCT FROM CAST(least(coalesce(priority, 4), 2) AS VARCHAR)) AS changed, count(*) FILTER (CAST(priority AS VARCHAR) IS NOT DISTINCT FROM CAST(least(coalesce(priority, 4), 2) AS VARCHAR)) AS skipped FROM n WHERE status = 'ready'")
def a11_batch_summary(spark, sf):
    rows = stored(_nodes(spark, sf).filter("status = 'ready'"), "rows")
    return stats.batch_summary(rows, changes.set_field(rows, "priority", F.least(F.coalesce("priority", F.lit(4)), F.lit(2))))


@query(f"WITH {NODES}, d AS (SELECT DISTINCT id, TRY_CAST(json_extract_string(frontmatter, '$.priority') AS BIGINT) AS priority, try_cast(substr(json_extract_string(frontmatter, '$.due'), 1, 10) AS DATE) AS due FROM pkb_documents) SELECT count(*) AS total, count(*) FILTER (d.priority <= 1) AS urgent, count(*) FILTER (due < DATE '2025-06-01') AS overdue, count(due) AS with_due, max(date_diff('day', try_cast(substr(n.created, 1, 10) AS DATE), DATE '2025-06-01')) AS oldest FROM d JOIN n ON n.id = d.id")
def a18_dashboard(spark, sf):
    j = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    d = table(spark, sf, "pkb_documents").select("id", j("priority").try_cast("bigint").alias("priority"), j("due").alias("due")).distinct()
    return tasks.dashboard(d.join(_nodes(spark, sf).select("id", "created"), "id"), AS_OF)


@query(f"WITH RECURSIVE {BASE}, d AS (SELECT source, target FROM e WHERE type = 'depends_on'), h AS (SELECT d.source AS id FROM d JOIN n ON n.id = d.target WHERE NOT {_DONE} UNION SELECT id FROM n WHERE status = 'blocked' UNION SELECT d.source FROM h JOIN d ON d.target = h.id) SELECT (SELECT count(DISTINCT id) FROM pkb_documents) AS documents, (SELECT count(*) FROM (SELECT DISTINCT id, modified FROM pkb_documents) WHERE date_diff('day', try_cast(substr(modified, 1, 10) AS DATE), DATE '2025-06-01') > 60) AS stale, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE node_type IN {words(voc.TASK_TYPES)} AND NOT {_DONE}) AS open_tasks, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n WHERE status IN ('ready', 'queued') AND node_type = 'task' AND id NOT IN (SELECT id FROM h) AND id NOT IN (SELECT target FROM e WHERE type = 'parent')) AS ready, (SELECT count(*) FROM h) AS blocked, (SELECT count(*) FROM n WHERE id NOT IN (SELECT source FROM e WHERE type = 'parent')) AS roots, (SELECT count(*) FROM n WHERE id NOT IN (SELECT source FROM e WHERE type = 'parent' UNION SELECT target FROM e WHERE type = 'parent')) AS flat")
def a17_status_report(spark, sf):
    n, e = _graph(spark, sf)
    return tasks.status_report(table(spark, sf, "pkb_documents"), n, e, tasks.states(n, e), AS_OF)


@query(f"WITH RECURSIVE {NODES}, w AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(label, '')), '\\s+'), lambda x: x <> ''))) AS s FROM n), j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS score FROM w a JOIN w b ON a.id < b.id WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.7), u AS (SELECT a, b FROM j UNION SELECT b, a FROM j), c AS (SELECT DISTINCT a AS id, a AS r FROM u UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.r), m AS (SELECT id, min(r) AS grp FROM c GROUP BY id), z AS (SELECT grp, count(*) AS size FROM m GROUP BY grp) SELECT z.grp AS \"group\", z.size, round(max(j.score), 6) AS best, count(*) AS pairs FROM j JOIN m ON m.id = j.a JOIN z ON z.grp = m.grp GROUP BY 1, 2")
def a9_cluster_scores(spark, sf):
    """Groups of notes with similar titles, their best score and how many pairs scored."""
    n = stored(_nodes(spark, sf), "nodes")
    return context.cluster_scores(stored(context.duplicate_groups(n), "groups"), retrieval.title_pairs(n))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.35) SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM v) AS checked, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM f JOIN v a ON a.vec_id = f.a WHERE f.b = f.a + 7) AS known")
def j8_similarity_report(spark, sf):
    """Pairs seven ids apart stand for those known already."""
    e = table(spark, sf, "embeddings")
    known = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 7).alias("b"))
    return retrieval.similarity_report(e, 0.35, known)


@query("SELECT p AS id, count(DISTINCT id) + 1 AS next FROM (SELECT DISTINCT project AS p, id FROM pkb_documents WHERE project IS NOT NULL) GROUP BY 1")
def w3_next_numbers(spark, sf):
    """Documents numbered within their project, and the number that comes next."""
    d = table(spark, sf, "pkb_documents").filter("project IS NOT NULL").select("project", "id").distinct()
    per = d.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    ids = per.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat("project", F.lit("."), k.cast("string")))).alias("id"))
    return tasks.next_numbers(ids, d.select(F.col("project").alias("id")))


# ---- rules


_J = "json_extract_string(frontmatter, '$.{}')"
_LINT = {
    ("warning", "fm-missing"): "frontmatter IS NULL",
    ("error", "fm-parse-error"): "frontmatter IS NOT NULL AND NOT json_valid(frontmatter)",
    ("error", "fm-invalid"): "json_valid(frontmatter) AND json_type(frontmatter) <> 'OBJECT'",
    ("warning", "fm-no-title"): "trim(coalesce(title, '')) = ''",
    ("warning", "doc-no-type"): "trim(coalesce(doc_type, '')) = ''",
    ("warning", "task-no-status"): "trim(coalesce(status, '')) = ''",
    ("warning", "fm-missing-project"): "trim(coalesce(project, '')) = ''",
    ("error", "task-no-id"): f"json_type(frontmatter) = 'OBJECT' AND {_J.format('id')} IS NULL AND {_J.format('task_id')} IS NULL",
    ("style", "task-legacy-id"): f"{_J.format('id')} IS NULL AND {_J.format('task_id')} IS NOT NULL",
    ("warning", "fm-deprecated-project-type"): f"{_J.format('type')} = 'project'",
    ("style", "fm-unknown-type"): f"json_type(frontmatter, '$.type') = 'VARCHAR' AND {_J.format('type')} NOT IN {words([*voc.NODE_TYPES, 'project'])}",
    ("error", "fm-type-not-string"): "json_type(frontmatter, '$.type') NOT IN ('VARCHAR', 'NULL')",
    ("style", "fm-status-alias"): f"{_J.format('type')} IN {words(voc.TASK_TYPES)} AND {_J.format('status')} IN {words([w for ws in voc.STATUS_ALIASES.values() for w in ws.split()])}",
    ("warning", "fm-unknown-status"): f"{_J.format('type')} IN {words(voc.TASK_TYPES)} AND json_type(frontmatter, '$.status') = 'VARCHAR' AND {_J.format('status')} NOT IN {words([*voc.STATUSES, *(w for ws in voc.STATUS_ALIASES.values() for w in ws.split())])}",
    ("warning", "fm-priority-range"): f"json_type(frontmatter, '$.priority') IN ('BIGINT', 'UBIGINT') AND TRY_CAST({_J.format('priority')} AS BIGINT) NOT BETWEEN 0 AND 4",
    ("error", "fm-priority-type"): "json_type(frontmatter, '$.priority') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL')",
    ("error", "fm-tags-type"): "json_type(frontmatter, '$.tags') NOT IN ('ARRAY', 'VARCHAR', 'NULL')",
    ("style", "fm-id-format"): f"length({_J.format('id')}) > 0 AND NOT coalesce({_J.format('type')} IN ('goal', 'target', 'project'), false) AND NOT regexp_matches({_J.format('id')}, '(?i)^[a-z0-9][a-z0-9_-]*[_-][a-f0-9]{{8}}$')",
    ("error", "fm-prohibited-body"): f"{_J.format('body')} IS NOT NULL",
    ("style", "fm-unknown-key"): f"len(list_filter(json_keys(frontmatter), lambda x: x NOT IN {words(voc.KNOWN_KEYS)})) > 0",
    ("error", "fm-other-id"): f"{_J.format('id')} <> id",
    ("style", "md-no-final-newline"): "length(body) > 0 AND NOT ends_with(body, chr(10))",
    ("warning", "md-open-fence"): "len(list_filter(string_split(replace(body, chr(13), ''), chr(10)), lambda x: starts_with(ltrim(x), '```'))) % 2 = 1",
}
_LINES = "l AS (SELECT path, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT DISTINCT path, string_split(regexp_replace(replace(body, chr(13), ''), '\\n\\z', ''), chr(10)) AS s FROM pkb_documents WHERE body IS NOT NULL)), b AS (SELECT path, i, trim(line, ' ' || chr(9)) = '' AS blank FROM l)"


@query(
    f"WITH {_LINES} "
    + " UNION ALL ".join(f"SELECT DISTINCT path, '{s}' AS severity, '{r}' AS rule, CAST(0 AS INTEGER) AS line FROM pkb_documents WHERE {c}" for (s, r), c in _LINT.items())
    + " UNION ALL SELECT path, 'style', 'md-trailing-ws', CAST(min(i) AS INTEGER) FROM l WHERE regexp_matches(line, '[ \\t]+$') AND NOT regexp_matches(line, '(?:^|[^ \\t])  $') GROUP BY 1"
    " UNION ALL SELECT DISTINCT x.path, 'style', 'md-consecutive-blanks', CAST(x.i AS INTEGER) FROM b x JOIN b y ON y.path = x.path AND y.i = x.i - 1 JOIN b z ON z.path = x.path AND z.i = x.i - 2 WHERE x.blank AND y.blank AND z.blank"
)
def l_lint(spark, sf):
    """Every rule but the one about effort, which these documents do not state."""
    return quality.lint(table(spark, sf, "pkb_documents"))


@query(f"WITH {BASE} SELECT id, CASE WHEN id IN (SELECT target FROM e WHERE type = 'parent') THEN 'warning' ELSE 'style' END AS severity, 'task-no-parent' AS rule FROM n WHERE node_type IN ('task', 'epic') AND trim(coalesce(parent, '')) = ''")
def l_no_parent(spark, sf):
    return quality.no_parent(*_graph(spark, sf))


_HARD = f"{PARENTS}, d AS (SELECT source AS src, target AS dst FROM e WHERE type = 'depends_on' UNION SELECT id, parent FROM p WHERE parent <> id), r AS (SELECT src, dst FROM d UNION SELECT r.src, d.dst FROM r JOIN d ON d.src = r.dst), q AS (SELECT id, parent AS up FROM p WHERE parent <> id UNION SELECT q.id, p.parent FROM q JOIN p ON p.id = q.up WHERE p.parent IS NOT NULL)"


@query(f"WITH RECURSIVE {BASE}, {_HARD} SELECT n.id, CASE WHEN {key('n.parent')} = lower(n.id) THEN 'self-parent' WHEN n.id IN (SELECT id FROM q WHERE id = up) THEN 'parent-cycle' ELSE 'dep-hard-cycle' END AS rule FROM n WHERE {key('n.parent')} = lower(n.id) OR n.id IN (SELECT src FROM r WHERE src = dst)")
def l_circular(spark, sf):
    n, e = _graph(spark, sf)
    links = stored(resolved_parents(table(spark, sf, "graph_nodes")), "links")
    up = links.filter("parent <> id").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    hard = e.filter("type = 'depends_on'").select(F.col("source").alias("src"), F.col("target").alias("dst")).unionByName(up)
    return quality.circular(on_circles(links), graph.strongly_connected(hard), quality.self_parents(n, reference_key))


@query(f"WITH RECURSIVE {BASE}, {_HARD}, m AS (SELECT a.src AS id, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src), g AS (SELECT id, min(other) AS component FROM m GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM g WHERE id IN (SELECT id FROM m WHERE other <> id)")
def g15_hard_cycles(spark, sf):
    """Circles of dependencies and parents, as nodes write them."""
    _, e = _graph(spark, sf)
    up = resolved_parents(table(spark, sf, "graph_nodes")).filter("parent <> id").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return graph.strongly_connected(e.filter("type = 'depends_on'").select(F.col("source").alias("src"), F.col("target").alias("dst")).unionByName(up))


@query(f"WITH RECURSIVE {BASE}, h AS (SELECT DISTINCT source AS src, target AS dst FROM e WHERE type IN ('depends_on', 'parent')), f AS (SELECT source AS dst, target AS src FROM e WHERE type IN ('link', 'similar_to') UNION SELECT target, source FROM e WHERE type IN ('link', 'similar_to')), w AS (SELECT dst AS seed, dst AS id, 0 AS depth, [dst] AS path FROM f UNION SELECT w.seed, h.dst, w.depth + 1, list_append(w.path, h.dst) FROM w JOIN h ON h.src = w.id WHERE NOT list_contains(w.path, h.dst)), b AS (SELECT seed, id, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT f.src, f.dst, array_to_string(min(w.path), '>') AS path FROM f JOIN b ON b.seed = f.dst AND b.id = f.src JOIN w ON w.seed = b.seed AND w.id = b.id AND w.depth = b.depth GROUP BY 1, 2")
def g51_closing_links(spark, sf):
    """Links and likenesses, either way round, that would close a circle if they were dependencies."""
    _, e = _graph(spark, sf)
    hard = e.filter("type IN ('depends_on', 'parent')").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    loose = graph.symmetric(e.filter("type IN ('link', 'similar_to')").select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return context.closing_links(hard, loose).select("src", "dst", F.array_join("path", ">").alias("path"))


@query(f"WITH {NODES} SELECT id, project FROM n WHERE project IS NOT NULL AND lower(project) NOT IN (SELECT lower(x) FROM (SELECT slug AS x FROM projects WHERE vault IS NOT NULL UNION ALL SELECT unnest(aliases) FROM projects WHERE vault IS NOT NULL) WHERE x IS NOT NULL)")
def l_unregistered_projects(spark, sf):
    """Nodes whose project is in no vault of the registry."""
    return quality.unregistered_projects(_nodes(spark, sf), table(spark, sf, "projects").filter("vault IS NOT NULL"))


# ---- exports


_JSON = "to_json({{{}}})"


@query(f"WITH {BASE}, x AS (SELECT id, coalesce(label, '') AS label, coalesce(node_type, '') AS node_type, coalesce(status, '') AS status FROM n WHERE deleted_at IS NULL) SELECT 'node' AS kind, CAST(to_json({{'id': id, 'label': label, 'node_type': node_type, 'status': status}}) AS VARCHAR) AS json FROM x UNION ALL SELECT 'edge', CAST(to_json({{'source': source, 'target': target, 'type': type}}) AS VARCHAR) FROM e WHERE source IN (SELECT id FROM x) AND target IN (SELECT id FROM x)")
def k2_graph_json(spark, sf):
    """Nodes that are there, and the edges among them, a line each."""
    n, e = _graph(spark, sf)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("label", "node_type", "status")]
    live = stored(n.filter("deleted_at IS NULL").select("id", *text), "live")
    return graph_json(live, model.induced(e, live))


def _xml(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


@query(
    f"WITH {BASE} SELECT 1 AS part, '<node id=\"' || {_xml('id')} || '\">' || coalesce('<data key=\"label\">' || {_xml('label')} || '</data>', '') || coalesce('<data key=\"status\">' || {_xml('status')} || '</data>', '') || '</node>' AS value FROM n"
    f" UNION ALL SELECT 2, '<edge source=\"' || {_xml('source')} || '\" target=\"' || {_xml('target')} || '\"><data key=\"type\">' || {_xml('type')} || '</data></edge>' FROM e"
)
def k3_graphml_lines(spark, sf):
    """The lines of nodes and edges; what stands before and after them is always the same."""
    n, e = _graph(spark, sf)
    return graphml(n, e, ["label", "status"]).filter("part IN (1, 2)")


# ---- text


@query(f"WITH {NODES} SELECT id, coalesce(CASE {' '.join(f'WHEN status IN {words(ws.split())} THEN {chr(39)}{k}{chr(39)}' for k, ws in voc.STATUS_ALIASES.items())} END, status) AS status, CASE {' '.join(f'WHEN status = {chr(39)}{k}{chr(39)} THEN {v}' for k, v in voc.STATUS_RANK.items())} ELSE 0 END AS rank FROM n")
def x_status_words(spark, sf):
    return _nodes(spark, sf).select("id", t.status_alias(F.col("status")).alias("status"), t.status_rank(F.col("status")).alias("rank"))


@query("SELECT DISTINCT id, coalesce(regexp_matches(body, '(?i)(acceptance criteria|done when|definition of done|## ac\\r?\\n)'), false) AS has FROM pkb_documents")
def x_criteria(spark, sf):
    return table(spark, sf, "pkb_documents").select("id", t.has_criteria(F.col("body")).alias("has")).distinct()
