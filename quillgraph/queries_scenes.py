"""Queries of whiteboards: drawings made from the graph, written, read back, compared, audited and edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph, scene
from quillgraph.queries_lists import _DRAWN, _graph, BASE
from quillgraph.session import stored

QUERIES: dict = {}
ORACLES: dict = {}

_NODES = "x AS (SELECT g.seed AS scene, g.id, g.depth, n.label, n.node_type, n.status, n.priority FROM g JOIN n ON n.id = g.id)"
_EDGES = "y AS (SELECT a.seed AS scene, e.source, e.target, e.type FROM e JOIN g a ON a.id = e.source JOIN g b ON b.id = e.target AND b.seed = a.seed)"
SCENES = f"{BASE}, {_DRAWN}, {_NODES}, {_EDGES}"
_AT = "z AS (SELECT *, (row_number() OVER (PARTITION BY scene, depth ORDER BY id) - 1) * 280.0 AS px, depth * 170.0 AS py FROM x)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one drawing around every node that was closed."""
    n, e = _graph(spark, sf)
    near, within = graph.ego_extract(e, e.filter("type = 'closes'").select(F.col("target").alias("id")).distinct())
    nodes = near.join(n.select("id", "label", "node_type", "status", "priority"), "id").withColumnRenamed("seed", "scene")
    return stored(nodes, "drawn"), stored(within.withColumnRenamed("seed", "scene"), "lines")


def _drawings(spark: SparkSession, sf: str) -> DataFrame:
    """The same as elements, written as JSON and read back."""
    nodes, edges = _parts(spark, sf)
    return stored(scene.read_elements(scene.to_json(scene.generate(scene.layered(nodes), edges))), "elements")


@query(f"WITH RECURSIVE {SCENES}, {_AT} SELECT scene, id AS node_id, node_type, status, px AS x, py AS y FROM z")
def x1_cards(spark, sf):
    """Cards as they are read back, each where it was put."""
    return scene.cards(_drawings(spark, sf)).filter("NOT duplicate").select("scene", "node_id", "node_type", "status", "x", "y")


@query(f"WITH RECURSIVE {SCENES} SELECT scene, id AS node_id, status, CASE WHEN status IS NOT NULL THEN CAST(priority AS INTEGER) END AS priority, array_to_string(list_filter(list_transform(string_split(coalesce(label, ''), chr(10)), lambda l: trim(l)), lambda l: l <> ''), ' ') AS title FROM x WHERE NOT starts_with(coalesce(label, ''), '#') AND NOT starts_with(coalesce(label, ''), '[')")
def x2_card_texts(spark, sf):
    """What the text of a card says of its node."""
    c = scene.cards(_drawings(spark, sf)).filter("NOT duplicate").withColumn("said", scene.parsed_card(F.col("label")))
    plain = c.filter(~F.coalesce(F.element_at(F.split("label", "\n"), -1), F.lit("")).rlike(r"^[#\[]") | F.coalesce(F.col("label"), F.lit("")).rlike(r"^\[[A-Z_]+(?: · P[0-9]+)?\]$"))
    return plain.select("scene", "node_id", F.col("said.status").alias("status"), F.col("said.priority").alias("priority"), F.col("said.title").alias("title"))


@query(f"WITH RECURSIVE {SCENES} SELECT scene, source, target, type FROM y")
def x3_arrows(spark, sf):
    """Arrows as they are read back, with their kinds."""
    return scene.arrows(_drawings(spark, sf)).select("scene", "source", "target", "type")


@query(f"WITH RECURSIVE {SCENES}, {_AT}, f AS (SELECT scene, source AS child, min(target) AS up FROM y WHERE type = 'parent' GROUP BY 1, 2) SELECT f.scene, f.up AS parent, count(*) AS children, min(px) - 32 AS x, min(py) - 72 AS y, max(px) - min(px) + 284 AS width, max(py) - min(py) + 194 AS height FROM f JOIN z ON z.scene = f.scene AND z.id = f.child GROUP BY 1, 2")
def x6_frames(spark, sf):
    """Frames around the children of each node, and how many they hold."""
    e = _drawings(spark, sf)
    held = e.filter("node_id IS NOT NULL AND frame_id IS NOT NULL").groupBy("scene", F.col("frame_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return e.filter("type = 'frame'").join(held, ["scene", "id"]).select("scene", F.expr("substring(id, 3)").alias("parent"), "children", "x", "y", "width", "height")


@query(f"WITH RECURSIVE {SCENES}, kk AS (SELECT scene, count(*) AS n FROM x GROUP BY 1), l AS (SELECT scene, count(*) AS n FROM y GROUP BY 1), f AS (SELECT scene, count(DISTINCT up) AS n FROM (SELECT scene, source, min(target) AS up FROM y WHERE type = 'parent' GROUP BY 1, 2) GROUP BY 1) SELECT scene, 'rectangle' AS type, n FROM kk UNION ALL SELECT scene, 'text', n FROM kk UNION ALL SELECT scene, 'arrow', n FROM l UNION ALL SELECT scene, 'frame', n FROM f")
def x9_summary(spark, sf):
    return scene.summary(_drawings(spark, sf)).select("scene", "type", "n")


@query(f"WITH RECURSIVE {SCENES} SELECT scene, 'e-' || type || '-' || source || '-' || target AS id, p AS problem FROM (SELECT y.*, CASE WHEN a.node_type = 'epic' THEN 'dangling-start' END AS p FROM y JOIN x a ON a.scene = y.scene AND a.id = y.source UNION ALL SELECT y.*, CASE WHEN b.node_type = 'epic' THEN 'dangling-end' END FROM y JOIN x b ON b.scene = y.scene AND b.id = y.target) WHERE p IS NOT NULL UNION ALL SELECT scene, 't-' || id, 'missing-container' FROM x WHERE node_type = 'epic'")
def x10_integrity(spark, sf):
    """What is wrong with drawings from which the cards of epics were torn out."""
    torn = _drawings(spark, sf).filter("node_type IS NULL OR node_type <> 'epic'")
    return scene.integrity(torn)


@query(f"WITH RECURSIVE {SCENES} SELECT scene, count(*) AS cards, (SELECT count(*) FROM y WHERE y.scene = x.scene AND y.source NOT IN (SELECT id FROM n WHERE node_type = 'epic') AND y.target NOT IN (SELECT id FROM n WHERE node_type = 'epic')) AS arrows FROM x WHERE coalesce(node_type, '') <> 'epic' GROUP BY scene")
def x14_without_epics(spark, sf):
    """Drawings after the cards of epics were deleted with their texts and arrows."""
    e = _drawings(spark, sf)
    left = stored(scene.without(e, e.filter("node_type = 'epic'").select("scene", "id"), arrows_too=True), "left")
    broken = scene.integrity(left.filter("type <> 'frame'").withColumn("frame_id", F.lit(None).cast("string"))).count()
    if broken:
        raise ValueError(f"{broken} elements left dangling")
    return left.groupBy("scene").agg(F.count_if(F.col("node_id").isNotNull()).alias("cards"), F.count_if(F.col("type") == "arrow").alias("arrows")).filter("cards > 0")


@query(f"WITH RECURSIVE {SCENES}, {_AT} SELECT scene, id AS node_id, 'changed' AS change, CASE WHEN status = 'done' THEN 'x' END AS fields FROM z WHERE status = 'done' UNION ALL SELECT scene, id, 'text', 'x' FROM z WHERE status = 'done'")
def x11_moved(spark, sf):
    """What a shift of the finished cards to the right changes of cards and texts."""
    e = _drawings(spark, sf)
    after = scene.moved(e, e.filter("status = 'done'").select("scene", "id", F.lit(1000.0).alias("dx"), F.lit(0.0).alias("dy")))
    c = scene.element_changes(e, after).filter("NOT id LIKE 'e-%'")
    return c.select("scene", F.expr("substring(id, 3)").alias("node_id"), F.when(F.col("id").startswith("t-"), "text").otherwise(F.col("change")).alias("change"), F.array_join("fields", ",").alias("fields"))


@query(f"WITH RECURSIVE {SCENES} SELECT scene, 'n-' || source AS source, 'n-' || target AS target, count(*) AS arrows FROM y GROUP BY ALL")
def x13_logical_edges(spark, sf):
    return scene.logical_edges(_drawings(spark, sf)).groupBy("scene", "source", "target").agg(F.count(F.lit(1)).alias("arrows"))


@query(f"WITH RECURSIVE {SCENES} SELECT scene, id AS node_id, CASE WHEN status = 'ready' THEN 'queued' ELSE status END AS status, depth < 2 AS kept FROM x")
def x7_merged(spark, sf):
    """Drawings of one hop brought up to date with the live graph of two hops, in which what was ready is queued."""
    nodes, edges = _parts(spark, sf)
    old = nodes.filter("depth < 2")
    ends = old.select("scene", "id")
    lines = edges.join(ends.withColumnRenamed("id", "source"), ["scene", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["scene", "target"], "left_semi")
    canvas = stored(scene.generate(scene.layered(old), lines), "canvas")
    live = nodes.withColumn("status", F.when(F.col("status") == "ready", "queued").otherwise(F.col("status")))
    now = stored(scene.merged(canvas, live, edges), "merged")
    if scene.arrows(now).count() != edges.count():
        raise ValueError("arrows were lost")
    before = canvas.filter("node_id IS NOT NULL").select("scene", "node_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    both = scene.cards(now).filter("NOT duplicate").join(before, ["scene", "node_id"], "left")
    return both.select("scene", "node_id", "status", (F.coalesce((F.col("x") == F.col("x0")) & (F.col("y") == F.col("y0")), F.lit(False))).alias("kept"))


@query(f"WITH RECURSIVE {SCENES}, q AS (SELECT scene, type FROM y WHERE type IN ('link', 'similar_to')) SELECT scene, count(*) AS added FROM y WHERE type NOT IN ('link', 'similar_to') GROUP BY 1")
def x4_edges_added(spark, sf):
    """Edges on drawings that a base with links and likenesses alone did not have."""
    nodes, edges = _parts(spark, sf)
    key = ["scene", "source", "target", "type"]
    one = lambda df: df.select(*key, F.lit(1).alias("here"))
    base = one(edges.filter("type IN ('link', 'similar_to')"))
    diff = scene.three_way(base, base, one(scene.arrows(_drawings(spark, sf))), key, ["here"])
    return diff.filter("change = 'added'").groupBy("scene").agg(F.count(F.lit(1)).alias("added"))


@query()
def x5_layers(spark, sf):
    """Layers of drawings by the longest way to each node; SQL that walks every way would not end."""
    return scene.layers(*_parts(spark, sf))
