"""Whiteboards: elements of a drawing as rows, their reading, comparison and audit.

``elements``: ``scene, id, type, x, y, width, height, index, text, container_id, frame_id,
start_id, end_id, deleted, node_id, node_type, status, edge_type``.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import geometry as g
from quillgraph.operators.context import closing_links
from quillgraph.session import discard, stored

ELEMENTS = (
    "array<struct<id:string,type:string,x:double,y:double,width:double,height:double,index:string,text:string,containerId:string,frameId:string,isDeleted:boolean,"
    "startBinding:struct<elementId:string>,endBinding:struct<elementId:string>,customData:struct<pkb:struct<nodeId:string,nodeType:string,status:string,edgeType:string>>>>"
)


def read_elements(scenes: DataFrame) -> DataFrame:
    """Elements of ``scene, json``; a scene that cannot be read has none."""
    e = F.explode(F.from_json("json", f"elements {ELEMENTS}")["elements"])
    return scenes.select("scene", e.alias("e")).select(
        "scene", "e.id", "e.type", "e.x", "e.y", "e.width", "e.height", "e.index", "e.text", F.col("e.containerId").alias("container_id"), F.col("e.frameId").alias("frame_id"),
        F.col("e.startBinding.elementId").alias("start_id"), F.col("e.endBinding.elementId").alias("end_id"), F.coalesce("e.isDeleted", F.lit(False)).alias("deleted"),
        F.col("e.customData.pkb.nodeId").alias("node_id"), F.col("e.customData.pkb.nodeType").alias("node_type"), F.col("e.customData.pkb.status").alias("status"), F.col("e.customData.pkb.edgeType").alias("edge_type"),
    )


def cards(elements: DataFrame) -> DataFrame:
    """Linked shapes with the text bound to them; of several with one node the first by id, the others marked."""
    live = elements.filter("NOT deleted")
    bound = live.filter("type = 'text' AND container_id IS NOT NULL").groupBy("scene", F.col("container_id").alias("id")).agg(F.min("text").alias("label"))
    shapes = live.filter("node_id IS NOT NULL AND type NOT IN ('arrow', 'line', 'text', 'frame')").join(bound, ["scene", "id"], "left")
    first = shapes.groupBy("scene", "node_id").agg(F.min("id").alias("first"))
    return shapes.join(first, ["scene", "node_id"]).select("scene", "id", "node_id", "node_type", "status", "label", "x", "y", "width", "height", "frame_id", (F.col("id") != F.col("first")).alias("duplicate"))


def arrows(elements: DataFrame) -> DataFrame:
    """Arrows between cards, with their kind: as stored, else by the prefix of their label, else link."""
    live = elements.filter("NOT deleted")
    ends = cards(elements).select("scene", F.col("id"), F.col("node_id"))
    label = live.filter("type = 'text'").groupBy("scene", F.col("container_id").alias("id")).agg(F.min("text").alias("label"))
    a = live.filter("type = 'arrow'").join(label, ["scene", "id"], "left")
    from_ = ends.select("scene", F.col("id").alias("start_id"), F.col("node_id").alias("source"))
    to = ends.select("scene", F.col("id").alias("end_id"), F.col("node_id").alias("target"))
    return a.join(from_, ["scene", "start_id"]).join(to, ["scene", "end_id"]).select("scene", "id", "source", "target", arrow_type(F.col("edge_type"), F.col("label")).alias("type"))


# Words for the kind of an arrow, and beginnings of labels that tell it.
_TYPE_WORDS = {
    "depends_on": "depends_on dep", "soft_depends_on": "soft_depends_on soft", "parent": "parent", "contributes_to": "contributes_to contrib", "closes": "closes",
    "supersedes": "supersedes", "similar_to": "similar_to sim",
}
_LABELS = {
    "depends_on": "dep: depends: depends_on:", "soft_depends_on": "soft: soft_dep:", "parent": "parent: child:", "contributes_to": "contrib: contributes: weight:",
    "closes": "close: closes:", "supersedes": "super: supersedes:", "similar_to": "sim: similar:",
}


def arrow_type(given: Column, label: Column) -> Column:
    """The kind stored with an arrow, else the one its label begins with, else ``link``."""
    word, said = F.lower(given), F.lower(F.trim(label))
    told = [F.when(word.isin(ws.split()), k) for k, ws in _TYPE_WORDS.items()]
    begun = [F.when(F.exists(F.array(*map(F.lit, ws.split())), lambda p: said.startswith(p)), k) for k, ws in _LABELS.items()]
    return F.coalesce(*told, *begun, F.lit("link"))


def card_text(status: Column, priority: Column, title: Column) -> Column:
    """What stands on a card: a header with status and priority, then the title."""
    header = F.when(status.isNotNull(), F.concat(F.lit("["), F.upper(status), F.coalesce(F.concat(F.lit(" · P"), priority.cast("string")), F.lit("")), F.lit("]")))
    return F.concat_ws("\n", header, title)


def parsed_card(text: Column) -> Column:
    """``status, priority, title, tags`` of a card's text: header, lines of tags, and the rest as title."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    header = r"^\[([A-Za-z_-]+)(?:\s*·\s*[Pp](\d+))?\]"
    head = F.get(F.filter(lines, lambda x: x.rlike(header)), F.lit(0))
    rest = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, header, ""))), lambda x: (x != "") & ~x.startswith("#"))
    tags = F.flatten(F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.regexp_extract_all(x, F.lit(r"#([\w-]+)"), 1)))
    return F.struct(F.lower(F.nullif(F.regexp_extract(head, header, 1), F.lit(""))).alias("status"), F.regexp_extract(head, header, 2).try_cast("int").alias("priority"), F.array_join(rest, " ").alias("title"), tags.alias("tags"))


# Sizes of what is drawn.
CARD = (220.0, 90.0)
STEP = (280.0, 170.0)
PADDING, HEADER, MARGIN = 32.0, 40.0, 24.0

COLUMNS = ["scene", "id", "type", "x", "y", "width", "height", "index", "text", "container_id", "frame_id", "start_id", "end_id", "deleted", "node_id", "node_type", "status", "edge_type"]


def _elements(df: DataFrame, **columns) -> DataFrame:
    """Elements with the given columns; the others are null."""
    kinds = {"x": "double", "y": "double", "width": "double", "height": "double", "deleted": "boolean"}
    given = {"deleted": F.lit(False)} | columns
    return df.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def layered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``scene, id, depth``) with ``x, y``: a row per depth, side by side by id; a scene has room for a bounded number of nodes."""
    place = F.row_number().over(Window.partitionBy("scene", "depth").orderBy("id")) - 1
    return nodes.withColumn("x", place * STEP[0]).withColumn("y", F.col("depth") * STEP[1])


def generate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of drawings: a card with bound text per node, an arrow per edge, a frame around the children of each node.

    ``nodes``: ``scene, id, label, node_type, status, priority, x, y``; ``edges``: ``scene, source, target, type``.
    """
    size = {"width": F.lit(CARD[0]), "height": F.lit(CARD[1])}
    at = nodes.select("scene", F.col("id").alias("child"), "x", "y")
    first = edges.filter("type = 'parent'").groupBy("scene", F.col("source").alias("child")).agg(F.min("target").alias("up"))
    held = at.join(first, ["scene", "child"])
    box = held.groupBy("scene", "up").agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max("x").alias("r"), F.max("y").alias("b"))
    frames = _elements(box, scene=F.col("scene"), id=F.concat(F.lit("f-"), "up"), type=F.lit("frame"), x=F.col("l") - PADDING, y=F.col("t") - PADDING - HEADER, width=F.col("r") - F.col("l") + CARD[0] + 2 * PADDING, height=F.col("b") - F.col("t") + CARD[1] + 2 * PADDING + HEADER)
    own = nodes.join(first.withColumnRenamed("child", "id"), ["scene", "id"], "left")
    frame = F.concat(F.lit("f-"), "up")
    shapes = _elements(own, scene=F.col("scene"), id=F.concat(F.lit("n-"), "id"), type=F.lit("rectangle"), x=F.col("x"), y=F.col("y"), frame_id=frame, node_id=F.col("id"), node_type=F.col("node_type"), status=F.col("status"), **size)
    texts = _elements(own, scene=F.col("scene"), id=F.concat(F.lit("t-"), "id"), type=F.lit("text"), x=F.col("x") + 8, y=F.col("y") + 8, width=F.lit(CARD[0] - 16), height=F.lit(CARD[1] - 16), text=card_text(F.col("status"), F.col("priority"), F.col("label")), container_id=F.concat(F.lit("n-"), "id"), frame_id=frame)
    drawn = frames.unionByName(shapes).unionByName(texts).unionByName(_arrows(edges))
    return indexed(rerouted(drawn))


def _arrows(edges: DataFrame) -> DataFrame:
    name = F.concat_ws("-", F.lit("e"), "type", "source", "target")
    return _elements(edges, scene=F.col("scene"), id=name, type=F.lit("arrow"), start_id=F.concat(F.lit("n-"), "source"), end_id=F.concat(F.lit("n-"), "target"), edge_type=F.col("type"))


def indexed(elements: DataFrame) -> DataFrame:
    """Elements without an order get one behind all that have one, by id; a drawing holds up to 62 * 62 new ones."""
    last = elements.groupBy("scene").agg(F.coalesce(F.max("index"), F.lit("a")).alias("__last"))
    place = F.row_number().over(Window.partitionBy("scene").orderBy(F.col("index").isNotNull(), "id")) - 1
    return elements.join(last, "scene").withColumn("index", F.coalesce("index", minted_index(F.col("__last"), place))).select(*COLUMNS)


def rerouted(elements: DataFrame) -> DataFrame:
    """Arrows bound at both ends run from the middle of one shape to that of the other."""
    mid = elements.filter("type <> 'arrow'").select("scene", F.col("id").alias("__i"), (F.col("x") + F.col("width") / 2).alias("__x"), (F.col("y") + F.col("height") / 2).alias("__y"))
    a, b = (mid.select("scene", F.col("__i").alias(c), F.struct("__x", "__y").alias(n)) for c, n in (("start_id", "__a"), ("end_id", "__b")))
    out = elements.join(a, ["scene", "start_id"], "left").join(b, ["scene", "end_id"], "left")
    both = (F.col("type") == "arrow") & F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for c, m in (("x", "__x"), ("y", "__y")):
        out = out.withColumn(c, F.when(both, F.least(F.col(f"__a.{m}"), F.col(f"__b.{m}"))).otherwise(F.col(c)))
    for c, m in (("width", "__x"), ("height", "__y")):
        out = out.withColumn(c, F.when(both, F.abs(F.col(f"__a.{m}") - F.col(f"__b.{m}"))).otherwise(F.col(c)))
    return out.select(*COLUMNS)


def to_json(elements: DataFrame) -> DataFrame:
    """``scene, json``: one document per drawing, its elements in order, as ``read_elements`` takes it."""
    bind = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("elementId")))
    pkb = F.struct(F.col("node_id").alias("nodeId"), F.col("node_type").alias("nodeType"), "status", F.col("edge_type").alias("edgeType"))
    own = F.when(F.coalesce("node_id", "edge_type").isNotNull(), F.struct(pkb.alias("pkb")))
    one = F.struct("index", "id", "type", "x", "y", "width", "height", "text", F.col("container_id").alias("containerId"), F.col("frame_id").alias("frameId"), F.col("deleted").alias("isDeleted"), bind("start_id").alias("startBinding"), bind("end_id").alias("endBinding"), own.alias("customData"))
    return elements.groupBy("scene").agg(F.array_sort(F.collect_list(one)).alias("elements")).select("scene", F.to_json(F.struct(F.lit("excalidraw").alias("type"), "elements")).alias("json"))


def merged(canvas: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The drawing brought up to date: cards keep their place, texts and states are those of the live nodes,
    new nodes stand in a column right of everything, and arrows between cards are drawn anew.

    ``nodes``: ``scene, id, label, node_type, status, priority``; ``edges``: ``scene, source, target, type``.
    """
    live = nodes.select("scene", F.col("id").alias("__id"), "label", F.col("node_type").alias("__type"), F.col("status").alias("__status"), "priority")
    shown = cards(canvas).filter("NOT duplicate").select("scene", F.col("id").alias("__card"), F.col("node_id").alias("__id"))
    # a card's own row, and the text bound to it
    of = shown.select("scene", F.col("__card").alias("__key"), "__id").join(live, ["scene", "__id"])
    key = F.when(F.col("type") == "text", F.col("container_id")).otherwise(F.col("id"))
    rows = stored(canvas.withColumn("__key", key).join(of, ["scene", "__key"], "left"), "rows")
    rows = rows.withColumn("status", F.when(F.col("node_id").isNotNull() & F.col("__id").isNotNull(), F.col("__status")).otherwise(F.col("status")))
    rows = rows.withColumn("node_type", F.when(F.col("node_id").isNotNull() & F.col("__id").isNotNull(), F.col("__type")).otherwise(F.col("node_type")))
    rows = rows.withColumn("text", F.when((F.col("type") == "text") & F.col("__id").isNotNull(), card_text(F.col("__status"), F.col("priority"), F.col("label"))).otherwise(F.col("text")))
    ends = cards(canvas).select("scene", "id")
    tied = rows.filter("type = 'arrow'").join(ends.withColumnRenamed("id", "start_id"), ["scene", "start_id"], "left_semi").join(ends.withColumnRenamed("id", "end_id"), ["scene", "end_id"], "left_semi")
    rest = rows.select(*COLUMNS).join(tied.select("scene", "id"), ["scene", "id"], "left_anti")
    edge = canvas.filter("NOT deleted").groupBy("scene").agg((F.max(F.col("x") + F.col("width")) + MARGIN).alias("__right"), F.min("y").alias("__top"))
    fresh = nodes.join(shown.select("scene", F.col("__id").alias("id")), ["scene", "id"], "left_anti").join(edge, "scene", "left")
    place = F.row_number().over(Window.partitionBy("scene").orderBy("id")) - 1
    fresh = fresh.withColumn("x", F.coalesce("__right", F.lit(0.0))).withColumn("y", F.coalesce("__top", F.lit(0.0)) + place * (CARD[1] + MARGIN))
    added = generate(fresh.select("scene", "id", "label", "node_type", "status", "priority", "x", "y"), edges.limit(0)).withColumn("index", F.lit(None).cast("string"))
    all_ = stored(rest.unionByName(added), "merged")
    names = cards(all_).filter("NOT duplicate").select("scene", "id", "node_id")
    lines = edges.join(names.select("scene", F.col("id").alias("__s"), F.col("node_id").alias("source")), ["scene", "source"]).join(names.select("scene", F.col("id").alias("__e"), F.col("node_id").alias("target")), ["scene", "target"])
    drawn = _elements(lines, scene=F.col("scene"), id=F.concat_ws("-", F.lit("e"), "type", "source", "target"), type=F.lit("arrow"), start_id=F.col("__s"), end_id=F.col("__e"), edge_type=F.col("type"))
    return indexed(rerouted(all_.unionByName(drawn)))


def corpus_changes(base_cards: DataFrame, live_cards: DataFrame, canvas_cards: DataFrame, base_edges: DataFrame, live_edges: DataFrame, canvas_edges: DataFrame, remove: bool = False) -> DataFrame:
    """``id, action, field, old, new``: what a drawing asks of the notes.

    Cards are ``id, title, status``, edges ``source, target, type``. New cards create notes,
    changed fields patch them, conflicts are reported; new arrows add edges, but a dependency
    or parent that would close a circle is rejected; only dependencies are removed, and only
    where asked for.
    """
    none = F.lit(None).cast("string")
    kinds = three_way(base_cards, live_cards, canvas_cards, ["id"], ["title", "status"])
    fields = lambda df, n: df.select("id", F.col("title").alias(f"title_{n}"), F.col("status").alias(f"status_{n}"))
    rows = kinds.join(fields(canvas_cards, "c"), "id", "left").join(fields(base_cards, "b"), "id", "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_b").alias("old"), F.col(f"{f}_c").alias("new")) for f in ("title", "status")])).alias("p")
    cells = rows.filter("change IN ('added', 'changed', 'conflict')").select("id", "change", pairs).select("id", "change", "p.*").filter(~F.col("old").eqNullSafe(F.col("new")))
    action = F.when(F.col("change") == "added", "create").when(F.col("change") == "changed", "update").otherwise("conflict")
    out = cells.select("id", action.alias("action"), "field", "old", "new")
    key = ["source", "target", "type"]
    fresh = canvas_edges.select(*key).distinct().join(live_edges.select(*key), key, "left_anti").join(base_edges.select(*key), key, "left_anti")
    hard = F.col("type").isin("depends_on", "parent")
    way = live_edges.filter(hard).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    closing = closing_links(way, fresh.filter(hard).select(F.col("source").alias("src"), F.col("target").alias("dst"))).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(True).alias("closes"))
    told = fresh.join(closing, ["source", "target"], "left")
    ok = F.when(hard & F.col("closes"), "reject").otherwise("add")
    out = out.unionByName(told.select(F.col("source").alias("id"), ok.alias("action"), F.col("type").alias("field"), none.alias("old"), F.col("target").alias("new")))
    if remove:
        lost = base_edges.filter("type = 'depends_on'").select(*key).distinct().join(canvas_edges.select(*key), key, "left_anti").join(live_edges.select(*key), key, "left_semi")
        out = out.unionByName(lost.select(F.col("source").alias("id"), F.lit("remove").alias("action"), F.col("type").alias("field"), F.col("target").alias("old"), none.alias("new")))
    return out


def with_shapes(elements: DataFrame, shapes: DataFrame) -> DataFrame:
    """Elements with new boxes and the text centred in them; ``shapes``: ``scene, id, text, x, y, width, height``."""
    size = g.text_size(F.col("text"))
    box = _elements(shapes, scene=F.col("scene"), id=F.col("id"), type=F.lit("rectangle"), **{c: F.col(c) for c in ("x", "y", "width", "height")})
    mid = {"x": F.col("x") + (F.col("width") - size["width"]) / 2, "y": F.col("y") + (F.col("height") - size["height"]) / 2, "width": size["width"], "height": size["height"]}
    text = _elements(shapes.filter("text IS NOT NULL"), scene=F.col("scene"), id=F.concat("id", F.lit("-text")), type=F.lit("text"), text=F.col("text"), container_id=F.col("id"), **mid)
    return indexed(elements.unionByName(box).unionByName(text))


def connected(elements: DataFrame, links: DataFrame) -> DataFrame:
    """Elements with arrows between shapes, and their labels; ``links``: ``scene, start_id, end_id, label``."""
    name = F.concat_ws("-", F.lit("c"), "start_id", "end_id")
    lines = _elements(links, scene=F.col("scene"), id=name, type=F.lit("arrow"), start_id=F.col("start_id"), end_id=F.col("end_id"))
    size = g.text_size(F.col("label"))
    said = _elements(links.filter("label IS NOT NULL"), scene=F.col("scene"), id=F.concat(name, F.lit("-text")), type=F.lit("text"), text=F.col("label"), container_id=name, x=F.lit(0.0), y=F.lit(0.0), width=size["width"], height=size["height"])
    return indexed(rerouted(elements.unionByName(lines).unionByName(said)))


def fitted(elements: DataFrame, texts: DataFrame, room: float = 16.0) -> DataFrame:
    """Elements with the texts of ``scene, id, text`` (of a text or its box) set, and boxes grown around their middle to hold them."""
    asked = texts.select("scene", F.col("id").alias("__i"), F.col("text").alias("__t"))
    own = F.when(F.col("type") == "text", F.coalesce("container_id", "id")).otherwise(F.col("id"))
    rows = elements.withColumn("__i", own).join(asked, ["scene", "__i"], "left")
    size = g.text_size(F.col("__t"))
    set_ = F.col("__t").isNotNull()
    is_text = F.col("type") == "text"
    wide = F.when(is_text, size["width"]).otherwise(F.greatest("width", size["width"] + room))
    high = F.when(is_text, size["height"]).otherwise(F.greatest("height", size["height"] + room))
    rows = rows.withColumn("__w", F.when(set_, wide).otherwise(F.col("width"))).withColumn("__h", F.when(set_, high).otherwise(F.col("height")))
    rows = rows.withColumn("x", F.col("x") - (F.col("__w") - F.col("width")) / 2).withColumn("y", F.col("y") - (F.col("__h") - F.col("height")) / 2)
    return rows.withColumn("width", F.col("__w")).withColumn("height", F.col("__h")).withColumn("text", F.when(set_ & is_text, F.col("__t")).otherwise(F.col("text"))).select(*COLUMNS)


def element_changes(before: DataFrame, after: DataFrame, fields: list[str] = ("x", "y", "width", "height", "text", "deleted", "start_id", "end_id")) -> DataFrame:
    """``scene, id, change, fields``: elements added, removed, or changed and in what."""
    key = ["scene", "id"]
    side = lambda df, n: df.select(*key, F.struct(*fields).alias(n))
    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    named = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return both.select(*key, kind.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), named).alias("fields")).filter("change <> 'changed' OR size(fields) > 0")


def three_way(base: DataFrame, live: DataFrame, canvas: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Per key what happened on the canvas and to the live rows since the base.

    ``added``, ``removed``, ``changed``, ``conflict`` (both sides changed, differently) or ``same``.
    """
    side = lambda df, p: df.select(*key, F.struct(*fields).alias(p))
    all_ = side(base, "b").join(side(live, "l"), key, "full_outer").join(side(canvas, "c"), key, "full_outer")
    mine, theirs = ~F.col("c").eqNullSafe(F.col("b")), ~F.col("l").eqNullSafe(F.col("b"))
    kind = (
        F.when(mine & theirs & ~F.col("c").eqNullSafe(F.col("l")), "conflict")
        .when(F.col("b").isNull() & F.col("c").isNotNull(), "added")
        .when(F.col("b").isNotNull() & F.col("c").isNull(), "removed")
        .when(mine, "changed")
        .otherwise("same")
    )
    return all_.select(*key, kind.alias("change"))


def _cells(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes in every grid cell they touch."""
    span = lambda a, w: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(w)) / size))
    return boxes.withColumn("cx", F.explode(span("x", "width"))).withColumn("cy", F.explode(span("y", "height")))


def overlaps(boxes: DataFrame, key: str = "id", size: float = 512.0) -> DataFrame:
    """``a, b`` with a < b: boxes that overlap, none within the other; only boxes of one grid cell meet."""
    at = _cells(boxes, size)
    p = at.select(F.col(key).alias("a"), "cx", "cy", *[F.col(c).alias(f"{c}1") for c in ("x", "y", "width", "height")])
    q = at.select(F.col(key).alias("b"), "cx", "cy", *[F.col(c).alias(f"{c}2") for c in ("x", "y", "width", "height")])
    m = p.join(q, ["cx", "cy"]).filter("a < b")
    one = [F.col(f"{c}1") for c in ("x", "y", "width", "height")]
    two = [F.col(f"{c}2") for c in ("x", "y", "width", "height")]
    return m.filter(g.boxes_overlap(*one, *two) & ~g.box_contains(*one, *two) & ~g.box_contains(*two, *one)).select("a", "b").distinct()


def zones(boxes: DataFrame, key: str = "id", least: int = 3, size: float = 512.0) -> DataFrame:
    """Boxes that contain at least ``least`` others: background rather than shapes."""
    at = _cells(boxes, size)
    p = at.select(F.col(key).alias("a"), "cx", "cy", *[F.col(c).alias(f"{c}1") for c in ("x", "y", "width", "height")])
    q = at.select(F.col(key).alias("b"), "cx", "cy", *[F.col(c).alias(f"{c}2") for c in ("x", "y", "width", "height")])
    inside = p.join(q, ["cx", "cy"]).filter("a <> b").filter(g.box_contains(*[F.col(f"{c}1") for c in ("x", "y", "width", "height")], *[F.col(f"{c}2") for c in ("x", "y", "width", "height")]))
    return inside.groupBy(F.col("a").alias(key)).agg(F.countDistinct("b").alias("inside")).filter(F.col("inside") >= least)


def crossings(lines: DataFrame, boxes: DataFrame, size: float = 512.0) -> DataFrame:
    """``line, box``: lines (``id, ax, ay, bx, by, start_id, end_id``) that run through boxes other than their ends."""
    low = lambda p, q: F.floor(F.least(p, q) / size)
    high = lambda p, q: F.floor(F.greatest(p, q) / size)
    at = lines.withColumn("cx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx")))).withColumn("cy", F.explode(F.sequence(low("ay", "by"), high("ay", "by")))).withColumnRenamed("id", "line")
    at = at.select("line", "ax", "ay", "bx", "by", "start_id", "end_id", "cx", "cy")
    met = at.join(_cells(boxes.select(F.col("id").alias("box"), "x", "y", "width", "height"), size), ["cx", "cy"]).filter("NOT (box <=> start_id) AND NOT (box <=> end_id)")
    hit = g.segment_hits_box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("x") + 1, F.col("y") + 1, F.col("width") - 2, F.col("height") - 2)
    return met.filter(hit).select("line", "box").distinct()


def integrity(elements: DataFrame) -> DataFrame:
    """``scene, id, problem``: repeated ids, missing or repeated order, dangling ends and containers."""
    ids = elements.select("scene", F.col("id").alias("other")).distinct()
    out = elements.groupBy("scene", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("scene", "id", F.lit("duplicate-id").alias("problem"))
    out = out.unionByName(elements.filter("index IS NULL").select("scene", "id", F.lit("no-index").alias("problem")))
    twice = elements.filter("index IS NOT NULL").groupBy("scene", "index").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).filter("n > 1")
    out = out.unionByName(twice.select("scene", "id", F.lit("duplicate-index").alias("problem")))
    for column, problem in (("container_id", "missing-container"), ("start_id", "dangling-start"), ("end_id", "dangling-end"), ("frame_id", "missing-frame")):
        lost = elements.filter(F.col(column).isNotNull()).join(ids, (elements["scene"] == ids["scene"]) & (elements[column] == ids["other"]), "left_anti")
        out = out.unionByName(lost.select("scene", "id", F.lit(problem).alias("problem")))
    half = elements.filter("type = 'arrow' AND (start_id IS NULL) <> (end_id IS NULL)").select("scene", "id", F.lit("half-bound").alias("problem"))
    return out.unionByName(half).distinct()


def summary(elements: DataFrame) -> DataFrame:
    """Counts and extent per scene and type."""
    return elements.filter("NOT deleted").groupBy("scene", "type").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))


def moved(elements: DataFrame, moves: DataFrame) -> DataFrame:
    """Elements shifted by ``scene, id, dx, dy``; bound text and the ends of attached arrows go along."""
    own = moves.select("scene", "id", "dx", "dy").unionByName(elements.filter("container_id IS NOT NULL").select("scene", F.col("id").alias("text"), F.col("container_id").alias("id")).join(moves, ["scene", "id"]).select("scene", F.col("text").alias("id"), "dx", "dy"))
    per = own.groupBy("scene", "id").agg(F.max("dx").alias("dx"), F.max("dy").alias("dy"))
    return elements.join(per, ["scene", "id"], "left").withColumn("x", F.col("x") + F.coalesce("dx", F.lit(0.0))).withColumn("y", F.col("y") + F.coalesce("dy", F.lit(0.0))).transform(rerouted).select(*elements.columns)


def without(elements: DataFrame, gone: DataFrame, arrows_too: bool = False) -> DataFrame:
    """Elements left when ``scene, id`` go, their bound text with them; bindings to them are taken off the others.

    ``arrows_too``: arrows that begin or end there go as well, with their labels.
    """
    if arrows_too:
        ends = gone.select("scene", F.col("id").alias("__g"))
        tied = elements.filter("type = 'arrow'").select("scene", "id", F.explode(F.array("start_id", "end_id")).alias("__g")).join(ends, ["scene", "__g"], "left_semi")
        gone = gone.select("scene", "id").unionByName(tied.select("scene", "id")).distinct()
    bound = elements.join(gone.select("scene", F.col("id").alias("container_id")), ["scene", "container_id"], "left_semi").select("scene", "id")
    dead = gone.select("scene", "id").unionByName(bound).distinct()
    left = elements.join(dead, ["scene", "id"], "left_anti")
    for column in ("start_id", "end_id", "frame_id"):
        lost = dead.select("scene", F.col("id").alias(column), F.lit(True).alias("__lost"))
        left = left.join(lost, ["scene", column], "left").withColumn(column, F.when(F.col("__lost").isNull(), F.col(column))).drop("__lost").select(*elements.columns)
    return left


def ranks(edges: DataFrame) -> DataFrame:
    """``id, rank``: longest-path layers of an acyclic ``src, dst`` graph (sources at 0), for layered layouts.

    No layer of an acyclic graph is beyond its number of nodes; a circle is an error.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    state = stored(nodes.withColumn("rank", F.lit(0)), "rank")
    nodes_n = state.count()
    for k in count(1):
        if k > nodes_n:
            raise ValueError("the graph has a circle")
        up = edges.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg((F.max("rank") + 1).alias("r"))
        after = stored(state.join(up, "id", "left").select("id", F.greatest("rank", F.coalesce("r", F.lit(0))).alias("rank"), (F.coalesce("r", F.lit(0)) > F.col("rank")).alias("moved")), "rank")
        more = after.filter("moved").take(1)
        discard(state)
        path, state = after._quillgraph_path, after.drop("moved")
        state._quillgraph_path = path
        if not more:
            break
    return state


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``scene, id, rank``: longest-path layers of drawings (``scene, id, depth``; ``scene, source, target``).

    An edge against the order of depth and id counts the other way round, so there are no circles.
    """
    at = nodes.select("scene", F.col("id").alias("source"), F.struct("depth", "id").alias("__a")), nodes.select("scene", F.col("id").alias("target"), F.struct("depth", "id").alias("__b"))
    key = lambda e: F.concat_ws("\x1f", "scene", e["id"])
    low, high = F.least("__a", "__b"), F.greatest("__a", "__b")
    along = edges.join(at[0], ["scene", "source"]).join(at[1], ["scene", "target"]).filter("source <> target").select(key(low).alias("src"), key(high).alias("dst")).distinct()
    found = ranks(stored(along, "along")).withColumnRenamed("id", "__k")
    return nodes.withColumn("__k", F.concat_ws("\x1f", "scene", "id")).join(found, "__k", "left").select("scene", "id", F.coalesce("rank", F.lit(0)).alias("rank"))


def arranged(layered_: DataFrame, edges: DataFrame, sweeps: int = 4) -> DataFrame:
    """``scene, id, rank, place``: within each layer nodes stand by the middle of their neighbours above, then below, and so on.

    ``layered_``: see ``layers``. Ties keep their order; fewer lines cross than by id.
    """
    w = Window.partitionBy("scene", "rank")
    state = stored(layered_.withColumn("place", F.row_number().over(w.orderBy("id")) - 1), "places")
    ends = edges.select("scene", F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select("scene", F.col("target").alias("id"), F.col("source").alias("other"))).distinct()
    for k in range(sweeps):
        near = state.select("scene", F.col("id").alias("other"), F.col("rank").alias("__r"), F.col("place").alias("__p"))
        side = F.col("__r") < F.col("rank") if k % 2 == 0 else F.col("__r") > F.col("rank")
        mid = state.join(ends, ["scene", "id"]).join(near, ["scene", "other"]).filter(side).groupBy("scene", "id").agg(F.avg("__p").alias("__m"))
        moved = state.join(mid, ["scene", "id"], "left").withColumn("__n", F.row_number().over(w.orderBy(F.coalesce("__m", F.col("place").cast("double")), "place")) - 1)
        old, state = state, stored(moved.select("scene", "id", "rank", F.col("__n").alias("place")), "places")
        discard(old)
    return state


# Digits of element order.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def minted_index(base: Column, k: Column) -> Column:
    """Order keys after ``base``: two more digits for the k-th new element (from 0); null beyond 62 * 62."""
    digits = F.lit(DIGITS)
    high, low = (k / len(DIGITS)).cast("int"), (k % len(DIGITS)).cast("int")
    return F.when(k.between(0, len(DIGITS) ** 2 - 1), F.concat(base, digits.substr(high + 1, F.lit(1)), digits.substr(low + 1, F.lit(1))))


def logical_edges(elements: DataFrame) -> DataFrame:
    """``scene, id, source, target, label``: arrows as edges between shapes; an end that is not bound is ``-``."""
    live = elements.filter("NOT deleted")
    label = live.filter("type = 'text'").groupBy("scene", F.col("container_id").alias("id")).agg(F.min("text").alias("label"))
    return live.filter("type = 'arrow'").join(label, ["scene", "id"], "left").select("scene", "id", F.coalesce("start_id", F.lit("-")).alias("source"), F.coalesce("end_id", F.lit("-")).alias("target"), "label")
