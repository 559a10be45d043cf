import json
from datetime import date
from datetime import datetime as d

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import geometry as g
from quillgraph.functions import text as t
from quillgraph.functions.vectors import cosine, normalised
from quillgraph.operators import changes, chunkers, filters, model, quality, retrieval, scene, stats
from quillgraph.operators.filters import FilterSet
from quillgraph.plans.skew import even_labels, lookup_join
from quillgraph.sources import readers, writers
from quillgraph.streaming import telemetry


def one(spark, expr, *values, types=None):
    names = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, types or ["string"] * len(values)))
    return spark.createDataFrame([values], schema).select(expr(*map(F.col, names)).alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, t.slugify, "  Héllo, World! -- x ") == "héllo-world-x"
    assert one(spark, lambda c: t.slugify(c, 6), "abc def ghi") == "abc-de"
    assert one(spark, lambda c: t.cut_bytes(c, 4), "aéé") == "aé" and one(spark, lambda c: t.cut_bytes(c, 9), "aéé") == "aéé"
    assert one(spark, t.word_count, " a b\n\tc ") == 3 and one(spark, t.word_count, None) == 0
    assert one(spark, t.wikilinks, "see [[a1|b]] and [[ c0 #x]] [[]]") == ["a1", "c0"]
    assert one(spark, t.markdown_links, "[x](y.md) [z](http://q) [w](#p)") == ["y.md"]
    assert one(spark, t.hashtags, "# Head\n#One two #two-3 a#b #one") == ["one", "two-3"]
    assert one(spark, t.first_heading, "text\n## The Head ##\n# Other") == "The Head" and one(spark, t.first_heading, "none") is None
    assert one(spark, t.content_hash, "a\r\nb") == one(spark, t.content_hash, "a\nb")
    assert [one(spark, t.effort_days, x) for x in ("1d", "3w", "2h", "10h", "5", "", "x", None)] == [1, 21, 1, 2, 5, None, None, None]
    assert one(spark, t.xml_escape, "<a & 'b'>") == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, lambda a, b: t.jaccard(t.word_set(a), t.word_set(b)), "A b c", "b c d") == 0.5 and one(spark, lambda a, b: t.jaccard(t.word_set(a), t.word_set(b)), "", None) == 1.0


def test_vectors(spark):
    kinds = ["array<float>"] * 2
    assert one(spark, cosine, [1.0, 0.0], [1.0, 1.0], types=kinds) == pytest.approx(0.70710678)
    assert one(spark, cosine, [0.0, 0.0], [1.0, 1.0], types=kinds) == 0 and one(spark, cosine, [1.0], [1.0, 1.0], types=kinds) == 0
    assert one(spark, lambda a, _: normalised(a), [3.0, 4.0], [], types=kinds) == pytest.approx([0.6, 0.8])


def test_geometry(spark):
    n = ["double"] * 8
    assert one(spark, g.segments_cross, 0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0, types=n)
    assert not one(spark, g.segments_cross, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 0.0, types=n)
    assert one(spark, g.boxes_overlap, 0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 2.0, 2.0, types=n) and not one(spark, g.boxes_overlap, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 2.0, 2.0, types=n)
    assert one(spark, g.segment_hits_box, -1.0, 1.0, 3.0, 1.0, 0.0, 0.0, 2.0, 2.0, types=n)


NODE = "id string, parent string, project string, label string, status string, node_type string, priority int, tags array<string>, created string, recorded_at timestamp, assignee string, path string"


def test_filters(spark):
    n = spark.createDataFrame(
        [
            ("a", None, None, "Alpha note", "ready", "task", 1, ["x", "y"], "2024-01-01", d(2024, 1, 1), None, "tasks/a.md"),
            ("b", "a", "P1", "Beta", "done", "task", 3, ["x"], "2024-12-30", d(2024, 12, 30), "kim", "tasks/b.md"),
            ("c", "b", None, "Gamma", None, "note", None, None, "someday", d(2024, 6, 1), None, "notes/c.md"),
        ],
        NODE,
    )
    ids = lambda f, **k: sorted(r["id"] for r in f.apply(n, **k).collect())
    as_of = date(2025, 1, 1)
    assert ids(FilterSet()) == ["a", "b", "c"] and FilterSet().is_empty()
    assert ids(FilterSet(tags=("x", "y"))) == ["a"] and ids(FilterSet(priority_gte=1)) == ["a", "b"]
    assert ids(FilterSet(older_than_days=30, as_of=as_of)) == ["a", "c"] and ids(FilterSet(stale_days=100, as_of=as_of)) == ["a", "c"]
    assert ids(FilterSet(project=("p1",))) == ["b"] and ids(FilterSet(project=("p1",), include_untagged=True)) == ["a", "b", "c"]
    assert ids(FilterSet(orphan=True)) == ["a"] and ids(FilterSet(parent="a")) == ["b"] and ids(FilterSet(title_contains="NOTE")) == ["a"]
    kids = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert ids(FilterSet(subtree="b"), children=kids) == ["b", "c"] and ids(FilterSet(subtree="nope"), children=kids) == []
    assert FilterSet.from_dict({"status": "ready", "tags": ["x"]}).describe() == "status=ready, tags=('x',)"
    with pytest.raises(ValueError):
        FilterSet.from_dict({"nope": 1})
    assert [r["id"] for r in filters.tagged(n, ["Y"]).collect()] == ["a"]


def test_model(spark):
    n = spark.createDataFrame([("A", "perma", None, "docs/A.md", d(2024, 1, 1), None), ("b", None, None, "x/stem.md", d(2024, 1, 1), None), ("b", None, None, "x/stem.md", d(2023, 1, 1), None)], "id string, permalink string, parent string, path string, recorded_at timestamp, deleted_at timestamp")
    cur = model.current_nodes(n)
    assert cur.count() == 2
    e = spark.createDataFrame([("A", "[[b]]", "link"), ("A", "b", "link"), ("b", "PERMA", "parent"), ("b", "b", "link"), ("A", "lost", "link"), ("A", None, "link")], "source string, target string, type string")
    r = model.resolved_edges(e, cur)
    assert {tuple(x) for x in r.collect()} == {("A", "b", "link"), ("b", "A", "parent")}
    assert {x["id"]: x["references"] for x in model.ghosts(e, cur).collect()} == {"lost": 1}
    q = spark.createDataFrame([("a",), ("stem",), ("perma.md",), ("docs/a.md",), ("zzz",)], "query string")
    assert {x["query"]: x["id"] for x in model.resolve_flexible(q, cur).collect()} == {"a": "A", "stem": "b", "perma.md": "A", "docs/a.md": "A"}


def test_even_labels(spark):
    labels = even_labels(spark, 13)
    spread = spark.createDataFrame([(k,) for k in labels], "k int").repartition(13, "k").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread == 13


def test_retrieval(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[5] = v[4]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(99, None)], "vec_id bigint, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u.astype(np.float64) @ u.T.astype(np.float64)
    got = retrieval.nearest(rows, rows.filter("vec_id % 20 = 0"), 3).collect()
    for q in (0, 20, 40):
        want = [k for k in np.lexsort((np.arange(60), -s[q])) if k != q][:3]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    near = {(r["query"], r["vec_id"]) for r in retrieval.within(rows, rows.filter("vec_id = 4"), 0.5).collect()}
    assert near == {(4, k) for k in range(60) if k != 4 and s[4, k] >= 0.5}
    base = rng.normal(size=(40, 8))
    twin = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape)]).astype(np.float32)
    pairs = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(twin)], "vec_id bigint, embedding array<float>")
    w = twin / np.linalg.norm(twin, axis=1, keepdims=True)
    truth = {(a, b) for a in range(80) for b in range(a + 1, 80) if w[a] @ w[b] >= 0.85}
    found = {(r["a"], r["b"]) for r in retrieval.similarity_join(pairs).collect()}
    assert found <= truth and len(found) >= 0.9 * len(truth) > 0
    assert retrieval.similarity_join(pairs.limit(0)).count() == 0
    gold = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "query int, expected array<string>")
    res = spark.createDataFrame([(1, "q", 1), (1, "y", 2)], "query int, id string, rank int")
    m = retrieval.evaluate(res, gold).first()
    assert (m["queries"], m["mrr"], m["recall"], m["hit_rate"]) == (2, 0.25, 0.25, 0.5)
    near = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, id string, depth int")
    vec = spark.createDataFrame([(1, "a", 0.8)], "query int, id string, score double")
    assert {r["id"]: r["score"] for r in retrieval.hybrid(vec, near).collect()} == {"a": 0.7, "b": 0.15}


def test_title_pairs_against_brute_force(spark):
    import itertools
    import random

    r = random.Random(1)
    titles = {f"t{k}": " ".join(r.sample("a b c d e f g h".split(), r.randrange(1, 6))) for k in range(60)} | {"none": None, "empty": ""}
    want = set()
    for x, y in itertools.combinations(sorted(titles), 2):
        p, q = set((titles[x] or "").split()), set((titles[y] or "").split())
        if p and q and len(p & q) >= 0.7 * len(p | q):
            want.add((x, y))
    got = retrieval.title_pairs(spark.createDataFrame(list(titles.items()), "id string, label string")).collect()
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want)


def test_chunkers():
    assert chunkers.markdown_chunks("short") == ["short"] and chunkers.markdown_chunks(None) == []
    text = "# Head\n\n" + "A sentence here. " * 200 + "\n\n```\nx\n\ny\n```\n\ntail"
    parts = chunkers.markdown_chunks(text, 400)
    assert all(len(p.encode()) <= 400 for p in parts) and parts[0].startswith("Head\n\nA sentence") and any("x\n\ny" in p for p in parts)
    fixed = chunkers.fixed_chunks("é" * 3000 + ". " + "b" * 3000, 2000, 500, 300)
    assert all(len(p.encode()) <= 2000 for p in fixed) and fixed[0][0] == "é" and fixed[-1][-1] == "b"


def test_quality(spark):
    docs = spark.createDataFrame(
        [("a.md", "a", "T", "task", "ready", "p", '{"id": "a"}', "x  \ny \n\n\n\n\nz"), ("b.md", "B b", " ", None, "", None, "{broken", "ok\n```\n"), ("c.md", "c", "T", "t", "s", "p", None, None)],
        "path string, id string, title string, doc_type string, status string, project string, frontmatter string, body string",
    )
    got = {(r["path"], r["rule"], r["line"]) for r in quality.lint(docs).collect()}
    assert {("a.md", "md-trailing-ws", 2), ("a.md", "md-consecutive-blanks", 5), ("a.md", "md-no-final-newline", 0), ("b.md", "fm-no-title", 0), ("b.md", "doc-no-type", 0), ("b.md", "fm-parse-error", 0), ("b.md", "md-open-fence", 0), ("c.md", "fm-missing", 0)} <= got
    assert not {x for x in got if x[0] == "c.md" and x[1].startswith("md-")}
    fixed = docs.select("path", quality.fix_body(F.col("body")).alias("b")).withColumn("twice", quality.fix_body(F.col("b"))).collect()
    assert all(r["b"] == r["twice"] for r in fixed) and fixed[0]["b"] == "x  \ny\n\n\nz\n"
    assert quality.summary(quality.lint(docs)).filter("rule = 'md-trailing-ws'").first()["n"] == 1


def test_changes(spark):
    rows = spark.createDataFrame([("a", 1, ["x"]), ("b", None, None)], "id string, priority int, tags array<string>")
    c = changes.set_field(rows, "priority", F.lit(1))
    assert [(r["id"], r["old"], r["new"]) for r in c.collect()] == [("b", None, "1")]
    assert {tuple(r)[:2] for r in changes.apply_changes(rows, c, ["priority"]).collect()} == {("a", 1), ("b", 1)}
    p = spark.createDataFrame([("a", None, None, True), ("b", 7, ["z"], False), ("n", 9, None, None)], "id string, priority int, tags array<string>, removed boolean")
    assert {(r["id"], r["priority"]) for r in changes.patch(rows, p, ["priority", "tags"]).collect()} == {("b", 7), ("n", 9)}
    e = spark.createDataFrame([("a", "b", "link"), ("c", "[[A]]", "link")], "source string, target string, type string")
    r = spark.createDataFrame([("a", "b")], "old string, new string")
    assert {tuple(x) for x in changes.rename_references(e, r).collect()} == {("c", "b", "link")}
    kept, log = changes.merge_nodes(e, spark.createDataFrame([("a", "b"), ("b", "b")], "id string, survivor string"))
    assert kept.count() == 1 and [x["new"] for x in log.collect()] == ["b"]
    edit = rows.select(changes.edit_list(F.col("tags"), F.array(F.lit("y"), F.lit("x")), F.array(F.lit("x"))).alias("t")).collect()
    assert [x["t"] for x in edit] == [["y"], ["y"]]
    w = spark.range(1).select(changes.decayed(F.lit(1.0), F.lit("2024-01-01").cast("date"), F.lit("2024-01-11").cast("date")).alias("w"), changes.recency(F.lit(90)).alias("r")).first()
    assert w["w"] == pytest.approx(0.60653, abs=1e-5) and w["r"] == 0
    t_ = changes.inherit_template(spark.createDataFrame([("a", "t", None), ("b", "t", 5)], "id string, template_id string, sev int"), spark.createDataFrame([("t", 3)], "id string, sev int"), ["sev"])
    assert {(x["id"], x["sev"]) for x in t_.collect()} == {("a", 3), ("b", 5)}


def box(i, x, y, w=100.0, h=50.0, kind="rectangle", **more):
    return {"id": i, "type": kind, "x": x, "y": y, "width": w, "height": h, "index": i, **more}


def test_scene(spark):
    pkb = lambda n: {"customData": {"pkb": {"nodeId": n}}}
    elements = [
        box("r1", 0.0, 0.0, **pkb("n1")), box("r2", 50.0, 20.0, **pkb("n2")), box("r3", 900.0, 900.0, **pkb("n1")), box("t1", 5.0, 5.0, 10.0, 10.0, "text", text="Card one", containerId="r1"),
        box("z1", 300.0, 0.0, 100.0, 400.0), {"id": "a1", "type": "arrow", "x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0, "index": "a1", "startBinding": {"elementId": "r1"}, "endBinding": {"elementId": "r2"}},
        box("t2", 0.0, 0.0, 1.0, 1.0, "text", text="Depends: on it", containerId="a1"), {"id": "a2", "type": "arrow", "x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0, "index": "a2", "startBinding": {"elementId": "gone"}},
    ]
    e = scene.read_elements(spark.createDataFrame([("s", json.dumps({"elements": elements})), ("bad", "{")], "scene string, json string")).cache()
    cards = {r["id"]: r for r in scene.cards(e).collect()}
    assert cards["r1"]["label"] == "Card one" and cards["r3"]["duplicate"] and not cards["r1"]["duplicate"] and "z1" not in cards
    assert [tuple(r)[2:] for r in scene.arrows(e).collect()] == [("n1", "n2", "depends_on")]
    assert {(r["id"], r["problem"]) for r in scene.integrity(e).collect()} == {("a2", "dangling-start"), ("a2", "half-bound")}
    boxes = e.filter("type = 'rectangle'")
    assert [tuple(r) for r in scene.overlaps(boxes).collect()] == [("r1", "r2")]
    lines = spark.createDataFrame([("l", 0.0, 100.0, 600.0, 110.0, "r1", None)], "id string, ax double, ay double, bx double, by double, start_id string, end_id string")
    assert [tuple(r) for r in scene.crossings(lines, boxes).collect()] == [("l", "z1")]
    moved = {r["id"]: r["x"] for r in scene.moved(e, spark.createDataFrame([("s", "r1", 10.0, 0.0)], "scene string, id string, dx double, dy double")).collect()}
    assert moved["r1"] == 10.0 and moved["t1"] == 15.0 and moved["r2"] == 50.0
    left = {r["id"]: r for r in scene.without(e, spark.createDataFrame([("s", "r1")], "scene string, id string")).collect()}
    assert not {"r1", "t1"} & set(left) and left["a1"]["start_id"] is None
    assert {(r["id"], r["source"], r["target"], r["label"]) for r in scene.logical_edges(e).collect()} == {("a1", "r1", "r2", "Depends: on it"), ("a2", "gone", "-", None)}
    keys = spark.range(3).select(scene.minted_index(F.lit("a0"), F.col("id") * 62).alias("k")).collect()
    assert [r["k"] for r in keys] == ["a000", "a010", "a020"]
    side = lambda rows: spark.createDataFrame(rows, "id string, v int")
    diff = scene.three_way(side([("a", 1), ("b", 1), ("c", 1), ("d", 1)]), side([("a", 1), ("b", 2), ("c", 1), ("d", 2)]), side([("a", 1), ("b", 3), ("n", 1), ("d", 1)]), ["id"], ["v"])
    assert {r["id"]: r["change"] for r in diff.collect()} == {"a": "same", "b": "conflict", "c": "removed", "n": "added", "d": "same"}
    assert {r["id"]: r["rank"] for r in scene.ranks(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")).collect()} == {"a": 0, "b": 1, "c": 2}


def test_stats(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(10)] + [("b", None)], "g string, v double")
    r = stats.percentiles(df, "g", "v").collect()
    assert [(x["p50"], x["p95"], x["n"]) for x in r] == [(5.0, 9.0, 10)]
    one_row = spark.createDataFrame([(1, 2)], "a int, b int")
    assert stats.change_token(one_row) == stats.change_token(one_row.select("b", "a")) != stats.change_token(one_row.select("a"))


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "notes" / "one.md").write_text("---\nid: n-1\ntitle: One\ntags: [a, b]\ntype: note\n---\nBody #c\n")
    (tmp_path / "two.md").write_text("# Second\n\ntext")
    (tmp_path / "broken.md").write_text("---\ntitle: a: b: c\nid: x-1\n---\nrest")
    (tmp_path / "latin.md").write_bytes(b"\xff\xfe\xff")
    (tmp_path / ".hidden" / "no.md").write_text("x")
    (tmp_path / "node_modules" / "no.md").write_text("x")
    (tmp_path / "drafts").mkdir()
    (tmp_path / "drafts" / "no.md").write_text("x")
    (tmp_path / "notes" / "tmp-1.md").write_text("x")
    (tmp_path / ".gitignore").write_text("# rules\ndrafts/\ntmp-*.md\n")
    notes = readers.read_markdown(spark, str(tmp_path))
    docs = {r["path"]: r for r in readers.documents(notes).collect()}
    assert set(docs) == {"notes/one.md", "two.md", "broken.md"}
    assert (docs["notes/one.md"]["id"], docs["notes/one.md"]["title"], docs["notes/one.md"]["tags"]) == ("n-1", "One", ["a", "b", "c"])
    assert (docs["two.md"]["id"], docs["two.md"]["title"]) == ("two", "Second") and docs["broken.md"]["parsed"] == "lines" and docs["broken.md"]["id"] == "x-1"
    assert {r["path"].rpartition("/")[2] for r in readers.read_glob(spark, str(tmp_path)).collect()} == {"two.md", "broken.md"}
    assert readers.read_glob(spark, str(tmp_path / "notes" / "o*.md")).count() == 1
    assert readers.table_column("# A\n\n## Values\n\n| x | y |\n| - | - |\n| `one`, `two` | n |\n| `three` | |\n\n## B\n| `no` |", "Values") == ["one", "two", "three"]
    raw = spark.createDataFrame([("p", "---\na: 1\nb: 2\na: 3\n---\n")], "path string, text string")
    assert [(r["key"], r["n"]) for r in readers.repeated_keys(raw).collect()] == [("a", 2)]


def test_files_and_exports(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.swap(spark.range(3), path)
    writers.swap(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    vec = spark.createDataFrame([(1, [[1.0, 2.0]])], "entry_id bigint, chunk_embeddings array<array<float>>")
    writers.swap(vec, path)
    assert readers.read_vectors(spark, path, 2).count() == 1 and readers.read_vectors(spark, path, 3).count() == 0
    n = spark.createDataFrame([("a<", None), ("b", "x&y")], "id string, label string")
    e = spark.createDataFrame([("a<", "b", "link")], "source string, target string, type string")
    lines = "\n".join(r["value"] for r in writers.graphml(n, e, ["label"]).orderBy("part", "value").collect())
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(lines.encode()).findall(".//{*}node")) == 2
    assert {json.loads(r["json"]).get("id") for r in writers.graph_json(n, e).filter("kind = 'node'").collect()} == {"a<", "b"}
    reg = tmp_path / "reg.yaml"
    reg.write_text("projects:\n  p1:\n    aliases: [one]\n  p2: {}\nproject_aliases:\n  two: p2\n")
    assert {tuple(r) for r in readers.read_registry(spark, str(reg)).collect()} == {("p1", "p1"), ("p1", "one"), ("p2", "p2"), ("p2", "two"), ("task", "task"), ("adhoc-sessions", "adhoc-sessions")}


def test_streams(spark, tmp_path):
    log, table, mark = (str(tmp_path / x) for x in ("log", "table", "mark"))
    rows = [(d(2024, 1, 1), "search", 123, 7, False), (d(2024, 1, 1), "search", 456, 9, True), (d(2024, 1, 2), "get", 10, 1, False)]
    calls = spark.createDataFrame(rows, readers.TELEMETRY)
    writers.append_log(calls, log)
    (tmp_path / "log" / "bad.json").write_text("{nope\n")
    assert readers.read_telemetry(spark, log).count() == 3
    q = telemetry.running_stats(telemetry.stream_calls(spark, log)).writeStream.outputMode("complete").format("memory").queryName("calls_so_far").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["tool_name"]: (r["calls"], r["bytes"], r["errors"]) for r in spark.sql("SELECT * FROM calls_so_far").collect()}
    assert got == {"search": (2, 579, 1), "get": (1, 10, 0)}
    stream = telemetry.stream_calls(spark, log).select(F.col("tool_name").alias("id"), "timestamp", "latency_ms")
    for _ in range(2):
        telemetry.upsert_stream(stream, table, "id", "timestamp", mark).awaitTermination()
    assert {r["id"]: r["latency_ms"] for r in spark.read.parquet(table).collect()} == {"search": 9, "get": 1}
    w = telemetry.windowed(telemetry.stream_calls(spark, log), "timestamp", by="tool_name", value="latency_ms").writeStream.outputMode("append").format("memory").queryName("by_day").trigger(availableNow=True).start()
    w.awaitTermination()


def test_markdown_chunks_as_defined():
    md = "# Section\n\nShort.\n\nAlso short.\n\nYet another short line."
    assert chunkers.markdown_chunks(md) == [md]
    # below the limit nothing is cut; above it headings lead what follows and are no chunks
    cut = chunkers.markdown_chunks(md, limit=40, least=30)
    assert cut == ["Section\n\nShort.\n\nSection\n\nAlso short.", "Section\n\nYet another short line."]
    long = " ".join(f"Sentence number {k} with some extra words to pad it out." for k in range(200))
    parts = chunkers.markdown_chunks(f"# Big Section\n\n{long}")
    assert len(parts) > 1 and max(map(len, parts)) <= 1500 and parts[0].startswith("Big Section") and " ".join(parts).split()[2:] == long.split()
    code = "# Code\n\nintro text\n\n```rust\nfn main() {\n\n    let x = 42;\n}\n```\n\nafter"
    assert any("fn main" in c and "let x = 42" in c for c in chunkers.markdown_chunks(code, limit=60, least=5))
    # a sentence has more than ten bytes; a short tail joins the piece before
    assert chunkers.sentences("A. B. Long enough now. Yes! No.") == ["A. B. Long enough now.", "Yes! No."]
    assert chunkers.markdown_chunks("a" * 300 + ". " + "b" * 20, limit=310, least=100) == ["a" * 300 + ". " + "b" * 20]


def test_fixed_chunks_as_defined():
    assert chunkers.fixed_chunks("") == [] and chunkers.fixed_chunks("  x ") == ["x"]
    assert [len(c) for c in chunkers.fixed_chunks("a" * 3000)] == [2000, 1500]
    text = "x" * 150 + ". " + "y" * 3000
    first, second = chunkers.fixed_chunks(text, 2000, 100, 10)[:2]
    assert first == "x" * 150 + "." and second.startswith("x" * 99 + ".")
    # sentence ends before the hundredth byte do not count, and what is too small joins the one before
    assert chunkers.fixed_chunks("x" * 50 + ". " + "y" * 100, 120, 0, 60) == ["x" * 50 + ". " + "y" * 68 + " " + "y" * 32]


def test_states_and_lists(spark):
    from quillgraph.operators import tasks

    n = spark.createDataFrame(
        [("a", "task", "ready"), ("b", "task", "done"), ("c", "task", "ready"), ("d", "task", "queued"), ("e", "epic", "ready"), ("f", "task", None), ("g", "note", "completed")], "id string, node_type string, status string"
    )
    e = spark.createDataFrame([("a", "b", "depends_on"), ("c", "f", "depends_on"), ("d", "c", "depends_on"), ("a", "e", "parent")], "source string, target string, type string")
    assert {tuple(r) for r in tasks.states(n, e).collect()} == {("a", "ready"), ("c", "blocked"), ("d", "blocked")}
    assert {tuple(r) for r in tasks.states(n, e, handed_on=False).collect()} == {("a", "ready"), ("c", "blocked"), ("d", "blocked")}
    assert sorted(r["id"] for r in tasks.listed(n).collect()) == ["a", "c", "d", "e", "f"]
    assert {r["id"] for r in tasks.reachable(n, e).collect()} == {"a", "b", "c", "d", "e", "f"}
    links = spark.createDataFrame([("a", "e"), ("e", None), ("x", "y"), ("y", "x"), ("z", "a")], "id string, parent string")
    up = tasks.nearest_above(links, spark.createDataFrame([("e",)], "id string"), itself=True)
    assert {(r["id"], r["ancestor"], r["steps"], "".join(r["chain"])) for r in up.collect()} == {("a", "e", 1, "ae"), ("z", "e", 2, "zae"), ("e", "e", 0, "e")}
    ids = spark.createDataFrame([("a.1",), ("a.12",), ("b.x",)], "id string")
    assert {tuple(r) for r in tasks.next_numbers(ids, n).collect()} >= {("a", 13), ("b", 1)}
    w = spark.createDataFrame([("a", "b", 0.9), ("c", "b", 0.9), ("d", "b", 0.5)], "source string, target string, weight double")
    m = n.withColumn("modified", F.when(F.col("id") == "c", "unknown").otherwise("2024-01-01T00:00:00Z"))
    assert [tuple(r)[:2] for r in tasks.divergences(w, m, n.limit(0), date(2024, 6, 1)).collect()] == [("a", "b")]


def test_rules_about_frontmatter(spark):
    docs = spark.createDataFrame(
        [
            ("ok", "a-1234abcd", "T", "task", "done", "p", "x\n", '{"id": "a-1234abcd", "type": "task", "status": "done", "priority": 2, "tags": ["x"]}'),
            ("bad", "b", "T", "task", "done", "p", "x\n", '{"id": "b", "type": "task", "status": "todo", "priority": 9, "tags": 3, "effort": "soon", "odd": 1, "body": "x"}'),
            ("kinds", "c", "T", "task", "done", "p", "x\n", '{"task_id": "c", "type": 7, "priority": "p1"}'),
            ("list", "d", "T", "task", "done", "p", "x\n", "[1]"),
            ("broken", "e", "T", "task", "done", "p", "a \nb\n\n\n\n\nc\n", "{no"),
            ("null", "f", None, None, None, None, None, None),
        ],
        "path string, id string, title string, doc_type string, status string, project string, body string, frontmatter string",
    )
    got = {}
    for r in quality.lint(docs).collect():
        got.setdefault(r["path"], set()).add((r["rule"], r["line"]))
    assert "ok" not in got
    assert {r for r, _ in got["bad"]} == {"fm-status-alias", "fm-priority-range", "fm-tags-type", "fm-invalid-effort", "fm-unknown-key", "fm-id-format", "fm-prohibited-body"}
    assert {r for r, _ in got["kinds"]} == {"fm-type-not-string", "fm-priority-type", "task-legacy-id"}
    assert {r for r, _ in got["list"]} == {"fm-invalid"}
    assert got["broken"] == {("fm-parse-error", 0), ("md-trailing-ws", 1), ("md-consecutive-blanks", 5), ("md-consecutive-blanks", 6)}
    assert {r for r, _ in got["null"]} == {"fm-missing", "fm-no-title", "doc-no-type", "task-no-status", "fm-missing-project"}


def test_filters_resolve(spark):
    n = spark.createDataFrame([("a", None, "P1"), ("b", "a", "one"), ("c", "a", None)], "id string, parent string, project string")
    keys = spark.createDataFrame([("a", "a")], "key string, id string")
    projects = spark.createDataFrame([("p1", ["one", "uno"]), ("p2", None)], "slug string, aliases array<string>")
    ids = lambda f, **k: sorted(r["id"] for r in f.apply(n, **k).collect())
    assert ids(FilterSet(parent="[[docs/A.md]]"), keys=keys) == ["b", "c"] and ids(FilterSet(parent="nothing"), keys=keys) == ["a"]
    assert ids(FilterSet(project=("uno",)), projects=projects) == ["a", "b"] and ids(FilterSet(project=("UNO",), include_untagged=True), projects=projects) == ["a", "b", "c"]


def test_drawing_edits(spark):
    from quillgraph.operators import scene

    e = scene.with_shapes(spark.createDataFrame([], ", ".join(f"{c} {'double' if c in ('x', 'y', 'width', 'height') else 'boolean' if c == 'deleted' else 'string'}" for c in scene.COLUMNS)), spark.createDataFrame([("s", "p", "Hello", 0.0, 0.0, 100.0, 50.0), ("s", "q", None, 300.0, 0.0, 100.0, 50.0)], "scene string, id string, text string, x double, y double, width double, height double"))
    e = scene.connected(e, spark.createDataFrame([("s", "p", "q", "dep: x")], "scene string, start_id string, end_id string, label string"))
    by = {r["id"]: r for r in e.collect()}
    assert set(by) == {"p", "p-text", "q", "c-p-q", "c-p-q-text"} and (by["c-p-q"]["x"], by["c-p-q"]["width"]) == (50.0, 300.0)
    assert scene.integrity(e).count() == 0 and len({r["index"] for r in by.values()}) == 5
    after = {r["id"]: r for r in scene.moved(e, spark.createDataFrame([("s", "q", 100.0, 40.0)], "scene string, id string, dx double, dy double")).collect()}
    assert (after["q"]["x"], after["c-p-q"]["width"], after["c-p-q"]["height"]) == (400.0, 400.0, 40.0)
    fit = {r["id"]: r for r in scene.fitted(e, spark.createDataFrame([("s", "p", "a much longer text than before")], "scene string, id string, text string")).collect()}
    assert fit["p-text"]["text"].startswith("a much") and fit["p"]["width"] > 300 and fit["p"]["x"] + fit["p"]["width"] / 2 == 50.0
    left = {r["id"] for r in scene.without(e, spark.createDataFrame([("s", "p")], "scene string, id string"), arrows_too=True).collect()}
    assert left == {"q"}
    said = spark.createDataFrame([("[DONE · P2]\nBuy milk\n#home #shop\nnow",)], "t string").select(scene.parsed_card(F.col("t")).alias("p")).first()["p"]
    assert (said["status"], said["priority"], said["title"], said["tags"]) == ("done", 2, "Buy milk now", ["home", "shop"])


def test_drawing_asks_for_changes(spark):
    from quillgraph.operators import scene

    card = lambda *r: spark.createDataFrame(list(r), "id string, title string, status string")
    edge = lambda *r: spark.createDataFrame(list(r), "source string, target string, type string")
    got = scene.corpus_changes(
        card(("a", "A", "ready"), ("b", "B", "ready")), card(("a", "A", "done"), ("b", "B", "ready")), card(("a", "A2", "ready"), ("b", "B", "done"), ("n", "New", None)),
        edge(("a", "b", "depends_on"), ("a", "b", "link")), edge(("a", "b", "depends_on"), ("a", "b", "link")), edge(("b", "a", "depends_on"), ("b", "n", "parent")), remove=True,
    )
    want = {("a", "conflict", "title"), ("b", "update", "status"), ("n", "create", "title"), ("b", "reject", "depends_on"), ("b", "add", "parent"), ("a", "remove", "depends_on")}
    assert {(r["id"], r["action"], r["field"]) for r in got.collect()} == want


def test_frontmatter_updates(spark):
    docs = spark.createDataFrame(
        [("a", '{"id":"a","depends_on":["b","[[docs/B.md|x]]","c"],"n":1,"title":"b"}', "see [[b]] and [[B#sec|alias]] and [[bb]]", "x"), ("z", None, "[[b|q]]", "y"), ("n", "{no", None, "y")], "id string, frontmatter string, body string, new string"
    )
    got = {r["id"]: r for r in changes.rename_ids(docs, spark.createDataFrame([("b", "n$w")], "old string, new string")).collect()}
    assert json.loads(got["a"]["frontmatter"]) == {"id": "a", "depends_on": ["n$w", "n$w", "c"], "n": 1, "title": "b"}
    assert got["a"]["body"] == "see [[n$w]] and [[n$w#sec|alias]] and [[bb]]" and got["z"]["body"] == "[[n$w|q]]" and got["n"]["frontmatter"] == "{no"
    u = spark.createDataFrame([("a", "n", None), ("a", "status", '"done"'), ("a", "priority", "9"), ("a", "effort", '"soon"'), ("a", "type", '"odd"'), ("z", "x", "[1]"), ("z", "blocked", "1"), ("z", "y", "{")], "id string, field string, value string")
    assert {(r["id"], r["field"]) for r in changes.checked(u).filter("problem IS NULL").collect()} == {("a", "n"), ("a", "status"), ("z", "x")}
    new = {r["id"]: r for r in changes.updated(docs, u).collect()}
    assert json.loads(new["a"]["frontmatter"]) == {"id": "a", "depends_on": ["b", "[[docs/B.md|x]]", "c"], "title": "b", "status": "done"} and json.loads(new["z"]["frontmatter"]) == {"x": [1]}


def test_layers_and_places(spark):
    from quillgraph.operators import scene

    nodes = spark.createDataFrame([("s", i, dep) for i, dep in (("a1", 0), ("a2", 0), ("b1", 1), ("b2", 1), ("c", 2))], "scene string, id string, depth int")
    edges = spark.createDataFrame([("s", "a1", "b2"), ("s", "a2", "b1"), ("s", "c", "b1"), ("s", "a1", "c")], "scene string, source string, target string")
    layers = scene.layers(nodes, edges)
    assert {(r["id"], r["rank"]) for r in layers.collect()} == {("a1", 0), ("a2", 0), ("b1", 1), ("b2", 1), ("c", 2)}
    placed = {r["id"]: r["place"] for r in scene.arranged(layers, edges).collect()}
    assert (placed["a1"] < placed["a2"]) == (placed["b2"] < placed["b1"])
