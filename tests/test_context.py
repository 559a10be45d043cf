from pyspark.sql import functions as F

from quillgraph.operators import context


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_closing_links(spark):
    e = links(spark, [("a", "b"), ("b", "c")])
    got = context.closing_links(e, links(spark, [("c", "a"), ("a", "c"), ("x", "y"), ("z", "z")])).collect()
    assert {(r["src"], r["dst"]): r["path"] for r in got} == {("c", "a"): ["a", "b", "c"], ("z", "z"): ["z"]}


def test_reach_and_spread(spark):
    kids = links(spark, [("e1", "k"), ("k", "leaf"), ("e2", "m")])
    tops = spark.createDataFrame([("e1",), ("e2",), ("leaf",)], "id string")
    hit = spark.createDataFrame([("leaf",)], "id string")
    assert [r["id"] for r in context.without_reach(tops, kids, hit).collect()] == ["e2"]
    assert {r["id"] for r in context.spread_from(kids, tops.filter("id = 'e1'")).collect()} == {"e1", "k", "leaf"}
    nodes = spark.createDataFrame([("k", 1), ("leaf", 0)], "id string, open int")
    got = context.descendants_where(kids, nodes, F.col("open") == 0).collect()
    assert {(r["seed"], r["id"], r["depth"]) for r in got} == {("e1", "leaf", 2), ("k", "leaf", 1)}


def test_reading_order(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("c", "d", 0), ("b", "d", 0)], "src string, dst string, rank int")
    got = context.reading_order(e, spark.createDataFrame([("a",)], "id string")).orderBy("order").collect()
    assert [r["id"] for r in got] == ["a", "c", "b", "d"]


def test_duplicate_groups(spark):
    rows = spark.createDataFrame([("a", "fix the old door", [1.0, 0.0]), ("b", "fix the old doors", [0.0, 1.0]), ("c", "Fix the old door", [0.0, 1.0]), ("d", "other", [0.0, 1.0]), ("e", "alone", [0.7, -0.7])], "id string, label string, embedding array<float>")
    got = {r["id"]: (r["group"], r["size"]) for r in context.duplicate_groups(rows, 0.7).collect()}
    assert got == {"a": ("a", 2), "c": ("a", 2)}
    both = {r["id"]: (r["group"], r["size"]) for r in context.duplicate_groups(rows, 0.7, 0.9).collect()}
    assert both == dict.fromkeys("abcd", ("a", 4))
    best = context.canonical_members(spark.createDataFrame([("a", "g"), ("b", "g")], "id string, group string"), spark.createDataFrame([("a", "2024"), ("b", None)], "id string, created string"), F.col("created"), F.lit(1), F.lit(1))
    assert [(r["group"], r["id"]) for r in best.collect()] == [("g", "b")]


def test_append_block(spark):
    def made(body, section=None):
        return spark.createDataFrame([(body,)], "b string").select(context.append_block(F.col("b"), F.lit("new"), F.lit("2024"), section).alias("x")).first()["x"]

    assert made("old\n") == "old\n\n[2024] new\n" and made(None) == "\n\n[2024] new\n"
    assert made("# A\none\n\n# B\ntwo", "A") == "# A\none\n\n[2024] new\n\n# B\ntwo"
    assert made("# A\none", "Log") == "# A\none\n\n## Log\n\n[2024] new\n"
