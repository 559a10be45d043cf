from datetime import datetime as d

from pyspark.sql import functions as F

from quillgraph.functions.refs import reference_key
from quillgraph.operators.references import broken_references, orphan_counts, parent_keys, written_references

NODES = "id string, parent string, permalink string, recorded_at timestamp, deleted_at timestamp"


def test_keys(spark):
    cases = {"[[docs/Task-1.md#Log|the log]]": "task-1", " Task-1\t": "task-1", "tasks/task-1.MD": "task-1", "[[a b]]": "a b", "": "", "  ": "", "[[#part]]": "", "x|y": "x", "​a": "a"}
    got = spark.createDataFrame([(k,) for k in [*cases, None]], "r string").select("r", reference_key(F.col("r")).alias("k")).collect()
    assert {r["r"]: r["k"] for r in got} == {**cases, None: ""}


def test_broken(spark):
    nodes = spark.createDataFrame(
        [
            ("a", None, "perma-a", d(2024, 1, 1), None),
            ("a", None, "perma-a", d(2024, 1, 1), None),
            ("gone", None, None, d(2024, 1, 1), None),
            ("gone", None, None, d(2024, 6, 1), d(2024, 5, 1)),
            ("back", None, None, d(2024, 1, 1), d(2024, 2, 1)),
            ("back", None, None, d(2024, 3, 1), None),
            ("new", None, None, d(2024, 9, 1), d(2024, 9, 2)),
        ],
        NODES,
    )
    projects = spark.createDataFrame([("Proj-X",)], "slug string")
    refs = spark.createDataFrame(
        [
            (1, "[[PERMA-a]]", ["a", None, " ", "a", "nowhere", "nowhere"], d(2024, 4, 1), "clash"),
            (2, "gone", None, d(2024, 5, 1), "clash"),
            (2, "gone", None, d(2024, 5, 1), "clash"),
            (3, "gone", [], d(2024, 4, 30), "clash"),
            (4, "back", ["proj-x"], d(2024, 8, 1), "clash"),
            (5, "new", None, d(2024, 8, 1), "clash"),
            (6, None, None, d(2024, 8, 1), "clash"),
        ],
        "k bigint, parent string, deps array<string>, recorded_at timestamp, key string",
    )
    children = written_references(refs, "t", "k", ["parent", "deps"])
    got = broken_references(parent_keys(nodes, projects), children)
    assert {tuple(r) for r in got.collect()} == {("t", 1, "deps", "nowhere", "missing", "2024-04"), ("t", 2, "parent", "gone", "deleted", "2024-05"), ("t", 5, "parent", "new", "late", "2024-08")}
    assert got.count() == 3
    assert {tuple(r) for r in orphan_counts(got).collect()} == {("t", "deps", "missing", "2024-04", 1), ("t", "parent", "deleted", "2024-05", 1), ("t", "parent", "late", "2024-08", 1)}
    assert broken_references(parent_keys(nodes, projects), written_references(refs.limit(0), "t", "k", ["parent"])).count() == 0
    assert {r["kind"] for r in broken_references(parent_keys(nodes.limit(0), projects), children).collect()} == {"missing"}


def test_hot_key(spark):
    nodes = spark.createDataFrame([("a", None, None, d(2024, 1, 1), None)], NODES)
    projects = spark.createDataFrame([("p",)], "slug string")
    refs = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("parent"), F.lit(d(2024, 2, 1)).alias("recorded_at"))
    got = broken_references(parent_keys(nodes, projects), written_references(refs, "t", "k", ["parent"]))
    assert got.count() == 3000
