"""Graphs of more edges than the driver numbers itself are held by tasks too; what is joined goes in lots (F2, F3)."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph import session
from quillgraph.operators import graph


def sample(seed, nodes, edges):
    r = random.Random(seed)
    names = [f"é{k}" if k % 5 == 0 else f"Z{k}" if k % 3 == 0 else f"n{k:02}" for k in range(nodes)]
    return sorted({(r.choice(names), r.choice(names)) for _ in range(edges)})


def no_joins(*args):
    raise AssertionError("levels were joined")


@pytest.mark.parametrize("kind", ["long", "double"])
def test_lists_numbered_by_joins(spark, monkeypatch, kind):
    rows = [(a, b, k % 7 + 1) for k, (a, b) in enumerate(sample(1, 50, 200))]
    e = spark.createDataFrame(rows, "src string, dst string, v int").withColumn("v", graph.F.col("v").cast(kind)).repartition(5)
    want = graph._lists(e, "v").value
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    got = graph._lists(e, "v").value
    assert got.ids.to_pylist() == want.ids.to_pylist()
    for name in ("begin", "ends", "value"):
        assert getattr(got, name).tolist() == getattr(want, name).tolist()
    assert got.begin.dtype == got.ends.dtype == np.int32 and graph._lists(e).value.value is None


def test_results_of_numbered_lists(spark, monkeypatch):
    pairs = sample(2, 40, 110)
    e = spark.createDataFrame(pairs, "src string, dst string")
    ids = spark.createDataFrame(sorted({(x,) for p in pairs for x in p}), "id string")
    paths = lambda: sorted((x["seed"], x["id"], x["depth"], x["path"]) for x in graph.shortest_paths(e, ids, 4).collect())
    between = lambda: {x["id"]: x["betweenness"] for x in graph.betweenness(ids, e).collect()}
    want = paths(), between()
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    for name in ("_counted", "_leans_by_joins"):
        monkeypatch.setattr(graph, name, no_joins)
    assert paths() == want[0]
    assert between() == pytest.approx(want[1], abs=1e-6)


def test_betweenness_in_lots(spark, monkeypatch):
    pairs = [p for p in sample(3, 12, 24) if p[0] != p[1]]
    e = spark.createDataFrame(pairs, "src string, dst string")
    ids = spark.createDataFrame(sorted({(x,) for p in pairs for x in p}), "id string")
    want = {x["id"]: x["betweenness"] for x in graph.betweenness(ids, e).collect()}
    assert max(want.values()) > 0
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(graph, "LOT_ROWS", 60)
    session.release(spark)
    before = set(session._TABLES)
    got = {x["id"]: x["betweenness"] for x in graph.betweenness(ids, e).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    kept = {p.rpartition("/")[2].partition("-")[0] for p in set(session._TABLES) - before}
    assert kept <= {"ids", "flow", "leans", "sums"}


def test_sums_are_written_by_block(monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    parts = [np.array([0, 1.5, 0, 0, 0, 0, 0, 0, 2.0]), np.array([0, 1.0, 0, 0, 0, 0, 0, 0, 0])]
    sent = [b for p in parts for b in graph._blocks(p)]
    assert len(sent) == 3 and sum(b.column("parts").nbytes for b in sent) < 120
    got = {i: x for b in graph._summed(pa.array(list("abcdefghi")), iter(sent)) for i, x in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {"b": 2.5, "i": 2.0}


def test_paths_of_numbered_lists_from_any_seed(spark, monkeypatch):
    """Of F3: seeds repeated, without edges, and of names that sort apart by bytes."""
    pairs = sample(4, 30, 70)
    e = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("é5",), ("é5",), ("nowhere",), ("Z3",)], "id string")
    paths = lambda: sorted((x["seed"], x["id"], x["depth"], x["path"]) for x in graph.shortest_paths(e, seeds, 4).collect())
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    want = paths()
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 1000)
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    monkeypatch.setattr(graph, "_counted", no_joins)
    assert paths() == want and len(want) > 20
    held = graph._lists(e).value
    given = pa.array(["é5", None, "nowhere", "é5", held.ids[0].as_py()])
    assert held.numbers(given).tolist() == [held.ids.to_pylist().index("é5"), -1, -1, held.ids.to_pylist().index("é5"), 0]
