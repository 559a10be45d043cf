"""Graphs that a task can hold are not joined level by level; the results are those of the joins."""

import random

import numpy as np
import pyarrow as pa

from quillgraph.operators import graph


def sample(seed, nodes, edges):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(nodes):02}", f"n{r.randrange(nodes):02}") for _ in range(edges)})


def no_rounds(*args):
    raise AssertionError("levels were joined")


def test_damped_sums_without_rounds(spark, monkeypatch):
    r = random.Random(7)
    rows = [(a, b, r.choice([1.0, 0.5, 0.3])) for a, b in sample(7, 30, 60)] * 2
    rows += [(a, b, 0.3) for a, b, _ in rows[:10]]
    e = spark.createDataFrame(rows, "src string, dst string, factor double")
    base = spark.createDataFrame([(f"n{k:02}", None if k == 3 else float(k % 6)) for k in range(1, 40)], "id string, base double")
    for depth in (None, 2):
        monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
        want = {x["id"]: x["total"] for x in graph.damped_sum(e, base, depth).collect()}
        with monkeypatch.context() as m:
            m.setattr(graph, "BROADCAST_EDGES", 1000)
            m.setattr(graph, "_counted", no_rounds)
            got = {x["id"]: x["total"] for x in graph.damped_sum(e, base, depth).collect()}
        assert got == want and len(got) > 20


def test_betweenness_by_arrays(spark):
    r = random.Random(8)
    rows = [(f"v{r.randrange(120):03}", f"v{r.randrange(120):03}") for _ in range(320)]
    rows += r.choices(rows, k=40)
    many = {}
    for a, b in rows:
        if a != b:
            many.setdefault(a, {})
            many[a][b] = many[a].get(b, 0) + 1
    want = {}
    for s in many:
        depth, ways, order, behind = {s: 0}, {s: 1}, [s], {}
        for v in order:
            for w, k in many.get(v, {}).items():
                if w not in depth:
                    depth[w], ways[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    ways[w] += ways[v] * k
                    behind.setdefault(w, []).append((v, k))
        lean = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v, k in behind[w]:
                lean[v] += ways[v] * k / ways[w] * (1 + lean[w])
            want[w] = want.get(w, 0.0) + lean[w]
    flow = spark.createDataFrame([(a, b, k) for a, x in many.items() for b, k in x.items()], "src string, dst string, k long")
    held = graph._lists(flow, "k").value
    assert (held.value > 1).any()
    sources = pa.record_batch([pa.array([*many, "alone"])], ["id"])
    got = dict(zip(*(c.to_pylist() for c in next(graph._leaning(held, iter([sources]))))))
    assert max(want.values()) > 10 and set(got) == {v for v, x in want.items() if x}
    assert all(abs(got[v] - want[v]) < 1e-6 for v in got)


def test_shortest_paths_without_rounds(spark, monkeypatch):
    pairs = sample(9, 40, 110)
    e = spark.createDataFrame(pairs + pairs[:5], "src string, dst string")
    seeds = spark.createDataFrame([("n01",), ("n02",), ("n02",), ("nowhere",), ("n30",)], "id string")
    rows = lambda df: sorted((x["seed"], x["id"], x["depth"], x["path"]) for x in df.collect())
    for depth in (None, 3, 0):
        monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
        want = rows(graph.shortest_paths(e, seeds, depth))
        with monkeypatch.context() as m:
            m.setattr(graph, "BROADCAST_EDGES", 1000)
            m.setattr(graph, "_counted", no_rounds)
            got = graph.shortest_paths(e, seeds, depth)
            assert [k for _, k in got.dtypes] == ["string", "string", "int", "array<string>"]
            assert rows(got) == want
    assert ("nowhere", "nowhere", 0, ["nowhere"]) in want


def test_paths_are_sent_in_pieces(monkeypatch):
    monkeypatch.setattr(graph, "PATH_ROWS", 4)
    n = 60
    ids = pa.array([f"n{k:02}" for k in range(n)])
    # a star of fifty leaves
    held = graph._Lists(ids, np.array([0, *[50] * n]), np.arange(1, 51), None)
    batches = list(graph._paths_of(held, iter([pa.record_batch([ids.slice(0, 1)], ["id"])]), None))
    assert len(batches) == 5 and max(b.num_rows for b in batches) < 12 and sum(b.num_rows for b in batches) == 51
    assert all(len(p) == d + 1 and p[-1] == i for b in batches for i, d, p in zip(*(b.column(c).to_pylist() for c in ("id", "depth", "path"))))
