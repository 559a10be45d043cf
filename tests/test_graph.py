import itertools
import random

import pytest

from quillgraph.operators import graph


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def sample(seed, n=14, m=24):
    r = random.Random(seed)
    return sorted({(f"v{r.randrange(n):02}", f"v{r.randrange(n):02}") for _ in range(m)})


def reach(pairs):
    nodes = {x for p in pairs for x in p}
    dist = {}
    for s in nodes:
        level, seen, k = {s}, {s: 0}, 0
        while level:
            k += 1
            level = {b for a, b in pairs if a in level and b not in seen}
            seen.update(dict.fromkeys(level, k))
        dist.update({(s, x): k for x, k in seen.items() if x != s})
    return nodes, dist


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_components(spark, seed):
    pairs = sample(seed)
    nodes, dist = reach(pairs)
    e = edges_of(spark, pairs)
    assert {(r["seed"], r["id"]): r["depth"] for r in graph.closure(e, max_depth=50).collect()} == dist
    both = pairs + [(b, a) for a, b in pairs]
    _, und = reach(both)
    want = {n: min([n, *(x for (s, x) in und if s == n)]) for n in nodes}
    ids = spark.createDataFrame([(n,) for n in [*nodes, "alone"]], "id string")
    assert {r["id"]: r["component"] for r in graph.connected_components(ids, e).collect()} == {**want, "alone": "alone"}
    scc = {n: sorted([n, *(x for x in nodes if x != n and (n, x) in dist and (x, n) in dist)]) for n in nodes}
    assert {(r["id"], r["component"], r["size"]) for r in graph.strongly_connected(e).collect()} == {(n, c[0], len(c)) for n, c in scc.items() if len(c) > 1}


def test_paths(spark):
    e = edges_of(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "a")])
    got = {r["id"]: r["path"] for r in graph.shortest_paths(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got["e"] == ["a", "b", "d", "e"] and got["a"] == ["a"]
    every = graph.all_shortest_paths(e, edges_of(spark, [("a", "e")])).collect()
    assert [r["path"] for r in sorted(every, key=lambda r: r["rank"])] == [["a", "b", "d", "e"], ["a", "c", "d", "e"]]
    assert {(r["id"], r["depth"]) for r in graph.ego(e, spark.createDataFrame([("a",)], "id string"), 1).collect()} == {("b", 1), ("c", 1), ("e", 1)}


def brandes(nodes, pairs):
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths, level = [], [[s]]
        seen = {s}
        while level and not paths:
            new = [[*p, b] for p in level for a, b in pairs if a == p[-1] and b not in seen]
            paths = [p for p in new if p[-1] == t]
            seen |= {p[-1] for p in new}
            level = new
        for p in paths:
            for v in p[1:-1]:
                score[v] += 1 / len(paths)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_both_ways(spark, monkeypatch):
    pairs = [p for p in sample(5, 8, 16) if p[0] != p[1]]
    nodes = {x for p in pairs for x in p}
    want = brandes(nodes, pairs)
    ids = spark.createDataFrame([(n,) for n in nodes], "id string")
    for bound in (1000, 0):
        monkeypatch.setattr(graph, "BROADCAST_EDGES", bound)
        got = {r["id"]: r["betweenness"] for r in graph.betweenness(ids, edges_of(spark, pairs)).collect()}
        assert got == pytest.approx(want, abs=1e-5)


def test_pagerank(spark):
    pairs, nodes = [("a", "b"), ("a", "c"), ("b", "c")], ["a", "b", "c", "d"]
    rank = dict.fromkeys(nodes, 0.25)
    for _ in range(20):
        lost = rank["c"] + rank["d"]
        rank = {n: 0.15 / 4 + 0.85 * lost / 4 + 0.85 * sum(rank[a] / sum(1 for x in pairs if x[0] == a) for a, b in pairs if b == n) for n in nodes}
    got = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id string"), edges_of(spark, pairs))
    assert {r["id"]: r["pagerank"] for r in got.collect()} == pytest.approx(rank, abs=1e-6)


def test_propagation_and_inheritance(spark):
    n = spark.createDataFrame([("a", 3, "p"), ("b", 1, None), ("c", None, None), ("x", 5, None), ("y", 4, None)], "id string, priority int, project string")
    got = graph.least_over_reach(n, edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]), "priority").collect()
    assert {r["id"]: r["least"] for r in got} == {"a": 1, "b": 1, "c": 1, "x": 4, "y": 4}
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, parent string")
    assert {r["id"]: r["inherited"] for r in graph.inherit(n, links, "project").collect()} == {"a": "p", "b": "p", "c": "p", "x": None, "y": None}
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5)], "src string, dst string, factor double")
    base = spark.createDataFrame([("b", 4.0), ("c", 8.0)], "id string, base double")
    assert {r["id"]: r["total"] for r in graph.damped_sum(e, base).collect()} == {"a": 6.0, "b": 4.0}
