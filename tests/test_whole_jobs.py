"""Queries that must do the whole job, against plain Python over whole tables at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def edges(spark):
    return [(r["source"], r["target"], r["type"]) for r in entry.queries()["g1_edges"](spark, DATA).collect()]


def test_components_over_all_edges(spark, edges):
    got = {r["id"]: r["component"] for r in entry.queries()["g14_all_components"](spark, DATA).collect()}
    up = {i: i for i in got}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b, _ in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    assert got == {i: top(i) for i in got}
    assert len({t for _, _, t in edges}) > 2 and any(top(a) == top(b) for a, b, t in edges if t not in ("supersedes", "closes") and a != b)


def test_shortest_paths_from_every_superseded_node(spark, edges):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in {b for _, b, t in edges if t == "supersedes"}:
        front = seen = {s: [s]}
        for _ in range(4):
            step = {}
            for i, path in front.items():
                for x in near[i] - seen.keys():
                    step[x] = min(step.get(x, [*path, x]), [*path, x])
            front, seen = step, {**seen, **step}
        want |= {(s, i): (len(path) - 1, ">".join(path)) for i, path in seen.items()}
    assert len({s for s, _ in want}) > 1
    got = entry.queries()["g9_shortest_paths"](spark, DATA).collect()
    assert len(got) == len(want) and {(r["seed"], r["id"]): (r["depth"], r["path"]) for r in got} == want


def test_hybrid_scores_of_every_centre(spark, edges):
    got = entry.queries()["v13_hybrid"](spark, DATA).collect()
    score = {(r["query"], r["id"]): r["score"] for r in got}
    centres = {a for a, _, t in edges if t == "supersedes"}
    assert len(centres) > 1 and len(score) == len(got) and {q for q, _ in score} == centres
    near = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    # what the vector score alone gives an entry is the same around every centre
    two = near | {(a, d) for a, b in near for c, d in near if b == c}
    for q in centres:
        beside = {b for a, b in near if a == q and b != q}
        assert beside <= {i for x, i in score if x == q}
    far = {i: {score[q, i] for q in centres if (q, i) in score and (q, i) not in two and q != i} for _, i in score}
    assert all(len(v) <= 1 for v in far.values())


def test_betweenness_over_all_edges(spark, edges):
    ahead = {}
    for a, b, _ in edges:
        if a != b:
            ahead.setdefault(a, []).append(b)
    got = {r["id"]: r["betweenness"] for r in entry.queries()["g24_betweenness"](spark, DATA).collect()}
    depth, ways = {}, {}
    for s in got:
        d, w, order = depth.setdefault(s, {s: 0}), ways.setdefault(s, {s: 1}), [s]
        for i in order:
            for x in ahead.get(i, ()):
                if x not in d:
                    d[x], w[x] = d[i] + 1, 0
                    order.append(x)
                if d[x] == d[i] + 1:
                    w[x] += w[i]
    want = dict.fromkeys(got, 0.0)
    for s in got:
        for t in depth[s].keys() - {s}:
            for v in depth[s].keys() - {s, t}:
                if depth[s][v] + depth[v].get(t, 1e9) == depth[s][t]:
                    want[v] += ways[s][v] * ways[v][t] / ways[s][t]
    n = len(got)
    assert any(len(set(x)) < len(x) for x in ahead.values()) and max(want.values()) > 0
    assert got == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in want.items()}, abs=1e-6)
