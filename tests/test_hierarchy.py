import random

import pytest

from quillgraph.operators.hierarchy import descendants, full_paths, hierarchy, resolved_parents


def brute(parent):
    found, below = {}, dict.fromkeys(parent, 0)
    for i in parent:
        seen, x = {}, i
        while x is not None and x not in seen:
            seen[x] = len(seen)
            x = parent[x]
        if x is None:
            found[i] = (list(seen)[-1], len(seen) - 1)
        else:
            ring = [y for y, k in seen.items() if k >= seen[x]]
            found[i] = (min(ring), -1 if i in ring else -2)
        for y in seen:
            if y != i:
                below[y] += 1
    return {i: (*found[i], below[i]) for i in parent}


def random_links(seed, n):
    r = random.Random(seed)
    ids = [f"n{k}" for k in range(n)]
    parent = {}
    for k, i in enumerate(ids):
        u = r.random()
        parent[i] = None if u < 0.1 else ids[k - 1] if u < 0.6 and k else r.choice(ids)
    return parent


@pytest.mark.parametrize("seed,n,spacing", [(1, 60, 3), (2, 200, 8), (3, 40, 1000)])
def test_against_brute_force(spark, seed, n, spacing):
    parent = random_links(seed, n)
    got = hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent string"), spacing)
    assert {r["id"]: (r["root"], r["depth"], r["below"]) for r in got.collect()} == brute(parent)


def test_paths_and_descendants(spark):
    parent = {"a": None, "b": "a", "c": "b", "d": "c", "e": "b", "x": "y", "y": "x"}
    solved = hierarchy(spark.createDataFrame(list(parent.items()), "id string, parent string"), 2)
    assert {r["id"]: "/".join(r["path"]) for r in full_paths(solved).collect()} == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "a/b/c/d", "e": "a/b/e"}
    assert {(r["ancestor"], r["id"], r["steps"]) for r in descendants(solved).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 3), ("b", "d", 2), ("c", "d", 1), ("a", "e", 2), ("b", "e", 1)}


def test_empty_and_self(spark):
    schema = "id string, parent string"
    assert hierarchy(spark.createDataFrame([], schema)).count() == 0
    got = hierarchy(spark.createDataFrame([("a", "a"), ("b", "a")], schema)).collect()
    assert {(r["id"], r["root"], r["depth"], r["below"]) for r in got} == {("a", "a", -1, 1), ("b", "a", -2, 0)}


def test_resolving_states_nulls_and_extra_columns(spark):
    schema = "id string, parent string, permalink string, recorded_at timestamp, deleted_at timestamp, key string, stop string"
    t = "2024-01-0{}"
    from datetime import datetime as d

    rows = [
        ("A", None, "first-note", d(2024, 1, 1), None, "k", "s"),
        ("b", "[[docs/FIRST-note.md#Log|x]]", None, d(2024, 1, 1), None, None, None),
        ("b", "gone", None, d(2023, 1, 1), None, None, None),
        ("c", "  ", None, d(2024, 1, 1), d(2024, 2, 1), None, None),
        ("c", "  ", None, d(2024, 1, 1), d(2024, 2, 1), None, None),
        (None, "A", None, d(2024, 1, 1), None, None, None),
    ]
    got = resolved_parents(spark.createDataFrame(rows, schema)).collect()
    assert {(r["id"], r["parent"]) for r in got} == {("A", None), ("b", "A"), ("c", None)}
