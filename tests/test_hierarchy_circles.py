from collections import Counter

import pytest
from test_hierarchy import random_links

from quillgraph.operators.hierarchy import all_descendants, all_paths, hierarchy


@pytest.mark.parametrize("seed,n,spacing", [(1, 60, 3), (3, 40, 1000), (4, 30, 2)])
def test_circles_and_what_hangs_from_them(spark, seed, n, spacing):
    parent = {**random_links(seed, n), "x": "z", "y": "x", "z": "y", "h": "y", "i": "h", "s": "s", "t": "s"}
    links = spark.createDataFrame(list(parent.items()), "id string, parent string")
    solved = hierarchy(links, spacing)
    want = {}
    for i in parent:
        seen, x = [i], parent[i]
        while x is not None and x not in seen:
            want[x, i] = len(seen)
            seen.append(x)
            x = parent[x]
    got = all_descendants(solved, links).collect()
    assert len(got) == len(want) and {(r["ancestor"], r["id"]): r["steps"] for r in got} == want
    assert Counter(a for a, _ in want) == {r["id"]: r["below"] for r in solved.collect() if r["below"]}
    paths = {r["id"]: r["path"] for r in all_paths(solved).collect()}
    assert set(paths) == set(parent) and paths["i"] == ["y", "h", "i"] and paths["x"] == ["x"] and paths["t"] == ["s", "t"]
    assert all(p[-1] == i and all(parent[b] == a for a, b in zip(p, p[1:])) for i, p in paths.items())
