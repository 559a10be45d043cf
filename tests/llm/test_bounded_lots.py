"""What a task holds at once does not follow the size of a batch or of a lot (F1)."""

import numpy as np
import pyarrow as pa

from quillgraph.llm import near_duplicates as nd


def packed(docs, refs, **columns):
    place = np.zeros(len(next(iter(columns.values()))), np.int64)
    (batch,) = nd._lots(place, [0], docs, refs, **columns)
    return batch.column("data")[0].as_py()


def test_batches_are_cut_by_their_text():
    bodies = ["x" * 10, None, "y" * 35, "", "z" * 5, "é" * 20]
    b = pa.record_batch([pa.array([None, "t", None, None, None, None], pa.string()), pa.array(bodies)], ["title", "body"])
    parts = list(nd._slices(iter([b]), 30))
    assert [x for p in parts for x in p.column("body").to_pylist()] == bodies
    assert len(parts) > 1 and all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column("body").to_pylist()) < 60 for p in parts)
    assert list(nd._slices(iter([b.slice(0, 0)]), 30)) == []


def test_parts_of_a_lot_hold_whole_runs(monkeypatch):
    monkeypatch.setattr(nd, "POSTED", 50)
    r = np.random.default_rng(5)
    raws, want = [], []
    for _ in range(4):
        key = np.sort(r.integers(0, 40, 200).astype(np.uint64) << np.uint64(20))
        docs, at = r.integers(1, 1 << 60, 30).astype(np.uint64), r.integers(0, 30, 200)
        sizes = r.integers(1, 400, 30)
        left = [r.integers(0, 300, 200) for _ in range(nd.ORDERS)]
        raws.append(packed({"docs": docs, "sizes": sizes}, ("at",), group=np.append(key[:1], np.diff(key)), side=np.zeros(200, np.int64), at=at, **{f"left{k}": x for k, x in enumerate(left)}))
        want += zip(key.tolist(), docs[at].tolist(), sizes[at].tolist(), *(x.tolist() for x in left))
    got, runs = [], []
    for docs, (group, doc, n, side, *left) in nd._parts(raws):
        assert len(group) < 100
        got += zip(group.tolist(), docs[doc].tolist(), n.tolist(), *(x.tolist() for x in left))
        runs.append(set(group.tolist()))
    assert sorted(got) == sorted(want)
    assert len(runs) > 5 and sum(map(len, runs)) == len(set.union(*runs))


def test_votes_are_added_in_cuts(monkeypatch):
    r = np.random.default_rng(6)
    docs = np.sort(r.integers(1, 1 << 63, 60).astype(np.uint64))
    raws, total = [], {}
    for _ in range(6):
        a = r.integers(0, 30, 300)
        b = a + r.integers(1, 30, 300)
        votes = [r.integers(0, 5, 300) for _ in range(nd.ORDERS)]
        raws.append(packed({"docs": docs}, ("a", "b"), a=a, b=b, votes=sum(v << 4 * k for k, v in enumerate(votes))))
        for x in zip(a.tolist(), b.tolist(), *votes):
            total[x[:2]] = total.get(x[:2], 0) + np.array(x[2:])
    want = {(int(docs[a].view(np.int64)), int(docs[b].view(np.int64))) for (a, b), v in total.items() if v.min() >= nd.SHARED}
    for most in (10_000, 100):
        monkeypatch.setattr(nd, "MET", most)
        rows = [(int(x), int(y)) for a, b in nd._counted(list(raws)) for x, y in zip(a, b)]
        assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_copies_have_one_run_set(spark):
    texts = nd._keyed(spark.createDataFrame([(f"c{k:03}", None, "some words that are in every one of these copies " * 4) for k in range(50)], "id string, title string, body string"))
    keys = texts.filter("id = 'c000'").select("whole", "id")
    for bits in (28, 0):
        assert nd.run_sets(texts, 3, 20, keys, bits).count() == 1
