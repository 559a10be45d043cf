import numpy as np
import pytest

from quillgraph.operators import retrieval


@pytest.mark.parametrize("block", [4096, 150])
def test_exact_at_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "JOIN_BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 24))
    v = np.concatenate([base, base + 0.58 * rng.normal(size=base.shape)]).astype(np.float32).astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    truth = {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= 0.85)) if a < b}
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = retrieval.similarity_join(rows).collect()
    assert len(got) == len(truth) > 150 and {(r["a"], r["b"]) for r in got} == truth
    assert all(abs(r["score"] - s[r["a"], r["b"]]) < 1e-9 for r in got)


def test_members_and_explicit_pairs(spark):
    x, y, z = [1.0, 0.0], [0.99, 0.1], [0.0, 1.0]
    rows = spark.createDataFrame([("a", x), ("b", x), ("b", x), ("c", y), ("d", z), ("d", z), ("e", None)], "vec_id string, embedding array<float>")
    assert {(r["a"], r["b"]) for r in retrieval.similarity_join(rows).collect()} == {("a", "c"), ("a", "a")}
    assert sorted((r["name"], r["member"]) for r in retrieval.equal_classes(rows).collect()) == [("a", "a"), ("a", "b"), ("c", "c"), ("d", "d")]
    explicit = spark.createDataFrame([("c", "b"), ("x", "y")], "a string, b string")
    assert sorted((r["a"], r["b"]) for r in retrieval.similarity_join(rows, explicit=explicit).collect()) == [("a", "b"), ("a", "c")]
