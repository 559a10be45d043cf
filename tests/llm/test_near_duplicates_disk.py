"""What lies on disk between the steps of p2 follows the texts, not their copies or the number of lots (F1)."""

import numpy as np

from quillgraph.llm import near_duplicates as nd


def copies(spark, texts=20, each=6):
    r = np.random.default_rng(3)
    bodies = [" ".join(f"w{x}" for x in r.integers(0, 400, 60)) for _ in range(texts)]
    return nd._keyed(spark.createDataFrame([(f"c{k:02}-{c}", None, b) for c in range(each) for k, b in enumerate(bodies)], "id string, title string, body string"))


def test_copies_are_posted_once(spark):
    texts = copies(spark)
    firsts = nd._firsts(texts.select("whole", "id").distinct())
    sketch = nd._sketch(nd._one(texts), 1, 20, firsts)
    assert nd.LEVELS[sketch[0]].sum() < 20 * 61
    held = spark.sparkContext.broadcast((sketch, 20_000))
    lots = nd._postings(nd._one(texts), 1, 20, 0.5, held, [0, 1], firsts).collect()
    named = [nd._opened(bytes(r["data"])) for r in lots if r["lot"] < 0]
    assert sorted(x for n in named for x in n["whole"].astype(np.uint64).view(np.int64).tolist()) == sorted(r["whole"] for r in texts.select("whole").distinct().collect())
    posted = {int(d) for r in lots if r["lot"] >= 0 for d in nd._opened(bytes(r["data"]))["docs"]}
    assert posted == {int(d) for n in named for d in n["docs"]}


def test_rows_take_little_room_in_many_lots(spark):
    r = np.random.default_rng(4)
    size = lambda docs: len(next(nd._lots(np.zeros(1000, np.int64), [0], {"docs": docs}, ("at",), at=np.arange(1000))).column("data")[0].as_py())
    numbers = np.sort(r.choice(6000, 1000, replace=False)).astype(np.uint64) + np.uint64(5 << nd.ROW_BITS)
    keys = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert size(numbers) + 5000 < size(keys)
    for docs in (numbers, keys):
        (b,) = nd._lots(np.zeros(1000, np.int64), [0], {"docs": docs}, ("at",), at=np.arange(1000))
        assert nd._opened(b.column("data")[0].as_py())["docs"].tolist() == docs.tolist()


def test_pairs_of_copies_are_not_exchanged(spark):
    texts = copies(spark).select("id", "title", "body")
    # an id with two texts, both of which have copies
    rows = texts.unionByName(texts.filter("id = 'c01-0'").selectExpr("'c00-0' AS id", "title", "body"))
    pairs = nd.NearDuplicates(rows, 3, 20, 0.5).pairs()
    plan = pairs._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Aggregate [id_a" not in plan.children().apply(0).toString()
    got = [tuple(r) for r in pairs.select("id_a", "id_b").collect()]
    want = {(f"c{k:02}-{a}", f"c{k:02}-{b}") for k in range(20) for a in range(6) for b in range(a + 1, 6)} | {("c00-0", f"c01-{a}") for a in range(6)}
    assert len(got) == len(set(got)) and set(got) == want
