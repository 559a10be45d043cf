import random
import re
from datetime import datetime as d

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import canonical, chunking, contamination, packing, subjects, survivors

CONFIG = "config_id int, strategy string, chunk_size int, overlap int, min_chunk_size int, is_default boolean"


def text(seed, n):
    r = random.Random(seed)
    parts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.1:
            parts.append("# Head " + str(r.randrange(99)))
        elif kind < 0.2:
            parts.append("```\ncode " + "x" * r.randrange(200) + "\n\nmore\n```")
        elif kind < 0.25:
            parts.append("é" * r.randrange(1, 700))
        else:
            parts.append(" ".join(f"word{r.randrange(50)}{'.' if r.random() < 0.1 else ''}" for _ in range(r.randrange(1, 60))))
        parts.append("\r\n\r\n" if r.random() < 0.3 else "\n\n")
    return "".join(parts)


@pytest.mark.parametrize("size,overlap,least", [(300, 0, 50), (300, 80, 50), (64, 32, 10), (20, 15, 30)])
def test_pieces_round_trip(spark, size, overlap, least):
    configs = spark.createDataFrame([(7, "s", size, overlap, least, True)], CONFIG)
    bodies = {f"d{k}": text(k, 12) for k in range(8)} | {"null": None, "empty": "", "blank": " \r\n ", "long": "a" * 5000}
    docs = spark.createDataFrame([(i, b, None if k % 2 else 99, "x") for k, (i, b) in enumerate(bodies.items())] + [("d1", bodies["d1"], None, "x")], "id string, body string, config_id int, pieces string")
    by = {}
    for r in chunking.pieces(docs, configs).collect():
        by.setdefault(r["id"], []).append(r)
    assert not {"null", "empty", "blank"} & set(by)
    for i, rows in by.items():
        data = chunking.normal_body(bodies[i])
        rows.sort(key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in rows] == list(range(len(rows)))
        assert b"".join(data[r["new_byte"] : r["end_byte"]] for r in rows) == data
        for r in rows:
            assert r["text"].encode() == data[r["start_byte"] : r["end_byte"]]
            assert len(r["text"].encode()) <= max(size, 16)
        for r in rows[1:]:
            back = min(overlap, max(size, 16) // 2)
            assert back <= r["new_byte"] - r["start_byte"] <= back + 3


def test_edits_stay_local():
    body = text(3, 60).replace("\r", "").strip()
    half = len(body) // 2

    def cuts(t):
        data = chunking.normal_body(t)
        marks = chunking.gear_hash(__import__("numpy").frombuffer(data, "uint8"))
        at = __import__("numpy").flatnonzero(marks >> __import__("numpy").uint64(56) == 0) + 1
        heads, gaps, _ = chunking.outline(data)
        ends = [e for e, _ in chunking.cut_places(data, 600, 0, 60, at, heads, gaps)]
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    one, two = cuts(body), cuts(body[:half] + " inserted words" + body[half:])
    assert len(set(one) - set(two)) <= 4


def test_blocks_and_fences():
    data = chunking.normal_body("a\n\nbb\n```\nx\n\ny\n```\n\nccc\n```\nopen\n\nend")
    _, gaps, ends = chunking.outline(data)
    assert [data[g : g + 2] for g in gaps] == [b"bb", b"cc"] and [data[a:b].strip() for a, b in zip([0, *gaps], ends)] == [b"a", b"bb\n```\nx\n\ny\n```", b"ccc\n```\nopen\n\nend"]


CANON = "value_id bigint, field string, value string, meaning string, also_known_as array<string>"


def test_canonical_values(spark):
    ref = spark.createDataFrame([(1, "status", "done", None, ["complete", "closed"]), (2, "status", "in_progress", None, ["wip"]), (3, "status", "blocked", None, None), (4, "doc_type", "task", None, ["todo item"]), (5, "doc_type", "note", None, [])], CANON)
    cases = {
        ("status", "Done "): 1, ("status", "dnoe"): 1, ("status", "cоmplete"): 1, ("status", "[conplete]"): 1, ("status", "status: closed"): 1, ("status", "done - Kestra"): 1,
        ("status", "INPROGRESS"): 2, ("status", "in vprogress"): 2, ("status", "in Arbeit"): 2, ("status", "not done"): 0, ("status", "unblocked"): 0, ("status", "undone"): 0,
        ("status", "task"): 0, ("status", "banana"): 0, ("status", "d​o​ne"): 1, ("doc_type", "todo itme"): 4, ("doc_type", "tâche"): 4, ("doc_type", "none"): 0, ("doc_type", "x" * 3000): 0, ("doc_type", "42"): 0,
        ("status", "done, then blocked"): 0, ("status", "done - blocked"): 0, ("status", "blocked (was done)"): 0, ("status", "done; checked"): 1, ("status", "wip 3/7"): 2,
        ("status", "blocked (auto)"): 3, ("status", "done, not"): 0, ("status", "closed, " + "y" * 3000): 1, ("doc_type", "todo, item"): 4, ("doc_type", "kind = note"): 5,
    }
    rows = [(k, v if f == "status" else None, v if f == "doc_type" else " ", "clash") for k, (f, v) in enumerate(cases)]
    rows += [rows[0], (99, "done", "note", "clash"), (98, None, "", "clash")]
    df = spark.createDataFrame(rows, "entry_id bigint, status string, doc_type string, raw string")
    got = canonical.canonical_values(df, "entry_id", ["status", "doc_type"], ref).distinct().collect()
    assert {(r["field"], r["raw"]): r["value_id"] for r in got} == cases
    assert canonical.canonical_values(df.limit(0), "entry_id", ["status"], ref).count() == 0
    assert {r["value_id"] for r in canonical.canonical_values(df, "entry_id", ["status"], ref.limit(0)).collect()} == {0}


def test_edit_distance(spark):
    rows = [("ab", "ba", 1), ("done", "done", 0), ("abcd", "acbx", 2), ("kitten", "sitting", 3), ("a", "abcd", 3)]
    got = spark.createDataFrame(rows, "a string, b string, want int").withColumn("d", canonical.edits("a", "b")).collect()
    assert all(r["d"] == r["want"] for r in got)


ENTRY = "cluster_id bigint, id string, created string, modified string, status string, assignee string, due string, n_children int, word_count int, field string"


def test_survivors(spark):
    rows = [
        (1, "a", "2024-01-02", "2024-05-01T10:00:00+02:00", "done", "-", None, 1, 5, "x"),
        (1, "b", "2024-01-01T23:00:00-05:00", "2024-05-01 08:30:00Z", "ready", "Kim", " ", 1, 5, "x"),
        (1, "c", "unknown", None, "N/A", "Lou", "2024-02-02", 9, 9, "x"),
        (1, "c", "unknown", None, "N/A", "Lou", "2024-02-02", 9, 9, "x"),
        (2, "q", None, None, None, "tbd", "?", None, None, "x"),
        (2, "p", None, None, None, "tbd", "?", None, None, "x"),
        (None, "z", None, None, "done", None, None, 0, 0, "x"),
    ]
    e = spark.createDataFrame(rows, ENTRY)
    top = survivors.survivors(e, {"canonical": ["id"]}, {"canonical": survivors.seniority()})
    assert {(r["cluster_id"], r["id"], r["consistent"]) for r in top.collect()} == {(1, "a", True), (2, "p", True)}
    alone = survivors.survivors(e, {f: [f] for f in ("status", "assignee", "due")}, survivors.record_instant(F.col("modified")))
    assert {(r["cluster_id"], r["bundle"], r["id"]) for r in alone.collect()} == {(1, "status", "b"), (1, "assignee", "b"), (1, "due", "c")}
    # due goes with the pair of status and assignee it was seen with: b has none, c's pair has one
    tied = survivors.survivors(e, {"work": ["status", "assignee"], "due": ["due"]}, survivors.record_instant(F.col("modified")), [("due", "work")])
    assert {(r["bundle"], r["id"]) for r in tied.collect()} == {("work", "c"), ("due", "c")}
    assert survivors.survivors(e.limit(0), {"due": ["due"]}, survivors.record_instant(F.col("modified"))).count() == 0


def test_no_combination_is_marked(spark):
    # x asks for p, p for q, q for y, but y for r, r for s, s for x
    seen = [("x", "p", None), ("y", "r", None), (None, "p", "q"), (None, "r", "s"), ("y", None, "q"), ("x", None, "s")]
    rows = [(1, f"i{k}", *v, k) for k, v in enumerate(seen)] + [(2, "d", "x", "p", "q", 1)]
    e = spark.createDataFrame(rows, "cluster_id int, id string, f string, g string, h string, t int")
    got = survivors.survivors(e, {"f": ["f"], "g": ["g"], "h": ["h"]}, F.col("t"), [("f", "g"), ("g", "h"), ("h", "f")]).collect()
    want = {(1, False), (2, True)}
    assert {(r["cluster_id"], r["consistent"]) for r in got} == want and len(got) == 6


def test_pieces_put_together(spark):
    configs = spark.createDataFrame([(1, "s", 200, 40, 30, True), (2, "s", 90, 0, 10, False)], CONFIG)
    docs = spark.createDataFrame([(f"d{k}", text(k, 20), 1 + k % 2) for k in range(6)] + [("d1", text(1, 20), 2), ("n", None, 1)], "id string, body string, config_id int")
    got = chunking.rebuilt(docs, configs).collect()
    assert len(got) == 6 and {(r["over"], r["lacking"]) for r in got} == {(0, 0)}
    import hashlib

    by = {r["id"]: chunking.normal_body(r["body"]) for r in docs.collect()}
    assert all(r["bytes"] == len(by[r["id"]]) and r["body_hash"] == hashlib.sha256(by[r["id"]]).hexdigest() for r in got)


def test_branch_and_bound_is_best():
    import itertools

    r = random.Random(2)
    for _ in range(50):
        options = [sorted(((-r.randrange(5), f"i{k}", f"v{r.randrange(3)}") for k in range(r.randrange(1, 5))), reverse=True) for _ in range(3)]
        allowed = {(0, 1): {f"v{k}": {f"v{r.randrange(3)}"} for k in range(r.randrange(3))}}
        fits = lambda c: all(v not in allowed[0, 1] or c[1][2] in allowed[0, 1][v] for v in [c[0][2]])
        best = max((sum(o[0] for o in c) for c in itertools.product(*options) if fits(c)), default=None)
        got = survivors._search(options, allowed)
        assert (sum(o[0] for o in got) if got else None) == best


def test_packing(spark):
    r = random.Random(1)
    counts = spark.createDataFrame([(k, r.choice([0, 1, 5, 40, 90, 100, 101, 250, 300])) for k in range(400)] + [(7, 7), (None, 5)], "doc_id bigint, tokens int")
    limits = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (3, "bad", 0), (4, "null", None), (1, "a", 100)], "limit_id int, name string, capacity_tokens int")
    rows = packing.pack(counts, limits, shard=150).collect()
    want = {x["doc_id"]: x["tokens"] for x in counts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("tokens").alias("tokens")).collect()}
    for limit, capacity in ((1, 100), (2, 64)):
        fill, per = {}, {}
        for x in rows:
            if x["limit_id"] == limit:
                fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
                per.setdefault(x["doc_id"], []).append((x["part"], x["tokens"]))
        assert max(fill.values()) <= capacity
        assert {k: sum(t for _, t in v) for k, v in per.items()} == {k: v for k, v in want.items() if v}
        assert all(len(v) == 1 and v[0][0] == 0 for k, v in per.items() if want[k] <= capacity)
        assert len(fill) <= sum(fill.values()) / capacity * 1.15 + 3
    assert packing.pack(counts.limit(0), limits).count() == 0


def test_local_search_helps():
    sizes = [6, 6, 4, 4, 3, 3, 2, 2]
    bins = [[0, 2], [1, 4], [3, 5], [6, 7]]
    better = packing.improve(bins, sizes, 10)
    assert sorted(i for b in better for i in b) == list(range(8)) and all(sum(sizes[i] for i in b) <= 10 for b in better)
    assert len(better) == 3


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def leaks_by_hand(docs, items, run):
    out = {}
    for i, p in items:
        w = re.findall(r"[^\W_]+", contamination.plain(p))
        known = set(w)
        for k, t in docs:
            x = re.findall(r"[^\W_]+", contamination.plain(t, known))
            have = {tuple(x[j : j + run]) for j in range(len(x) - run + 1)}
            hit = {j + o for j in range(len(w) - run + 1) if tuple(w[j : j + run]) in have for o in range(run)}
            if hit:
                out[k, i] = (len(w), len(hit))
    return out


def test_leaks(spark):
    r = random.Random(3)
    items = [(1, PASSAGE), (2, "a b c"), (3, None), (4, " ".join(f"w{r.randrange(6)}" for _ in range(40)))]
    docs = [
        (10, "Before. ONE two, <b>three</b> four&nbsp;five **six** se­ven eight-\nnine ten! after"),
        (11, "one two three four five six seven x eight nine ten eleven twelve thirteen fourteen fif-\nteen sixteen"),
        (12, None), (13, ""), (14, "> one two three four\n> five six seven eight"), (15, "nothing here at all " * 500),
        (16, " ".join(f"w{r.randrange(6)}" for _ in range(3000))), (17, PASSAGE), (18, PASSAGE),
    ]
    d_ = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, passage string")
    i_ = spark.createDataFrame(items, "item_id bigint, passage string")
    got = {(x["doc_id"], x["item_id"]): (x["words"], x["covered"]) for x in contamination.leaked(d_, i_, share=0).collect()}
    assert got == leaks_by_hand(docs, items, 8)
    assert {(10, 1), (11, 1), (14, 1), (17, 1), (18, 1)} <= set(got)
    full = next(x for x in contamination.leaked(d_, i_, share=0).collect() if x["doc_id"] == 17)
    assert (full["longest"], full["at_word"]) == (16, 0)
    assert {x["doc_id"] for x in contamination.without_leaks(d_, i_.filter("item_id = 1")).collect()} == {12, 13, 15, 16}
    assert contamination.leaked(d_.limit(0), i_).count() == 0 and contamination.leaked(d_, i_.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    r = random.Random(9)
    draw = lambda n: " ".join(f"w{r.randrange(4)}" for _ in range(n))
    items = [(k, draw(r.randrange(5, 40))) for k in range(60)] + [(60, "same " * 300), (61, "same " * 9)]
    docs = [(k, draw(r.randrange(0, 200))) for k in range(40)] + [(40, "same " * 5000), (41, None)]
    d_, i_ = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    want = leaks_by_hand(docs, items, 8)
    tests = list(contamination._passes(i_, 8))
    assert len(tests) == 1
    for slab in (1, 50, 1 << 21):  # the same whatever the size of the blocks
        monkeypatch.setattr(contamination, "SLAB", slab)
        held = [(d, t) for d, t in docs if t]
        found = {}
        for x in contamination._shard([d for d, _ in held], [contamination.plain(t) for _, t in held], tests[0], 0.0):
            for d, i, w, c, longest, at in zip(*x):
                assert (d, i) not in found and longest >= 8
                found[int(d), int(i)] = (int(w), int(c))
        assert found == want
    monkeypatch.setattr(contamination, "PASS_WORDS", 100)
    assert len(list(contamination._passes(i_, 8))) > 3
    got = {(x["doc_id"], x["item_id"]): (x["words"], x["covered"]) for x in contamination.leaked(d_, i_, share=0).collect()}
    assert got == want


def test_longest_match():
    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        text, passage = ([r.randrange(0 if k else 1, 4) for _ in range(r.randrange(1, 30))] for k in (1, 0))
        best = max(((n, -at) for n in range(1, len(passage) + 1) for at in range(len(text) - n + 1) for k in range(len(passage) - n + 1) if text[at : at + n] == passage[k : k + n]), default=None)
        if best:
            assert contamination.longest_match(np.array(text), np.array(passage), 1) == (best[0], -best[1])


def test_suffix_array_order():
    import numpy as np

    words = np.array([3, 1, 2, 0, 1, 2, 1, 2, 3, 0, 5, 1])
    order = contamination.suffix_array(words, 8)
    assert [tuple(words[p : p + 8]) for p in order] == sorted(tuple(words[p : p + 8]) for p in range(len(words)) if words[p])


TOPICS = {1: "compiler linter branch deploy parser".split(), 2: "risotto garlic oven marinade pastry".split(), 3: "violin choir tempo chord melody".split()}


def topic_text(r, kinds, n=10):
    out = []
    for k in range(n):
        words = [r.choice(TOPICS[kinds[k % len(kinds)]]) for _ in range(3)] + [r.choice("the a of with before after note list".split()) for _ in range(4)]
        r.shuffle(words)
        out.append(" ".join(words).capitalize() + ".")
    return "# Title\n\n" + " ".join(out) + "\n\n#tag #other"


def test_subjects_on_held_out_documents(spark):
    r = random.Random(9)
    docs, labels, want = [], [], {}
    for k in range(160):
        kinds = r.sample([1, 2, 3], r.choice([1, 1, 2]))
        docs.append((k, topic_text(r, kinds), "clash"))
        want[k] = set(kinds)
        if k < 100:
            labels += [(k, s, "x") for s in kinds if r.random() < 0.9]
    docs += [(900, None, "c"), (901, "", "c"), (902, "# only a heading", "c"), (None, "compiler linter.", "c")]
    d_ = spark.createDataFrame(docs, "doc_id bigint, text string, subjects string")
    l_ = spark.createDataFrame([*labels, (0, 77, "x"), (5000, 1, "x"), (None, 1, "x")], "doc_id bigint, subject_id bigint, annotator string")
    s_ = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "subject_id bigint, name string")
    model = subjects.train(d_, l_, s_)
    got = {}
    for x in subjects.assign(d_, model).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject_id"])
    assert not {900, 901, 902, None} & set(got)
    held = [k for k in range(100, 160)]
    assert sum(got.get(k, set()) == want[k] for k in held) >= 0.9 * len(held)
    assert subjects.assign(d_, subjects.train(d_, l_.limit(0), s_)).filter("about > sentences").count() == 0


def test_sentences():
    t = "---\ntitle: x\n---\n# Head\n\nOne here. Two there! 3 more?\n- item one\n- item two\n\n#a #b\n"
    assert [s.strip() for s in subjects.sentences(t)] == ["One here.", "Two there!", "3 more?", "- item one", "- item two"]
