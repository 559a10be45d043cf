import random
import re

import numpy as np
import pytest

from quillgraph.llm.near_duplicates import NearDuplicates
from quillgraph.llm.words import hash_runs, code_points, ordered, shingles, word_hashes

WORD = re.compile(r"[^\W_]+")
SCHEMA = "id string, title string, body string, whole string, doc int"


def runs(title, body, size):
    w = WORD.findall(f"{title or ''}\n{body or ''}".lower())
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute(rows, size, least, t):
    kept = {}
    for i, title, body in {r[:3] for r in rows}:
        if i is not None and len(WORD.findall((body or "").lower())) >= least:
            kept.setdefault(i, []).append(runs(title, body, size))
    out = set()
    for a in kept:
        for b in kept:
            if a < b and any(x and y and len(x & y) >= t * len(x | y) for x in kept[a] for y in kept[b]):
                out.add((a, b))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        if rows and r.random() < 0.5:
            _, title, body = r.choice(rows)
            words = (body or "").split()
            for _ in range(r.randrange(0, 6)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((f"d{k:03}", title, " ".join(words)))
        else:
            rows.append((f"d{k:03}", r.choice([None, "", "Some Title"]), " ".join(r.choice(vocab) for _ in range(r.randrange(10, 80)))))
    return [(*x, "clash", 1) for x in rows]


@pytest.mark.parametrize("seed,size,t,most,filter_bits", [(1, 3, 0.5, 20_000, 28), (2, 5, 0.8, 20_000, 28), (3, 3, 0.5, 3, 28), (4, 3, 0.5, 20_000, 0)])
def test_against_brute_force(spark, seed, size, t, most, filter_bits):
    rows = corpus(seed)
    rows += [rows[0], (None, "x", "y " * 30, "c", 1), ("e1", None, None, "c", 1), ("e2", "", "", "c", 1), ("r1", None, "same " * 40, "c", 1), ("r2", None, "same " * 50, "c", 1)]
    found = NearDuplicates(spark.createDataFrame(rows, SCHEMA), size, 20, t, most, filter_bits)
    got = [(r["id_a"], r["id_b"]) for r in found.pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, size, 20, t)
    groups = found.groups().collect()
    assert len(groups) == len({r[0] for r in rows if r[0] is not None})
    name = {r["id"]: r["class_id"] for r in groups}
    assert all(name[a] == name[b] for a, b in got) and all(name[i] <= i for i in name)


def test_empty(spark):
    found = NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_very_long_text(spark):
    body = " ".join(f"t{k}" for k in range(70_000))
    rows = [("a", None, body, "", 0), ("b", None, body + " more", "", 0)]
    assert NearDuplicates(spark.createDataFrame(rows, SCHEMA)).pairs().count() == 1


def test_words_like_the_regular_expression():
    texts = ["Ab cd-EF", None, "", "ümlaut_x ²3 中文 words", "a" * 100 + " b", "!?"]
    h, owner, _ = word_hashes(texts)
    flat = [(k, w) for k, t in enumerate(texts) for w in WORD.findall((t or "").lower())]
    assert owner.tolist() == [k for k, _ in flat]
    by = {}
    for x, (_, w) in zip(h.tolist(), flat):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    again, _, _ = hash_runs(*code_points(["b ab"]))
    assert again.tolist() == [by["b"], by["ab"]]


def test_runs_stay_within_texts():
    h, owner, _ = word_hashes(["a b c", "d e", "a b c"])
    r, o = shingles(h, owner, 3)
    assert o.tolist() == [0, 2] and r[0] == r[1]


def test_order_is_exact():
    rng = np.random.default_rng(0)
    owner, high, low = rng.integers(0, 3, 500), rng.integers(0, 3, 500), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    low[::7] = low[0] & ~np.uint64(0xFFFF)
    low[3::7] = low[0] | np.uint64(0xF)
    order = ordered(owner, high, 4, low)
    rows = list(zip(owner[order], high[order], low[order]))
    assert rows == sorted(rows)
