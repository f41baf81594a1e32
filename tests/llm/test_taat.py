import math
import random
import re
from collections import Counter

from pyspark.sql import types as T

from threadgraph.llm import taat as S

ASK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("term", T.StringType()), T.StructField("rank", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("n", T.StringType()), T.StructField("posted", T.StringType())])


def words(text):
    low = (text or "").translate(str.maketrans(S.UPPER, S.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for q, t in items:
        asked.setdefault(q, set()).update(words(t))
    out = []
    for q, ts in asked.items():
        scores = []
        for i, c, n in held:
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def check(spark, docs, items, k):
    d = spark.createDataFrame([(*r, "a", "b", "c") for r in docs], DOCS).repartition(4)
    q = spark.createDataFrame([(*r, "a", "b") for r in items], ASK)
    got = sorted((tuple(r) for r in S.search(d, q, k).collect()), key=str)
    assert got == brute(docs, items, k)
    return got


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_STEP", 3)
    monkeypatch.setattr(S, "STEP", 2)
    monkeypatch.setattr(S, "ROWS", 37)
    monkeypatch.setattr(S, "BLOCK", 90)  # several blocks
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(150)] + ["Ünï", "A", "a", "ΣΑΣ", "x_y", "it's"]
    odds = [1 / (i + 1) for i in range(len(vocab))]
    talk = lambda n: " ".join(rng.choices(vocab, odds, k=n))
    docs = [(i, talk(rng.randint(1, 80))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " .,- "), (None, "w5 w6 W7"), (None, None), (7, talk(20)), (1003, "w3 " * 20_000), (1004, "w1 w2 w3"), (1005, "w1 w2 w3"), (1005, "w1 w2 w3")]
    items = [(i, talk(rng.randint(1, 25))) for i in range(25)] + [(100, None), (101, ""), (102, "never seen"), (103, "w0 w0 w1"), (3, "w1 w2 w3"), (None, "w4 w9")]
    got = check(spark, docs, items, 5)
    assert len({r[0] for r in got}) > 25


def test_planted_passages_close_early(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_STEP", 8)
    made = []
    kth = S._kth
    monkeypatch.setattr(S, "_kth", lambda state, *a: made.append(state.selectExpr("sum(size(accs))").first()[0]) or kth(state, *a))
    rng = random.Random(7)
    common = [f"c{i}" for i in range(12)]
    passage = " ".join(f"rare{i}" for i in range(20))
    docs = [(i, " ".join(rng.choices(common, k=40)) + (" " + passage if i < 6 else "")) for i in range(600)]
    check(spark, docs, [(1, passage + " " + " ".join(common))], 3)
    assert made[0] == 6 and max(made) == 6  # the frequent terms made no accumulators


def test_empty(spark):
    assert check(spark, [], [(1, "a")], 5) == []
    assert check(spark, [(1, "a b")], [], 5) == []
    assert check(spark, [(1, None), (2, "")], [(1, "a")], 5) == []
    assert [r[2] for r in check(spark, [(1, "a b"), (2, "b")], [(1, "b a")], 5)] == [1, 2]
