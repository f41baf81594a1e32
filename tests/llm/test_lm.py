import math
import random
import zlib
from collections import Counter

from helpers import TEXTS, docs

from threadgraph.llm import lm as L


def brute(rows, min_count):
    tok = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [L.END]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    train = [tok(t) for i, t in rows if not out(i)]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    pairs = Counter(p for t in train for p in zip([L.START] + t, t))
    hist = Counter({L.START: len(train)}) + uni
    mass = Counter()
    for (h, w), c in pairs.items():
        if c >= min_count:
            mass[h] += c - L.DISCOUNT
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))

    def p2(h, w):
        fail = 1 - (mass[h] / hist[h] if hist[h] else 0)
        c = pairs[h, w]
        return ((c - L.DISCOUNT) / hist[h] if c >= min_count else 0) + fail * p1(w)

    return [(i if i is not None else -1, out(i), len(tok(t)), sum(uni[w] > 0 for w in tok(t)), n, sum(math.log10(p1(w)) for w in tok(t)),
             sum(math.log10(p2(h, w)) for h, w in zip([L.START] + tok(t), tok(t)))) for i, t in rows]


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_TOKENS", 500)
    rng = random.Random(6)
    rows = list(TEXTS[:4]) + TEXTS[5:] + [(100 + i, " ".join(rng.choice(["The", "cat", "sat", "on", "É", "dog", f"x{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    key = lambda r: (r[0], r[2], round(r[5], 6), round(r[6], 6))
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in L.score_texts(docs(spark, rows), 2).collect()), key=key)
    want = sorted(brute(rows, 2), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6


def test_empty_and_better_than_single_words(spark):
    assert L.score_texts(docs(spark, [])).count() == 0
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red apple pie", "green tea pot", "blue sky high"]) for _ in range(30))) for i in range(100)]
    got = L.score_texts(docs(spark, rows)).filter("held_out").collect()
    assert got and all(r["score"] > r["base_score"] / 2 for r in got)


def brute_of_order(rows, order):
    """All sequences kept, any order."""
    tok = lambda t: [L.START] + [w.decode() for w in (t or "").encode().lower().split()] + [L.END]
    train = [tok(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(tuple(t[j:j + k]) for t in train for k in range(1, order + 1) for j in range(len(t) - k + 1))
    kinds = Counter(g[:-1] for g in c)
    n, v = sum(x for g, x in c.items() if len(g) == 1 and g != (L.START,)), sum(len(g) == 1 for g in c) - ((L.START,) in c)

    def p(h, w):
        if not h:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        lower = p(h[1:], w)
        return (max(c[h + (w,)] - L.DISCOUNT, 0) + L.DISCOUNT * kinds[h] * lower) / c[h] if c[h] else lower

    return {i: sum(math.log10(p(tuple(t[max(0, j - order + 1):j]), t[j])) for j in range(1, len(t))) for i, t in ((i, tok(t)) for i, t in rows)}


def test_all_sequences_of_the_query(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_TOKENS", 400)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "dog", f"x{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 30)))) for i in range(90)]
    assert (L.MIN_COUNT, L.ORDER) == (1, 3)
    for order in (3, 4):
        want = brute_of_order(rows, order)
        got = L.score_texts(docs(spark, rows), order=order).collect()
        assert len(got) == len(rows) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in got)
