import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadgraph.llm import trie as Z

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("d", T.StringType()), T.StructField("key", T.StringType()), T.StructField("part", T.StringType())])


def brute(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((-10**9 if turn is None else turn, role or "", text or ""))
    talks = {c: [x[1:] for x in sorted(v)] for c, v in talks.items()}
    whole = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(talks.get(c - c % 20, [])[:h] + talks[c][h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in whole.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[:d - 1]].add(seq[:d])
    out = []
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * n
            leaves[p[:d]] += not kids[p]
    for p, m in members.items():
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in Z.prefix_trie(df).collect()), key=str)
    assert got == brute(rows)
    return got


def test_like_brute_force(spark):
    rng = random.Random(2)
    say = ["hi there", "hi there", "ok", None, "", "a\tb\x0bc", "\xa0x y", "tell me more about it"]
    rows = []
    for c in range(120):
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["user", "user", None]), rng.choice(say)) for t in range(rng.randint(1, 6))]
    rows += [(200, 1, "user", "w " * 5000), (None, 1, "user", "nobody"), (201, 1, "u", "x"), (201, 1, "u", "x"), (260, 0, "user", "hi there")]
    check(spark, rows)


def test_hot_openings_and_long_talks(spark):
    rng = random.Random(5)
    hot = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 20) for t in range(4)]  # one conversation repeated
    comb = [(20 * k + 10_000, t, "user", f"comb {t}" if t < k else f"own {k}") for k in range(25) for t in range(k + 1)]
    far = [(30_000 + 20 * k, t, "user", "same" if t < 300 else f"{k}") for k in range(2) for t in range(310)]
    got = check(spark, hot + comb + far)
    assert max(r[1] for r in got) == 310


def test_empty(spark):
    assert check(spark, []) == []
    # without turns of their own and of a base, conversations end at the root
    lone = [(c, 0, "user", "short") for c in range(1, 12)]
    got = check(spark, lone)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_two_fattest(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", Z.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for r in got:
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: (x & -x))
