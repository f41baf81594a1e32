import random
import zlib
from collections import defaultdict

from pyspark.sql import types as T

from threadgraph.llm import kdtree as K

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n", T.DoubleType()),
                       T.StructField("k0", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("slot", T.StringType())])


def brute(rows, shards, n_dims):
    """Recursive cuts of sorted lists; ``rows`` are (row number, size, keys)."""
    out = {}

    def cut(part, first, k):
        if k == 1:
            out.update({r[0]: first for r in part})
            return
        if not part:
            return
        wide = [(max(r[2][i] for r in part) >> K.TIE) - (min(r[2][i] for r in part) >> K.TIE) for i in range(n_dims)]
        dim = wide.index(max(wide))
        part = sorted(part, key=lambda r: (r[2][dim], r[0]))
        want, left, kl = sum(r[1] for r in part) * (k // 2) // k, 0, k // 2
        for i, r in enumerate(part):
            if left + r[1] >= want:
                i += left + r[1] - want <= want - left
                break
            left += r[1]
        cut(part[:i], first, kl)
        cut(part[i:], first + kl, k - kl)

    cut(rows, 0, shards)
    return out


def made(n, seed=1):
    rng = random.Random(seed)
    return [(i, None if i % 50 == 7 else "wörd " * rng.randint(0, 60 if i % 40 else 3000), "src0" if rng.random() < 0.4 else f"src{rng.randint(1, 20)}", rng.choice([None, rng.random(), rng.randint(0, 3) * 1.0, float("nan")]))
            for i in range(n)]


def run(spark, rows, shards):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(5)
    return K.kd_shards(df, ["source", "n"], shards=shards)


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKETS", 40)  # several rounds a cut
    monkeypatch.setattr(K, "TOLERANCE", 0.0)
    kept = {}
    keyed = K.narrow_rows
    monkeypatch.setattr(K, "narrow_rows", lambda *a: kept.setdefault("rows", K.stored(keyed(*a))))
    data = made(700) + [(5000, "same", "src0", 1.0)] * 120  # repeated rows
    got = run(spark, data, 13).collect()
    rows = [(r["at"], r["size"], (r["k0"], r["k1"])) for r in kept["rows"].collect()]
    ids = {r["at"]: r["doc_id"] for r in kept["rows"].collect()}
    want = defaultdict(list)
    for at, s in brute(rows, 13, 2).items():
        want[ids[at]].append(s)
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append(r["shard"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_sizes_slots_and_balance(spark, monkeypatch):
    monkeypatch.setattr(K, "STRETCH", 10)  # many stretches, and repeated rows dealt out
    data = made(900, 3) + [(7000, "copy " * 30, "src0", 2.0)] * 300
    got = run(spark, data, 7).collect()
    texts = {r[0]: (r[1] or "").encode() for r in data}
    assert len(got) == len(data)
    shards = defaultdict(list)
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["crc"] == zlib.crc32(texts[r["doc_id"]])
        shards[r["shard"]].append(r)
    assert set(shards) == set(range(7))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in shards.values())
    sizes = [sum(r["size"] for r in v) for v in shards.values()]
    assert max(sizes) - min(sizes) <= 4 * max(len(t) + 16 for t in texts.values())


def test_small_and_empty(spark):
    assert run(spark, [], 40).count() == 0
    few = run(spark, [(1, None, None, None), (None, "", "x", 1.0), (1, None, None, None)], 40).collect()
    assert len(few) == 3 and all(r["slot"] == 0 for r in few) and len({r["shard"] for r in few}) == 3
    df = spark.createDataFrame([(i, "x" * 84, "s", 1.0, "", "", "") for i in range(50)], SCHEMA)
    out = K.kd_shards(df, ["source", "n"], target_bytes=1000).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in out) == [10] * 5


def test_query(spark):
    out = K.kdtree_q(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(out) == n and {r["law"] for r in out} == {"bytes"} and {r["shard"] for r in out} == set(range(40))
