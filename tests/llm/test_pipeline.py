import random
import time

import corpus_pipeline as C
from pyspark.sql import types as T

from threadgraph.llm import quality

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
                       T.StructField("fp", T.StringType()), T.StructField("row", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("kept", T.StringType())])


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["the", "of", "and", "to"] * 15 + [f"word{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = words(30)
    clean = {i: words(80) for i in range(1, 8)}
    rows = [(i, " ".join(w)) for i, w in clean.items()]
    rows += [(20, " ".join(clean[1])), (21, " ".join(clean[1][:-1] + ["other"])), (1, " ".join(clean[1]))]
    rows += [(30, " ".join(words(40) + item + words(20))), (40, "$$$ " * 100), (41, None), (42, ""), (43, "same word " * 60)]
    rows += [(50, " ".join(words(60)) + " mail to someone@example.com please")]
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), "a", "b", "c", 3, "d") for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, str(tmp_path)))
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == SCHEMA.fieldNames()
        assert docs.count() == len(seen[name]) or name == "quality_rules"
    assert set(seen["quality_rules"]) == {1, 2, 3, 4, 5, 6, 7, 20, 21, 30, 50}
    assert set(seen["jaccard_join"]) == {1, 2, 3, 4, 5, 6, 7, 30, 50}
    assert set(seen["decontamination"]) == {1, 2, 3, 4, 5, 6, 7, 50}
    assert seen["personal_data"][50]["text"].endswith(" mail to [EMAIL] please") and seen["personal_data"][50]["n_chars"] == len(seen["personal_data"][50]["text"])
    assert seen["personal_data"][2]["text"] == " ".join(clean[2]) and seen["personal_data"][2]["fp"] == "a"
    assert set(seen["bpe"]) == set(seen["personal_data"])
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        empty = C.stored(stage(spark, empty, str(tmp_path)))
    assert empty.count() == 0


def test_quality_stage_with_very_long_texts(spark):
    rng = random.Random(4)
    long = [" ".join(["the", "of", "and"][k % 3] if k % 4 == 0 else f"w{rng.randint(0, 10**6)}" for k in range(20_000)) for _ in range(3)]
    docs = spark.createDataFrame([(1, long[0], "en"), (2, long[1], "en"), (3, "over and out " * 7000, "en"), (4, long[2], None)], "doc_id long, text string, lang string")
    start = time.time()
    kept = C.keep_quality(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == {1, 2, 4} and all(r["text"] == long[{1: 0, 2: 1, 4: 2}[r["doc_id"]]] for r in kept)
    assert time.time() - start < 60


def brute_quality(text):
    import re
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    rep = len({i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)})
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)


def test_quality_like_brute_force(spark):
    rng = random.Random(8)
    bits = ["a", "b", "the", "\n", " ", "\x0b", "\xa0", "é😀", "#", "a b c", "\n\n", "\r\n", "..."]
    texts = [None, "", " ", "x"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    for r in quality.judge(df).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute_quality(texts[r["doc_id"]]), texts[r["doc_id"]]
