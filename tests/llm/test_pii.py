import math
import random
import re
from collections import defaultdict

from helpers import TEXTS, docs
from pyspark.sql import functions as F

from threadgraph.llm import pii as P
from threadgraph.llm.common import documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_like_plain_patterns(spark):
    rng = random.Random(1)
    bits = ["a@b.c", "%", "@", ".", "x@y.z%d@e.f", "1", "23", "4556737586899855", "4556 7375 8689 9855", "4556-7375-8689-985", "-", " ", "255.1.2.3", "256.1.1.1", "1.2.3.4.5", "+1 (555) 123-4567", "+",
            "(", ")", "é", "😀", "word", "\n", "001.02.003.4", "79927398713", "+49 30 1234567890123", "4111111111111111"]
    rows = list(TEXTS) + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    rows += [(900, "a" * 4000), (901, "1" * 4000), (902, "1 " * 2000), (903, "a@b" + ".c" * 2000), (904, "+1" + "(" * 4000), (905, "mail me x@y.zz " * 3000)]
    df = docs(spark, rows)
    spans = P.find_pii(df)
    out = P.per_document(documents(df), spans).withColumn("whole", F.col("text"))
    out = P.redact(out).select("doc_id", F.col("whole").alias("text"), F.filter("spans", lambda s: s["base"]).alias("s"), F.col("text").alias("r")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s["start"], s["kind"], s["end"]) for s in r["s"]] == sorted(brute(r["text"]), key=lambda x: (x[0], P.KINDS.index(x[1]))), r["doc_id"]
        if not r["s"]:
            assert r["r"] == r["text"] or "[" in r["r"]
    assert {r["doc_id"]: r["r"] for r in out}[905] == "mail me [EMAIL] " * 3000


def test_context_finds_the_unseen(spark):
    rows = [(i, f"please dial +1 (555) 123-{4000 + i} now") for i in range(20)]
    rows += [(50, "please dial 0551-88231 now"), (51, "the number 0551-88231 is"), (52, "version 2.0.1-beta7 out"), (50, "please dial 0551-88231 now")]
    got = {(r["doc_id"], r["kind"], r["start"], r["end"]) for r in P.find_pii(docs(spark, rows)).filter("not base").collect()}
    assert got == {(50, "phone", 12, 22)}
    assert P.find_pii(docs(spark, [])).count() == 0


def brute_bootstrap(seeds, tokens, min_seeds, sure, doubt):
    """Sure (pattern, kind) -> score; seeds: (value, kind, patterns), tokens: (value, patterns)."""
    kinds, beside = defaultdict(set), defaultdict(set)
    for v, k, ps in seeds:
        kinds[v].add(k)
        for p in ps:
            beside[p].add(v)
    for v, ps in tokens:
        for p in ps:
            beside[p].add(v)
    found = {}
    while True:
        strong = {}
        for p, vs in beside.items():
            known = [v for v in vs if v in kinds]
            for k in P.KINDS:
                n = sum(k in kinds[v] for v in known)
                gain = sum(found.get((v, k), 0) for v in vs if v not in kinds)
                score = (n + gain) / (n + gain + len(known) - n + doubt * (len(vs) - len(known) - gain) + 1)
                if n >= min_seeds and score >= sure:
                    strong[p, k] = score
        miss = defaultdict(lambda: 1.0)
        for (p, k), score in strong.items():
            for v in beside[p]:
                if v not in kinds and (v, k) not in found:
                    miss[v, k] *= 1 - score
        if not miss:
            return strong
        found |= {key: 1 - m for key, m in miss.items()}


def test_bootstrap_like_brute_force(spark):
    rng = random.Random(11)
    rows = lambda kind, n: [(kind, f"{kind or 'x'}{rng.randint(0, 60)}", f"w{rng.randint(0, 5)} {rng.choice(['see', 'call', 'mail', kind or 'at'])}", rng.choice(["now", "then", kind or "so"])) for _ in range(n)]
    seeds = rows("phone", 150) + rows("email", 80)
    tokens = rows("", 60) + [("", f"y{i}", "w1 phone", "new") for i in range(30)] + [("", f"z{i}", "w9 other", "new") for i in range(9)]
    frame = lambda r: spark.createDataFrame(r, "kind string, value string, left string, right string")
    names = lambda l, r: [f"L {l.split()[-1]}", f"LL {l}", f"R {r}"]
    for setting in ((5, 0.8, 0.25), (3, 0.6, 0.1), (2, 0.5, 0.5)):
        got = {(r["pattern"], r["kind"]): r["score"] for r in P.bootstrap(frame(seeds), frame(tokens).drop("kind"), *setting).collect()}
        want = brute_bootstrap([(v, k, names(l, r)) for k, v, l, r in seeds], [(v, names(l, r)) for _, v, l, r in tokens], *setting)
        assert set(got) == set(want) and all(math.isclose(got[x], want[x]) for x in want), setting
        assert want


def test_planted_identifiers_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    known = [f"+1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}" for _ in range(100)]
    forms = [lambda: f"0{rng.randint(100, 999)}-{rng.randint(10000, 99999)}", lambda: f"DE{rng.randint(10, 99)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(10, 99)}",
             lambda: f"x{rng.randint(10, 99)}", lambda: "9" * rng.randint(70, 300), lambda: f"{word()}_{word()}", lambda: f"{word()}.{word()}"]
    unseen = [forms[i % 6]() for i in range(30)]
    rows = [(i, f"{prose(5)} reach me under {v} {prose(4)}") for i, v in enumerate(known + unseen)]
    clean = [(1000 + i, f"{prose(4)} version {rng.randint(1, 9)}.{rng.randint(0, 9)} {prose(3)} {rng.randint(10, 10**6)} {word()}_{word()} {prose(2)}") for i in range(100)]
    got = P.find_pii(docs(spark, rows + clean)).filter("not base").collect()
    texts = dict(rows)
    caught = {r["doc_id"] for r in got if r["doc_id"] in texts and r["kind"] == "phone" and texts[r["doc_id"]][r["start"]:r["end"]] == (known + unseen)[r["doc_id"]]}
    assert len(caught) >= 0.9 * len(unseen)
    assert not [r for r in got if r["doc_id"] >= 1000]
