"""Personal data: patterns with checks, then bootstrapped contextual extraction.

Base matches of four kinds are the seeds. The words beside a seed make lexical patterns.
Patterns and the identifier-like tokens beside them form a graph that Spark scores in
rounds: a pattern is as good as the confidence of the distinct values it stands beside, a
value as sure as the patterns that point at it. Sure patterns extract the tokens no base rule knows, which
vouch for further patterns, until a round finds nothing new. Everything is DataFrame expressions; texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadgraph.llm import query
from threadgraph.llm.common import attach, discard, documents, span_text, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Patterns that match as the plain ones do, but start only where a run starts and never backtrack into a run, so that time is linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Tokens that may be identifiers: runs of any length with a digit, an underscore, an @ or a dot inside, and further
#: runs with a digit after one blank each (numbers written in groups).
_RUN = r"[A-Za-z0-9_@+/-]++(?:\.[A-Za-z0-9_@+/-]++)*+"
TOKEN = (r"(?<![A-Za-z0-9_@.+/-])(?=[A-Za-z+/-]*+(?:[0-9_@]|\.[A-Za-z0-9_@+/-]))" + _RUN
         + r"(?:\x20(?=[A-Za-z_@+/-]*+(?:\.[A-Za-z_@+/-]++)*+\.?[0-9])" + _RUN + ")*+")
#: Distinct seed values a pattern needs, the score from which it is sure, and what a value of no known kind counts against it.
MIN_SEEDS, SURE, DOUBT = 5, 0.8, 0.25
#: Characters of context beside a match that are looked at.
BESIDE = 80


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    one = lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(one(i))).otherwise(one(i))) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    return (F.when(kind == "ip", F.forall(F.split(m, r"\."), small)).when(kind == "card", (n >= 14) & (n <= 19) & _luhn(digits))
            .when(kind == "phone", (n >= 10) & (n <= 15)).otherwise(F.lit(True)))


def matches(docs: DataFrame) -> DataFrame:
    """Matches of all patterns: ``doc_id, fp, kind, start, end, value, left, right``.

    The texts between matches give the positions: a match starts after the gaps and matches
    before it. Only gap lengths and the words beside a match leave the row of the text.
    Repeated rows give their matches once.
    """
    t = F.col("text")
    some = t.rlike(r"[0-9@_]|\.[A-Za-z+/-]")
    cut = []
    for kind, pattern in (PATTERNS | {"token": TOKEN}).items():
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        need = NEEDS.get(kind, "")
        has = F.contains(t, F.lit(need)) if need else F.lit(True)
        cut.append(F.when(has, F.struct(F.lit(kind).alias("kind"), found.alias("m"), F.split(t, pattern, -1).alias("g"))))
    rows = docs.filter(some).select("doc_id", "fp", F.explode(F.array_compact(F.array(*cut))).alias("c")).filter(F.size("c.m") > 0)
    # gap k stands before match k; the last gap ends the text
    beside = F.transform("c.g", lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(BESIDE)).alias("tail"), F.left(g, F.lit(BESIDE)).alias("head")))
    rows = rows.select("doc_id", "fp", "c.kind", F.col("c.m").alias("m"), beside.alias("g"))
    zipped = F.arrays_zip(F.slice("g", 1, F.size("m")).alias("g"), F.col("m").alias("m"), F.slice("g", 2, F.size("m")).alias("h"))
    rows = rows.select("doc_id", "fp", "kind", F.posexplode(zipped).alias("k", "x"))
    rows = rows.select("doc_id", "fp", "kind", "k", F.col("x.g.n").alias("gap"), F.col("x.m").alias("value"), F.col("x.g.tail").alias("left"), F.col("x.h.head").alias("right"))
    rows = rows.dropDuplicates(["doc_id", "fp", "kind", "k"])
    w = Window.partitionBy("doc_id", "fp", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(w).cast("int")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return rows.select("doc_id", "fp", "kind", "start", "end", "value", "left", "right")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s]+"), lambda w: w != "")


def contexts(rows: DataFrame) -> DataFrame:
    """One row per occurrence and pattern: the word before, the two words before, the word after."""
    left, right = _words(F.col("left")), _words(F.col("right"))
    one = F.when(F.size(left) >= 1, F.concat(F.lit("L "), F.element_at(left, -1)))
    two = F.when(F.size(left) >= 2, F.concat(F.lit("LL "), F.element_at(left, -2), F.lit(" "), F.element_at(left, -1)))
    after = F.when(F.size(right) >= 1, F.concat(F.lit("R "), F.element_at(right, 1)))
    return rows.withColumn("pattern", F.explode(F.array_compact(F.array(one, two, after))))


def bootstrap(seeds: DataFrame, tokens: DataFrame, min_seeds: int = MIN_SEEDS, sure: float = SURE, doubt: float = DOUBT) -> DataFrame:
    """Sure patterns ``pattern, kind, score`` of the pattern-instance graph.

    An edge is a distinct (value, pattern). A pattern's score for a kind is pos / (pos + neg + 1):
    pos sums the confidence of its values in that kind, neg counts one for a seed of other kinds only and
    ``doubt`` for every missing part of the confidence of a value that is no seed. It needs ``min_seeds``
    distinct seed values of the kind. A token that sure patterns point at is found with one minus the product of
    (1 - score) over them and keeps that confidence; rounds end when one finds no new (token, kind). Each round
    can only raise scores, so this ends.
    """
    both = contexts(seeds).select("value", "pattern").unionByName(contexts(tokens).select("value", "pattern"))
    edges = stored(both.distinct())
    known = stored(seeds.select("value", "kind").distinct())
    of_seeds = known.select("value").distinct().withColumn("seed", F.lit(1))
    # values of a pattern that are seeds of any kind, and all its values
    size = stored(edges.join(of_seeds, "value", "left").groupBy("pattern").agg(F.count("seed").alias("labelled"), F.count(F.lit(1)).alias("total")))
    votes = edges.join(known, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= min_seeds)
    votes = stored(votes.join(size, "pattern"))
    open_edges = stored(edges.join(of_seeds, "value", "left_anti").join(votes.select("pattern").distinct(), "pattern", "left_semi"))
    discard(edges, size)
    found = None
    while True:
        gained = votes.withColumn("gain", F.lit(0.0))
        if found is not None:
            gain = open_edges.join(found, "value").groupBy("pattern", "kind").agg(F.sum("conf").alias("gain"))
            gained = votes.join(gain, ["pattern", "kind"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
        pos = F.col("seeds") + F.col("gain")
        neg = F.col("labelled") - F.col("seeds") + doubt * (F.col("total") - F.col("labelled") - F.col("gain"))
        strong = stored(gained.select("pattern", "kind", (pos / (pos + neg + 1)).alias("score")).filter(F.col("score") >= sure))
        new = open_edges.join(strong, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("conf"))
        if found is not None:
            new = new.join(found, ["value", "kind"], "left_anti")
        new = stored(new)
        if new.isEmpty():
            return strong
        found = new if found is None else stored(found.unionByName(new))
        discard(strong)


def find_pii(docs: DataFrame, min_seeds: int = MIN_SEEDS, sure: float = SURE, doubt: float = DOUBT) -> DataFrame:
    """Spans of personal data: ``doc_id, fp, kind, start, end, base``, one row per span.

    ``base`` tells matches of the base rules from tokens found by context; a token that
    overlaps a base span is left out, and of several kinds the surest pattern's counts.
    Null and empty texts have no spans; rows with equal id and text share theirs.
    """
    found = matches(documents(docs))
    found = stored(found.filter((F.col("kind") == "token") | _valid(F.col("kind"), F.col("value"))))
    seeds = found.filter(F.col("kind") != "token")
    # tokens clear of base spans: none that began before reaches into them, none begins inside
    is_base = F.col("kind") != "token"
    so_far = lambda order: Window.partitionBy("doc_id", "fp").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(is_base, F.col("end"))).over(so_far(F.asc("start")))
    next_ = F.min(F.when(is_base, F.col("start"))).over(so_far(F.desc("start")))
    lone = found.withColumns({"reach": reach, "next": next_}).filter(~is_base)
    lone = lone.filter((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    tokens = stored(lone.drop("reach", "next", "kind"))
    strong = bootstrap(seeds, tokens, min_seeds, sure, doubt)
    hits = contexts(tokens).join(strong, "pattern").groupBy("doc_id", "fp", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    extra = hits.select("doc_id", "fp", F.col("best.kind").alias("kind"), "start", "end", F.lit(False).alias("base"))
    return seeds.select("doc_id", "fp", "kind", "start", "end", F.lit(True).alias("base")).unionByName(extra)


def per_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (with ``fp``) and its spans as an array of (start, rank, end, kind, base) by start."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    lists = spans.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>")
    return attach(docs, lists).withColumn("spans", F.coalesce("spans", empty))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text`` and ``spans``) with each span, or run of overlapping spans, replaced by ``[KIND]`` of the first."""
    run = "struct<start:int,end:int,kind:string>"
    new = lambda x: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    last = lambda s: F.element_at(s, -1)
    longer = lambda s, x: F.array(F.struct(last(s)["start"].alias("start"), F.greatest(last(s)["end"], x["end"]).alias("end"), last(s)["kind"].alias("kind")))
    add = lambda s, x: F.when((F.size(s) > 0) & (x["start"] < F.try_element_at(s, F.lit(-1))["end"]), F.concat(F.slice(s, 1, F.size(s) - 1), longer(s, x))).otherwise(F.concat(s, new(x)))
    step = docs.withColumn("_m", F.when(F.size("spans") > 0, F.aggregate("spans", F.array().cast(f"array<{run}>"), add)))
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at("_m", k)["end"])
    piece = lambda x, k: F.concat(F.substr("text", before(k) + 1, x["start"] - before(k)), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    tail = F.substr("text", F.element_at("_m", -1)["end"] + 1, F.length("text"))
    out = F.when(F.col("_m").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("_m", piece), ""), tail))
    return step.withColumn("text", out).drop("_m")


@query("op6_pii_context")
def pii_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = per_document(documents(docs).select("doc_id", "fp"), find_pii(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
