"""URL filters: rules on host and path, then boosted trees on lexical features of the url.

The trees are trained from urls with a known label and see only the text of the url. All
steps are DataFrame expressions and the library's own tree trainer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.llm import query
from threadgraph.llm.common import stored, table

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with the rule's.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
FEATURES = ("n_url", "n_host", "n_path", "depth", "host_parts", "digit_ratio", "host_digit_ratio", "entropy", "n_params", "n_query",
            "hyphens", "has_fragment", "secure", "suffix_log_count", "suffix_rate")
#: Labelled urls used for training; the bound keeps the trainer's memory fixed.
MAX_TRAINING_ROWS = 200_000
PRIOR = 20.0


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """``host`` and ``path``: after the first ``://``; null urls and urls without it have both empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    cut = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    low = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({"host": low, "path": path})


def rule_of(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Longest fitting rule (its text, then its verdict), tried from the longest down."""
    host, path = F.col("host"), F.col("path")
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Lexical features of rows that have ``host`` and ``path``; an empty url has zeros."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", F.lit(0.0)).otherwise(share(c) * F.log2(share(c))))
    query_ = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    return urls.withColumns({
        "n_url": n.cast("double"), "n_host": F.length("host").cast("double"), "n_path": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "host_parts": count(F.col("host"), "."),
        "digit_ratio": over(digits(u), n), "host_digit_ratio": over(digits(F.col("host")), F.length("host")),
        "entropy": F.when(n > 0, bits).otherwise(F.lit(0.0)),
        "n_params": F.when(query_ != "", count(query_, "&") + 1).otherwise(F.lit(0.0)), "n_query": F.length(query_).cast("double"),
        "hyphens": count(u, "-"), "has_fragment": F.contains(u, F.lit("#")).cast("double"), "secure": u.startswith("https://").cast("double"),
        "suffix": F.element_at(F.split("host", r"\."), -1),
    })


def suffix_table(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per host suffix: how often it occurs in all urls, and its blocked rate drawn to the overall rate."""
    seen = urls.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    lab = labelled.groupBy("suffix").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("m"))
    total = lab.agg((F.sum("bad") / F.sum("m")).alias("rate")).first()
    rate = F.lit(float(total["rate"] or 0.0))
    bad, m = F.coalesce("bad", F.lit(0.0)), F.coalesce("m", F.lit(0))
    return seen.join(lab, "suffix", "left").select("suffix", F.log1p("n").alias("suffix_log_count"), ((bad + rate * PRIOR) / (m + PRIOR)).alias("suffix_rate"))


def train(rows: DataFrame, max_rows: int = MAX_TRAINING_ROWS, rounds: int = 20, depth: int = 4):
    """Boosted trees from rows with ``label`` and features; ``None`` unless both labels occur.

    Beyond ``max_rows`` labelled rows, a hash of the url picks about that many.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if set(counts) != {0.0, 1.0}:
        return None
    total = sum(counts.values())
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    weight = {k: total / (2.0 * v) for k, v in counts.items()}
    rows = rows.withColumn("weight", F.when(F.col("label") == 1.0, weight[1.0]).otherwise(weight[0.0]))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label", "weight")
    return GBTClassifier(maxIter=rounds, maxDepth=depth, weightCol="weight", seed=7, subsamplingRate=1.0, maxMemoryInMB=256).fit(rows)


def judge(urls: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.6) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score`` for every row of ``urls``.

    ``labels`` has ``page_id`` and ``label`` (1.0: block). Where no rule fits, the verdict is
    block when the trees' probability reaches ``threshold``; without both labels the trees are
    left out and the verdict is allow. Null urls keep empty parts; repeated rows are judged alike.
    """
    name, verdict = rule_of(rules)
    base = stored(lexical(parts(urls.select("page_id", "url"))).withColumns({"rule": name, "by_rule": verdict}))
    known = base.join(labels.groupBy("page_id").agg(F.max("label").alias("label")), "page_id")
    suffixes = suffix_table(base, known)
    plus = lambda df: df.join(suffixes, "suffix", "left").fillna(0.0, ["suffix_log_count", "suffix_rate"])
    model = train(plus(known))
    out = plus(base)
    if model is None:
        score = F.lit(0.0)
    else:
        out = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out))
        score = vector_to_array("probability")[1]
    out = out.withColumn("score", score)
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "score")


@query("op9_url_filter")
def urls_q(spark, sf_dir):
    """Pages share ids with documents: a page of a toxic or low-quality document is labelled block."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.cast("double").alias("label")).dropna()
    return judge(table(spark, sf_dir, "pages"), known).select("page_id", "host", "path", "rule", "verdict", "score")
