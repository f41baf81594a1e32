"""Analytics over evaluation results.

Long table: eval_id, domain, model, metric, value. Only values above zero count unless said
otherwise. Every statistic is one or two aggregations; the tables that get ranked have one
row per model and metric.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgraph.functions.lexicons import EVAL_COLUMNS, RECOMMENDATION, RECOMMENDATIONS
from threadgraph.operators.common import rnd, top_k
from threadgraph.session import materialize

MODEL_ORDER = ["gnn", "mcts", "rmodel"]


def positive(long: DataFrame) -> DataFrame:
    return long.filter(F.col("value") > 0)


def success_rate(long: DataFrame, metric: str) -> DataFrame:
    """Share of evaluations with any model above zero, and the number of domains."""
    per = long.filter(F.col("metric") == metric).groupBy("eval_id", "domain").agg(F.max(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("ok"))
    # counts per domain first: the distinct count runs over one row per domain
    dom = per.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))
    return dom.agg(F.sum("n").alias("evaluations"), rnd(F.sum("ok") / F.sum("n") * 100).alias("success_rate"), F.count(F.lit(1)).alias("domains"))


def metric_stats(long: DataFrame, population: bool = False) -> DataFrame:
    """n, mean, standard deviation, min, max per model and metric, ranked by mean per metric."""
    std = F.stddev_pop if population else F.stddev_samp
    agg = positive(long).groupBy("model", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), std("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    rank = F.rank().over(Window.partitionBy("metric").orderBy(rnd(F.col("mean")).desc()))
    return agg.withColumn("rank", rank.cast("long"))


def metric_strength(long: DataFrame, core: list[str]) -> DataFrame:
    """Mean over models of the model means, ranked, tagged core or enhanced."""
    model = positive(long).groupBy("model", "metric").agg(F.avg("value").alias("m"))
    out = model.groupBy("metric").agg(F.avg("m").alias("strength"))
    out = out.withColumn("rank", F.rank().over(Window.orderBy(rnd(F.col("strength")).desc())).cast("long"))  # one row per metric
    return out.withColumn("kind", F.when(F.col("metric").isin(*core), "core").otherwise("enhanced"))


def best_model(wide: DataFrame, cols: dict[str, str], last: bool = False) -> DataFrame:
    """Adds best model and gap (max - min). Ties go to the first model, or the last one."""
    vals = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols.values()]
    top = F.greatest(*vals)
    pairs = list(zip(cols.keys(), vals))
    best: Column = F.when(F.lit(False), F.lit(""))
    for name, v in (reversed(pairs) if last else pairs):
        best = best.when(v == top, F.lit(name))
    return wide.withColumn("best_model", best).withColumn("gap", top - F.least(*vals))


def pivot_models(long: DataFrame, metric: str) -> DataFrame:
    """One row per evaluation with a column per model (null when missing)."""
    one = long.filter(F.col("metric") == metric)
    pick = [F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in MODEL_ORDER]
    return one.groupBy("eval_id", "domain").agg(*pick)


def overall_by_model(long: DataFrame, n_metrics: int) -> DataFrame:
    """Mean over all metrics with missing ones as zero."""
    return long.groupBy("eval_id", "model").agg((F.sum(F.coalesce("value", F.lit(0.0))) / n_metrics).alias("overall"))


def with_share(counts: DataFrame, col: str) -> DataFrame:
    """Adds each row's percentage of the total; the total is one row, joined, not a global window."""
    total = counts.agg(F.sum(col).alias("_total")).withColumn("_k", F.lit(1))
    out = counts.withColumn("_k", F.lit(1)).join(total, "_k")
    return out.withColumn("share", rnd(100.0 * F.col(col) / F.col("_total"))).drop("_k", "_total")


def win_distribution(best: DataFrame, col: str = "best_model") -> DataFrame:
    return with_share(best.groupBy(col).agg(F.count(F.lit(1)).alias("wins")), "wins")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], parts: int = 64, limit: int = 200_000) -> DataFrame:
    """Interpolated quantiles ``q0, q1, ...`` per key, exact, without a group's values in one task.

    The cell that holds a wanted rank is cut at ``parts - 1`` of its approximate quantiles (a sketch,
    combined inside tasks) again and again, until it has at most ``limit`` distinct values; only those
    are put in order. Cuts follow the values, so however far these are spread, a cell shrinks by about
    ``parts`` in a round. Nulls and NaN do not count, infinite values do. Runs a job per round while
    the plan is built.
    """
    k = [*keys, "_one"]
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_one", F.lit(1))
    vals = materialize(kept.groupBy(*k, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    at = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(at(q)).alias("off"), at(q).alias("at")) for i, q in enumerate(qs) for side, f in ((0, F.floor), (1, F.ceil))])
    ends = vals.groupBy(*k).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_total"))
    state = materialize(ends.select(*k, "_lo", "_hi", "_d", F.explode(ranks).alias("w")).select(*k, "_lo", "_hi", "_d", "w.*"))
    cell = [*k, "_lo", "_hi"]
    before = lambda part, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = lambda cells: vals.join(cells.distinct(), k).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    while True:
        wide = state.filter(F.col("_d") > limit)
        if wide.isEmpty():
            break
        cuts = inside(wide.select(*cell)).groupBy(*cell).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 100 * parts).alias("_cuts"))
        part = F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
        hist = inside(materialize(cuts)).groupBy(*cell, part.alias("_b")).agg(
            F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        hit = wide.join(hist.withColumn("_before", before(cell, "_b")), cell)
        hit = hit.filter((F.col("_before") <= F.col("off")) & (F.col("off") < F.col("_before") + F.col("_n")))
        hit = hit.select(*k, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_m").alias("_d"), "i", "side", (F.col("off") - F.col("_before")).alias("off"), "at")
        state = materialize(state.filter(F.col("_d") <= limit).unionByName(hit))
    got = inside(state.select(*cell)).withColumn("_start", before(cell, "_v")).join(state, cell)
    got = got.filter((F.col("_start") <= F.col("off")) & (F.col("off") < F.col("_start") + F.col("_n")))
    pair = got.groupBy(*k, "i").agg(F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("b"), F.max("at").alias("at"))
    frac = F.col("at") - F.floor("at")
    pair = pair.withColumn("v", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - frac) + F.col("b") * frac))
    out = pair.groupBy(*k).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(len(qs))])
    return out.drop("_one") if keys else out


def gap_stats(best: DataFrame) -> DataFrame:
    """Non-zero gaps: mean, median, maximum and the competition class of the mean."""
    gaps = best.filter("gap <> 0")
    g = gaps.agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"), F.max("gap").alias("max"), F.lit(1).alias("_one"))
    g = g.join(exact_quantiles(gaps, [], "gap", [0.5]), "_one", "left").select("n", "mean", F.col("q0").alias("median"), "max")
    cls = F.when(F.col("mean") < 0.1, "very close").when(F.col("mean") < 0.2, "close").when(F.col("mean") < 0.3, "moderate").otherwise("clear")
    return g.withColumn("competition", cls)


def graph_efficiency(wide: DataFrame, nodes: str, score: str, out: str) -> DataFrame:
    n, s = F.coalesce(F.col(nodes), F.lit(0.0)), F.coalesce(F.col(score), F.lit(0.0))
    return wide.withColumn(out, F.when(s > 0, n / F.greatest(s, F.lit(0.001))).otherwise(0.0))


def bounded_ratio_stats(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    inside = df.filter((F.col(col) > low) & (F.col(col) < high))
    g = inside.agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"), F.lit(1).alias("_one"))
    g = g.join(exact_quantiles(inside, [], col, [0.5]), "_one", "left").select("n", "mean", F.col("q0").alias("median"), "min", "max")
    size = F.when(F.col("mean") > 1.5, "larger").when(F.col("mean") < 0.67, "smaller").otherwise("similar")
    return g.withColumn("interpretation", size)


def source_distribution(df: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Counts and shares per value combination, most frequent first."""
    c = with_share(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "n")
    return c.orderBy(F.col("n").desc(), *keys).limit(top)


def pair_correlations(long: DataFrame) -> DataFrame:
    """Pearson r and n per model and metric pair over evaluations where both are above zero.

    The metrics of one evaluation and model make a row per pair, and every correlation is an
    aggregate over those rows, so any number of metrics is covered. A row holds the metrics of
    one evaluation only; pairs that never occur together are left out.
    """
    best = long.groupBy("eval_id", "model", "metric").agg(F.max("value").alias("value"))
    row = best.groupBy("eval_id", "model").agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("m"))
    first = row.select("model", "m", F.posexplode("m").alias("i", "a"))
    pairs = first.select("model", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    pairs = pairs.select("model", F.col("a.metric").alias("metric_a"), F.col("b.metric").alias("metric_b"), F.col("a.value").alias("x"), F.col("b.value").alias("y"))
    both = (F.col("x") > 0) & (F.col("y") > 0)
    return pairs.groupBy("model", "metric_a", "metric_b").agg(
        F.corr(F.when(both, F.col("x")), F.when(both, F.col("y"))).alias("r"), F.count(F.when(both, F.col("x"))).alias("n"))


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / ((1.0 + step * d) or tiny)
            c = (1.0 + step / c) or tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return h


def two_sided_p(r: float, n: int) -> float:
    """p-value of a Pearson correlation from Student's t with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    if r == 0.0:
        return 1.0
    df = n - 2
    t2 = r * r * df / (1.0 - r * r)
    a, b, x = df / 2.0, 0.5, df / (df + t2)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(t2 / (df + t2)))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def significant_correlations(pairs: DataFrame, min_r: float = 0.3, max_p: float = 0.05, min_n: int = 10, top: int = 10,
                             strong: float = 0.7, moderate: float = 0.5) -> DataFrame:
    """Pairs with enough rows, a clear r and a small p, strongest first. ``pairs`` is an
    aggregate with one row per pair, so the p-value helper runs on a handful of rows."""
    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(x, int(k)) if x == x else float("nan") for x, k in zip(r.fillna(float("nan")), n)])

    ok = pairs.filter((F.col("n") > min_n) & (F.abs("r") > min_r)).withColumn("p", p_value("r", "n")).filter(F.col("p") < max_p)
    strength = F.when(F.abs("r") > strong, "strong").when(F.abs("r") > moderate, "moderate").otherwise("weak")
    return ok.withColumn("strength", strength).orderBy(F.abs("r").desc(), "model", "metric_a", "metric_b").limit(top)


def domain_patterns(long: DataFrame, top: int = 5, min_rows: int = 3) -> DataFrame:
    """Means per metric of the most frequent domains."""
    per = long.select("eval_id", "domain").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    dom = per.filter(F.col("rows") > min_rows).orderBy(F.col("rows").desc(), "domain").limit(top)
    means = positive(long).groupBy("domain", "metric").agg(F.avg("value").alias("mean"))
    return means.join(dom, "domain")


def summary_quantiles(long: DataFrame, keep_all: list[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max per model and metric."""
    df = long.filter((F.col("value") > 0) | F.col("metric").isin(*keep_all)) if keep_all else positive(long)
    agg = df.groupBy("model", "metric").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(df, ["model", "metric"], "value", [0.25, 0.5, 0.75])
    return agg.join(q, ["model", "metric"], "left").select("model", "metric", "count", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75"), "max")


box_stats = summary_quantiles


def score_matrix(long: DataFrame, metrics: list[str], ten_point: list[str] = ()) -> DataFrame:
    """Model x metric means, ten-point metrics scaled to one, missing as zero."""
    mean = lambda m: F.coalesce(F.avg(F.when((F.col("metric") == m) & (F.col("value") > 0), F.col("value"))), F.lit(0.0)) / (10.0 if m in ten_point else 1.0)
    return long.groupBy("model").agg(*[mean(m).alias(m) for m in metrics])


def pooled_correlation_matrix(long: DataFrame, metrics: list[str]) -> DataFrame:
    """Correlation of metric columns over aligned (evaluation, model) rows where both exist."""
    wide = long.groupBy("eval_id", "model").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    pairs = [(a, b) for a in metrics for b in metrics]
    agg = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(rows).alias("p")).select("p.*")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def strengths_weaknesses(long: DataFrame, k: int = 8, ten_point: list[str] = ()) -> DataFrame:
    """The k best and k worst (model, metric) means on a common scale."""
    m = positive(long).groupBy("model", "metric").agg(F.avg("value").alias("mean"))
    m = m.withColumn("mean", F.when(F.col("metric").isin(*ten_point), F.col("mean") / 10).otherwise(F.col("mean"))) if ten_point else m
    tie = ["model", "metric"]
    best = top_k(m, [], [rnd(F.col("mean")).desc(), *tie], k, "rank").withColumn("side", F.lit("strength"))
    worst = top_k(m, [], [rnd(F.col("mean")), *tie], k, "rank").withColumn("side", F.lit("weakness"))
    return best.unionByName(worst).withColumn("rank", F.col("rank").cast("long"))


def model_extremes(long: DataFrame, ten_point: Sequence[str] = ()) -> DataFrame:
    """Best and worst metric per model with a recommendation for the worst; ten-point metrics are divided by ten first."""
    m = positive(long).groupBy("model", "metric").agg(F.avg("value").alias("mean"))
    if ten_point:
        m = m.withColumn("mean", F.when(F.col("metric").isin(*ten_point), F.col("mean") / 10.0).otherwise(F.col("mean")))
    out = m.groupBy("model").agg(F.max_by("metric", F.struct(rnd(F.col("mean")), F.col("metric"))).alias("best_metric"),
                                 F.min_by("metric", F.struct(rnd(F.col("mean")), F.col("metric"))).alias("worst_metric"))
    advice = F.lit(RECOMMENDATION)
    for metric, text in RECOMMENDATIONS.items():
        advice = F.when(F.col("worst_metric") == metric, F.lit(text)).otherwise(advice)
    return out.withColumn("recommendation", advice)


def core_vs_enhanced_gap(long: DataFrame, core: list[str], scale: float = 10.0, limit: float = 0.1) -> DataFrame:
    m = positive(long).groupBy("model", "metric").agg(F.avg("value").alias("mean"))
    is_core = F.col("metric").isin(*core)
    out = m.groupBy("model").agg(F.avg(F.when(is_core, F.col("mean"))).alias("core_mean"), (F.avg(F.when(~is_core, F.col("mean"))) / scale).alias("enhanced_mean"))
    gap = F.col("core_mean") - F.col("enhanced_mean")
    cls = F.when(F.abs(gap) <= limit, "balanced").when(gap > 0, "core stronger").otherwise("enhanced stronger")
    return out.withColumn("gap", gap).withColumn("class", cls)


def micro_prf(gold: DataFrame, pred: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Micro precision, recall and F over predicted keys only."""
    g = gold.select(*keys, F.col("score").alias("gold"))
    j = pred.join(g, keys, "left").select((F.col("score") >= threshold).alias("hit"), (F.coalesce("gold", F.lit(0.0)) >= threshold).alias("true"))
    c = j.agg(F.sum(F.when(F.col("hit") & F.col("true"), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("hit") & ~F.col("true"), 1).otherwise(0)).alias("fp"),
              F.sum(F.when(~F.col("hit") & F.col("true"), 1).otherwise(0)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f_score", ratio(2 * p * r, p + r))


def rank_models(long: DataFrame) -> DataFrame:
    medal = F.element_at(F.array(F.lit("gold"), F.lit("silver"), F.lit("bronze")), F.least(F.col("rank"), F.lit(3)).cast("int"))
    return metric_stats(long).select("metric", "model", "mean", "rank", F.when(F.col("rank") <= 3, medal).alias("medal"))


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested structs become ``parent_child`` columns, to any depth."""
    from pyspark.sql import types as T

    def walk(schema: T.StructType, path: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in here)).alias("_".join(here)))
        return out
    return df.select(*walk(df.schema, []))


def eval_table(df: DataFrame, columns=EVAL_COLUMNS, failed: str = "failed") -> DataFrame:
    """Fixed column order; failed rows keep their identity, other columns take defaults."""
    words = {"domain": "unknown", "title": "error", "prompt": "", "dominant_domain": "unknown", "best_performing_model": "none",
             "selected_gnn_subgraph": "error", "selected_mcts_subgraph": "error", "mcts_uses_combined_graph": "error"}
    bad = F.coalesce(F.col(failed), F.lit(False)) if failed in df.columns else F.lit(False)
    out = []
    for c in columns:
        col = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        default = F.lit(words.get(c, "0"))
        if c == "prompt":
            value = F.when(bad, F.concat(F.substring(F.coalesce(col, F.lit("")), 1, 100), F.lit("..."))).otherwise(col)
        elif c in ("timestamp", "domain", "title"):
            value = F.coalesce(col, default) if c != "timestamp" else col
        else:
            value = F.when(bad, default).otherwise(F.coalesce(col, default))
        out.append(value.alias(c))
    return df.select(*out)


