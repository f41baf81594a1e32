"""Evaluation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgraph import fixtures as fx
from threadgraph.catalog import query
from threadgraph.catalog.views import RND, with_views
from threadgraph.functions.lexicons import EVAL_COLUMNS
from threadgraph.operators.common import rnd
from threadgraph.plans import evaluation as ev

CORE = ["discount", "tax"]
METRICS = fx.METRICS


def _r(df, *cols):
    return df.withColumns({c: rnd(F.col(c)) for c in cols})


@query("a11_success_rate", with_views(f"""WITH p AS (SELECT eval_id, domain, max(CASE WHEN value>0 THEN 1.0::DOUBLE ELSE 0 END) AS ok FROM eval_long WHERE metric='tax' GROUP BY ALL)
 SELECT count(*) AS evaluations, {RND('sum(ok)/count(*)*100')} AS success_rate, count(DISTINCT domain) AS domains FROM p"""))
def success_q(spark, sf):
    return ev.success_rate(fx.eval_long(spark, sf), "tax")


STATS = "m AS (SELECT model, metric, count(*) AS n, avg(value) AS mean, {std}(value) AS std, min(value) AS min, max(value) AS max FROM eval_long WHERE value>0 GROUP BY ALL)"


@query("a12_metric_stats", with_views("WITH " + STATS.format(std="stddev_samp") + f" SELECT model, metric, n, {RND('mean')} AS mean, {RND('std')} AS std, {RND('min')} AS min, {RND('max')} AS max, rank() OVER (PARTITION BY metric ORDER BY {RND('mean')} DESC) AS rank FROM m"))
def stats_q(spark, sf):
    return _r(ev.metric_stats(fx.eval_long(spark, sf)), "mean", "std", "min", "max")


@query("a12_metric_stats_population", with_views("WITH " + STATS.format(std="stddev_pop") + f" SELECT model, metric, n, {RND('std')} AS std FROM m"))
def stats_pop_q(spark, sf):
    return _r(ev.metric_stats(fx.eval_long(spark, sf), population=True), "std").select("model", "metric", "n", "std")


@query("w13_rank_models", with_views("WITH " + STATS.format(std="stddev_samp") + f", r AS (SELECT metric, model, {RND('mean')} AS mean, rank() OVER (PARTITION BY metric ORDER BY {RND('mean')} DESC) AS rank FROM m) SELECT *, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal FROM r"))
def rank_models_q(spark, sf):
    return _r(ev.rank_models(fx.eval_long(spark, sf)), "mean")


@query("a13_metric_strength", with_views("WITH " + STATS.format(std="stddev_samp") + f", s AS (SELECT metric, avg(mean) AS x FROM m GROUP BY 1) SELECT metric, {RND('x')} AS strength, rank() OVER (ORDER BY {RND('x')} DESC) AS rank, CASE WHEN metric IN ('discount','tax') THEN 'core' ELSE 'enhanced' END AS kind FROM s"))
def strength_q(spark, sf):
    return _r(ev.metric_strength(fx.eval_long(spark, sf), CORE), "strength")


PIV = """WITH w AS (SELECT eval_id, domain, max(value) FILTER (model='gnn') AS gnn, max(value) FILTER (model='mcts') AS mcts, max(value) FILTER (model='rmodel') AS rmodel FROM eval_long WHERE metric='quantity' GROUP BY ALL),
 z AS (SELECT *, coalesce(gnn,0) AS a, coalesce(mcts,0) AS b, coalesce(rmodel,0) AS c FROM w),
 b AS (SELECT *, CASE WHEN a=greatest(a,b,c) THEN 'gnn' WHEN b=greatest(a,b,c) THEN 'mcts' ELSE 'rmodel' END AS best_model, CASE WHEN c=greatest(a,b,c) THEN 'rmodel' WHEN b=greatest(a,b,c) THEN 'mcts' ELSE 'gnn' END AS last_best, greatest(a,b,c)-least(a,b,c) AS gap FROM z) """


def _best(spark, sf, last=False):
    wide = ev.pivot_models(fx.eval_long(spark, sf), "quantity")
    return ev.best_model(wide, {m: m for m in ev.MODEL_ORDER}, last)


@query("a27_best_model", with_views(PIV + f"SELECT eval_id, best_model, last_best, {RND('gap')} AS gap FROM b"))
def best_q(spark, sf):
    first = _best(spark, sf)
    both = ev.best_model(first.withColumnRenamed("best_model", "first_best"), {m: m for m in ev.MODEL_ORDER}, last=True)
    return both.select("eval_id", F.col("first_best").alias("best_model"), F.col("best_model").alias("last_best"), rnd(F.col("gap")).alias("gap"))


@query("a27_overall_by_model", with_views(f"SELECT eval_id, model, {RND('sum(coalesce(value,0))/5')} AS overall FROM eval_long GROUP BY ALL"))
def overall_q(spark, sf):
    return _r(ev.overall_by_model(fx.eval_long(spark, sf), len(METRICS)), "overall")


@query("a14_win_distribution", with_views(PIV + f"SELECT best_model, count(*) AS wins, {RND('100.0::DOUBLE*count(*)/(SELECT count(*) FROM b)')} AS share FROM b GROUP BY 1"))
def win_q(spark, sf):
    return ev.win_distribution(_best(spark, sf))


@query("a15_gap_stats", with_views(PIV + f"""SELECT count(*) AS n, {RND('avg(gap)')} AS mean, {RND('quantile_cont(gap,0.5)')} AS median, {RND('max(gap)')} AS max,
 CASE WHEN avg(gap)<.1 THEN 'very close' WHEN avg(gap)<.2 THEN 'close' WHEN avg(gap)<.3 THEN 'moderate' ELSE 'clear' END AS competition FROM b WHERE gap<>0"""))
def gap_q(spark, sf):
    return _r(ev.gap_stats(_best(spark, sf)), "mean", "median", "max")


EFF = """WITH e AS (SELECT eval_id, max(value) FILTER (metric='node_count' AND model='gnn') AS gn, max(value) FILTER (metric='node_count' AND model='mcts') AS mn, max(value) FILTER (metric='quantity' AND model='gnn') AS gs, max(value) FILTER (metric='quantity' AND model='mcts') AS ms FROM eval_long GROUP BY 1),
 f AS (SELECT eval_id, CASE WHEN gs>0 THEN coalesce(gn,0)/greatest(gs,0.001) ELSE 0.0 END AS gnn_ratio, CASE WHEN ms>0 THEN coalesce(mn,0)/greatest(ms,0.001) ELSE 0.0 END AS mcts_ratio, abs(coalesce(gn,0)-coalesce(mn,0)) AS size_difference, coalesce(gn,0) AS gn, coalesce(mn,0) AS mn FROM e) """


def _eff(spark, sf):
    long = fx.eval_long(spark, sf)
    pick = lambda met, mod: F.max(F.when((F.col("metric") == met) & (F.col("model") == mod), F.col("value")))
    w = long.groupBy("eval_id").agg(pick("node_count", "gnn").alias("gn"), pick("node_count", "mcts").alias("mn"), pick("quantity", "gnn").alias("gs"), pick("quantity", "mcts").alias("ms"))
    w = ev.graph_efficiency(ev.graph_efficiency(w, "gn", "gs", "gnn_ratio"), "mn", "ms", "mcts_ratio")
    return w.withColumn("size_difference", F.abs(F.coalesce("gn", F.lit(0.0)) - F.coalesce("mn", F.lit(0.0))))


@query("a28_graph_efficiency", with_views(EFF + f"SELECT eval_id, {RND('gnn_ratio')} AS gnn_ratio, {RND('mcts_ratio')} AS mcts_ratio, size_difference FROM f"))
def eff_q(spark, sf):
    return _r(_eff(spark, sf), "gnn_ratio", "mcts_ratio").select("eval_id", "gnn_ratio", "mcts_ratio", "size_difference")


@query("a16_bounded_ratio_stats", with_views(EFF + f"""SELECT count(*) AS n, {RND('avg(r)')} AS mean, {RND('quantile_cont(r,0.5)')} AS median, {RND('min(r)')} AS min, {RND('max(r)')} AS max,
 CASE WHEN avg(r)>1.5 THEN 'larger' WHEN avg(r)<0.67 THEN 'smaller' ELSE 'similar' END AS interpretation FROM (SELECT CASE WHEN mn>0 THEN gn/mn ELSE 0 END AS r FROM f) WHERE r>0.1 AND r<10"""))
def ratio_q(spark, sf):
    w = _eff(spark, sf).withColumn("r", F.when(F.col("mn") > 0, F.coalesce("gn", F.lit(0.0)) / F.col("mn")).otherwise(0.0))
    return _r(ev.bounded_ratio_stats(w, "r", 0.1, 10), "mean", "median", "min", "max")


@query("a17_source_distribution", with_views(PIV + f"SELECT has_gnn, has_mcts, count(*) AS n, {RND('100.0::DOUBLE*count(*)/(SELECT count(*) FROM w)')} AS share FROM (SELECT gnn IS NOT NULL AS has_gnn, mcts IS NOT NULL AS has_mcts FROM w) GROUP BY 1,2 ORDER BY n DESC, 1, 2 LIMIT 5"))
def source_q(spark, sf):
    w = ev.pivot_models(fx.eval_long(spark, sf), "quantity").select(F.col("gnn").isNotNull().alias("has_gnn"), F.col("mcts").isNotNull().alias("has_mcts"))
    return ev.source_distribution(w, ["has_gnn", "has_mcts"])


PAIRS = """WITH p AS (SELECT a.model, a.metric AS metric_a, b.metric AS metric_b, corr(a.value, b.value) AS r, count(*) AS n FROM eval_long a JOIN eval_long b
 ON a.eval_id=b.eval_id AND a.model=b.model AND a.metric<b.metric WHERE a.value>0 AND b.value>0 GROUP BY ALL) """


@query("a18_pair_correlations", with_views(PAIRS + f"SELECT model, metric_a, metric_b, {RND('r')} AS r, n FROM p"))
def pairs_q(spark, sf):
    return _r(ev.pair_correlations(fx.eval_long(spark, sf)), "r")


@query("a18_significant_correlations", with_views(PAIRS + f"SELECT model, metric_a, metric_b, {RND('r')} AS r, n, CASE WHEN abs(r)>.7 THEN 'strong' WHEN abs(r)>.5 THEN 'moderate' ELSE 'weak' END AS strength FROM p WHERE n>10 AND abs(r)>0.05 ORDER BY abs(r) DESC LIMIT 10"))
def significant_q(spark, sf):
    s = ev.significant_correlations(ev.pair_correlations(fx.eval_long(spark, sf)), min_r=0.05)
    return _r(s, "r").drop("p")


@query("a19_domain_patterns", with_views(f"""WITH d AS (SELECT domain, count(DISTINCT eval_id) AS rows FROM eval_long GROUP BY 1 HAVING count(DISTINCT eval_id)>3 ORDER BY 2 DESC, 1 LIMIT 5)
 SELECT domain, metric, {RND('avg(value)')} AS mean, any_value(rows) AS rows FROM eval_long JOIN d USING (domain) WHERE value>0 GROUP BY domain, metric"""))
def domains_q(spark, sf):
    return _r(ev.domain_patterns(fx.eval_long(spark, sf)), "mean")


QUANT = f"SELECT model, metric, count(*) AS count, {RND('avg(value)')} AS mean, {RND('stddev_samp(value)')} AS std, {RND('min(value)')} AS min, {RND('quantile_cont(value,0.25)')} AS q25, {RND('quantile_cont(value,0.5)')} AS median, {RND('quantile_cont(value,0.75)')} AS q75, {RND('max(value)')} AS max FROM eval_long "


@query("a20_summary_quantiles", with_views(QUANT + "WHERE value>0 OR metric IN ('price') GROUP BY ALL"))
def quantiles_q(spark, sf):
    return _r(ev.summary_quantiles(fx.eval_long(spark, sf), keep_all=["price"]), "mean", "std", "min", "q25", "median", "q75", "max")


@query("a31_box_stats", with_views(f"SELECT model, metric, {RND('min(value)')} AS min, {RND('quantile_cont(value,0.25)')} AS q25, {RND('quantile_cont(value,0.5)')} AS median, {RND('quantile_cont(value,0.75)')} AS q75, {RND('max(value)')} AS max FROM eval_long WHERE value>0 GROUP BY ALL"))
def box_q(spark, sf):
    return _r(ev.box_stats(fx.eval_long(spark, sf)).select("model", "metric", "min", "q25", "median", "q75", "max"), "min", "q25", "median", "q75", "max")


@query("a21_score_matrix", with_views("SELECT model, " + ", ".join(RND(f"coalesce(avg(value) FILTER (metric='{m}' AND value>0),0){'/10' if m == 'node_count' else ''}") + f" AS {m}" for m in METRICS) + " FROM eval_long GROUP BY 1"))
def matrix_q(spark, sf):
    return _r(ev.score_matrix(fx.eval_long(spark, sf), METRICS, ["node_count"]), *METRICS)


@query("a22_pooled_correlation_matrix", with_views(f"SELECT a.metric AS metric_a, b.metric AS metric_b, {RND('corr(a.value,b.value)')} AS r FROM eval_long a JOIN eval_long b ON a.eval_id=b.eval_id AND a.model=b.model GROUP BY ALL"))
def pooled_q(spark, sf):
    return _r(ev.pooled_correlation_matrix(fx.eval_long(spark, sf), METRICS), "r")


@query("a23_trend_line", with_views(f"SELECT {RND('regr_slope(price,quantity)')} AS slope, {RND('regr_intercept(price,quantity)')} AS intercept FROM eval_wide"))
def trend_q(spark, sf):
    return _r(ev.trend_line(fx.eval_wide(spark, sf), "quantity", "price"), "slope", "intercept")


@query("a24_strengths_weaknesses", with_views(f"""WITH m AS (SELECT model, metric, {RND("avg(value)/CASE WHEN metric='node_count' THEN 10 ELSE 1 END")} AS mean FROM eval_long WHERE value>0 GROUP BY model, metric)
 SELECT * FROM (SELECT 'strength' AS side, *, row_number() OVER (ORDER BY mean DESC, model, metric) AS rank FROM m QUALIFY rank<=8) UNION ALL SELECT * FROM (SELECT 'weakness', *, row_number() OVER (ORDER BY mean, model, metric) AS rank FROM m QUALIFY rank<=8)"""))
def strengths_q(spark, sf):
    return _r(ev.strengths_weaknesses(fx.eval_long(spark, sf), 8, ["node_count"]), "mean")


@query("a24_model_extremes", with_views(f"""WITH m AS (SELECT model, metric, {RND("avg(value)/CASE WHEN metric='node_count' THEN 10 ELSE 1 END")} AS mean FROM eval_long WHERE value>0 GROUP BY model, metric)
 SELECT model, arg_max(metric, (mean, metric)) AS best_metric, arg_min(metric, (mean, metric)) AS worst_metric, 'Focus on improving this metric' AS recommendation FROM m GROUP BY 1"""))
def extremes_q(spark, sf):
    return ev.model_extremes(fx.eval_long(spark, sf), ["node_count"])


@query("a25_core_vs_enhanced_gap", with_views(f"""WITH m AS (SELECT model, metric, avg(value) AS mean FROM eval_long WHERE value>0 GROUP BY ALL), g AS (SELECT model, avg(mean) FILTER (metric IN ('discount','tax')) AS c, avg(mean) FILTER (metric NOT IN ('discount','tax'))/10 AS e FROM m GROUP BY 1)
 SELECT model, {RND('c')} AS core_mean, {RND('e')} AS enhanced_mean, {RND('c-e')} AS gap, CASE WHEN abs(c-e)<=0.1 THEN 'balanced' WHEN c>e THEN 'core stronger' ELSE 'enhanced stronger' END AS class FROM g"""))
def core_gap_q(spark, sf):
    return _r(ev.core_vs_enhanced_gap(fx.eval_long(spark, sf), CORE), "core_mean", "enhanced_mean", "gap")


@query("a26_micro_prf", f"""WITH j AS (SELECT (n_chars%100)/100.0::DOUBLE >= 0.5 AS hit, coalesce(quality,0) >= 0.5 AS t FROM documents LEFT JOIN labels USING (doc_id)),
 c AS (SELECT count(*) FILTER (hit AND t) AS tp, count(*) FILTER (hit AND NOT t) AS fp, count(*) FILTER (NOT hit AND t) AS fn FROM j)
 SELECT tp, fp, fn, {RND('tp/(tp+fp)')} AS precision, {RND('tp/(tp+fn)')} AS recall, {RND('2.0*tp/(2*tp+fp+fn)')} AS f_score FROM c""")
def prf_q(spark, sf):
    gold = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    pred = fx.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 100) / 100.0).alias("score"))
    return _r(ev.micro_prf(gold, pred, ["doc_id"], 0.5), "precision", "recall", "f_score")


@query("s11_flatten_metrics", with_views(f"SELECT eval_id, {RND('discount')} AS scores_discount, {RND('tax')} AS scores_more_tax, model AS model FROM eval_wide"))
def flatten_q(spark, sf):
    w = _r(fx.eval_wide(spark, sf), "discount", "tax")
    return ev.flatten_struct(w.select("eval_id", "model", F.struct("discount", F.struct("tax").alias("more")).alias("scores")))


@query("s12_eval_table", with_views(PIV + "SELECT " + ", ".join(
    {"domain": "domain", "title": "eval_id AS title", "prompt": "CASE WHEN gnn IS NULL THEN substr('prompt of '||eval_id,1,100)||'...' ELSE 'prompt of '||eval_id END AS prompt",
     "timestamp": "NULL::VARCHAR AS timestamp", "dominant_domain": "CASE WHEN gnn IS NULL THEN 'unknown' ELSE domain END AS dominant_domain",
     "best_performing_model": "CASE WHEN gnn IS NULL THEN 'none' ELSE best_model END AS best_performing_model",
     "selected_gnn_subgraph": "'error' AS selected_gnn_subgraph", "selected_mcts_subgraph": "'error' AS selected_mcts_subgraph", "mcts_uses_combined_graph": "'error' AS mcts_uses_combined_graph"}.get(c, f"'0' AS {c}")
    for c in EVAL_COLUMNS) + " FROM b"))
def eval_table_q(spark, sf):
    w = _best(spark, sf).select("eval_id", "domain", "gnn", "best_model")
    w = w.select("domain", F.col("eval_id").alias("title"), F.concat(F.lit("prompt of "), "eval_id").alias("prompt"), F.col("domain").alias("dominant_domain"),
                 F.col("best_model").alias("best_performing_model"), F.col("gnn").isNull().alias("failed"))
    return ev.eval_table(w)
