"""Path features, rewards and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgraph import fixtures as fx
from threadgraph.catalog import query
from threadgraph.catalog.graphs import SPLIT, _graph
from threadgraph.catalog.views import RND, with_views
from threadgraph.functions import lexicons as lex
from threadgraph.operators import graph as g
from threadgraph.operators.common import first_by, rnd
from threadgraph.plans import paths as pt
from threadgraph.session import materialize

PREV = "WITH pv AS (SELECT *, lag(subject) OVER w AS ps, lag(object) OVER w AS po, lag(object_layer) OVER w AS pl FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY pos))"


def _case(table, a, b):
    return "CASE " + " ".join(f"WHEN {a}='{x}' AND {b}='{y}' THEN {v}" for (x, y), v in table.items()) + " ELSE 0 END"


def _kw(table, col="predicate"):
    return "CASE " + " ".join(f"WHEN contains(lower({col}),'{k}') THEN {v}" for k, v in table) + " ELSE 0.0 END"


FEAT = PREV + f""", ft AS (SELECT path_id, count(*) AS n, count(*) FILTER (subject=po) AS direct, count(*) FILTER (subject=po OR subject=ps OR object=po OR object=ps) AS semantic,
 count(*) FILTER (pl<>'unknown' AND object_layer<>'unknown') AS known, coalesce(sum({_case(lex.PROGRESSION_VALUES, 'pl', 'object_layer')}),0)::DOUBLE AS progress,
 count(*) FILTER (pl<>subject_layer AND pl<>'unknown' AND subject_layer<>'unknown') AS switches, count(*) FILTER (pl IS NULL OR pl<>object_layer) AS runs,
 sum({_kw(lex.RELATION_QUALITY)})::DOUBLE AS quality, """ + ", ".join(f"count(*) FILTER (subject_layer='{x}') + count(*) FILTER (object_layer='{x}') AS n_{x}" for x in pt.LAYERS) + """,
 count(*) FILTER (object_layer='technology') AS tech, count(*) FILTER (subject='signup' OR object='signup') AS user_steps, max(CASE WHEN po IS NULL AND subject='signup' THEN 1 ELSE 0 END) AS user_start,
 arg_max(object_layer, pos) AS last_layer FROM pv GROUP BY path_id),
 en AS (SELECT path_id, count(DISTINCT e) AS entities FROM (SELECT path_id, subject AS e FROM steps UNION ALL SELECT path_id, object FROM steps) GROUP BY 1),
 f AS (SELECT *, (n_business>0)::INT+(n_system>0)::INT+(n_data>0)::INT+(n_technology>0)::INT AS layers, CASE WHEN n<2 THEN 1.0 ELSE greatest(direct/(n-1), semantic/(n-1)*0.7) END AS coh,
  CASE WHEN n<2 THEN 0.0 ELSE progress/greatest(known,1) END AS prog FROM ft JOIN en USING (path_id)),
 base AS (SELECT *, 0.30::DOUBLE*(least(n/10.0::DOUBLE,1)+CASE WHEN n>10 THEN (n-10)*0.05 ELSE 0 END+CASE WHEN n>=15 THEN 0.3 WHEN n>=12 THEN 0.2 WHEN n>=8 THEN 0.1 ELSE 0 END)
  + 0.25::DOUBLE*(prog+CASE WHEN layers>=3 THEN 0.3 ELSE 0 END) + 0.20::DOUBLE*(coh+CASE WHEN n>1 THEN direct/(n-1)*0.4 ELSE 0 END) + 0.10::DOUBLE*least(layers/4.0::DOUBLE,1) + 0.08::DOUBLE*quality/n
  + 0.05::DOUBLE*least(user_steps/n+CASE WHEN user_start=1 THEN 0.3 ELSE 0 END,1) AS b FROM f),
 rw AS (SELECT *, greatest(0, b + CASE WHEN entities>=20 THEN 0.15 WHEN entities>=15 THEN 0.10 WHEN entities>=10 THEN 0.05 ELSE 0 END + CASE WHEN tech>=5 THEN 0.12 WHEN tech>=3 THEN 0.08 WHEN tech>=1 THEN 0.04 ELSE 0 END
  + CASE WHEN n>=20 THEN 0.20 WHEN n>=15 THEN 0.15 WHEN n>=12 THEN 0.10 ELSE 0 END + CASE WHEN switches>=5 THEN 0.10 WHEN switches>=3 THEN 0.06 ELSE 0 END) AS reward,
  greatest(0, b + CASE WHEN last_layer='technology' THEN 0.1 ELSE 0 END + CASE WHEN runs>=3 THEN 0.1 ELSE 0 END + CASE WHEN n>=15 THEN 0.1 WHEN n>=10 THEN 0.05 ELSE 0 END) AS old_reward FROM base) """


def _steps(spark, sf):
    s = fx.path_steps(spark, sf)
    return s.withColumn("subject_is_user", F.col("subject") == "signup").withColumn("object_is_user", F.col("object") == "signup")


def _triples(spark, sf):
    return _steps(spark, sf).select(F.col("path_id").alias("graph_id"), F.lpad(F.col("pos").cast("string"), 6, "0").alias("seq"), "subject", "predicate", "object",
                                    "subject_layer", "object_layer", "subject_is_user", "object_is_user")


@query("w6_path_coherence", with_views(FEAT + f"SELECT path_id, {RND('coh')} AS coherence FROM f"))
def coherence_q(spark, sf):
    f = pt.path_features(_steps(spark, sf))
    return f.select("path_id", rnd(pt.coherence(F.col("n"), F.col("direct"), F.col("semantic"))).alias("coherence"))


@query("w6_link_coherence_percent", with_views(PREV + f", c AS (SELECT path_id, count(*) AS n, count(*) FILTER (subject=po OR object=ps OR subject=ps OR object=po) AS t FROM pv GROUP BY 1) SELECT path_id, CASE WHEN n>1 THEN {RND('100.0::DOUBLE*t/(n-1)', 0)} ELSE 100.0 END AS coherence FROM c"))
def link_coherence_q(spark, sf):
    return pt.link_coherence_percent(_steps(spark, sf))


@query("w7_layer_progression", with_views(FEAT + f"SELECT path_id, {RND('prog')} AS progression, switches AS transitions FROM f"))
def progression_q(spark, sf):
    f = pt.path_features(_steps(spark, sf))
    return f.select("path_id", rnd(pt.progression(F.col("n"), F.col("progress"), F.col("known"))).alias("progression"), F.col("switches").alias("transitions"))


@query("w9_layer_runs", with_views(FEAT + "SELECT path_id, runs, runs>=3 AS bonus FROM f"))
def runs_q(spark, sf):
    return pt.path_features(_steps(spark, sf)).select("path_id", "runs", (F.col("runs") >= 3).alias("bonus"))


@query("a33_layer_counts", with_views(FEAT + "SELECT path_id, n_business, n_system, n_data, n_technology FROM f"))
def layer_counts_q(spark, sf):
    return pt.path_features(_steps(spark, sf)).select("path_id", *[f"n_{x}" for x in pt.LAYERS])


@query("p32_relation_quality", with_views(f"SELECT path_id, pos, {_kw(lex.RELATION_QUALITY)}::DOUBLE AS quality FROM steps"))
def quality_q(spark, sf):
    return fx.path_steps(spark, sf).select("path_id", "pos", pt.relation_quality(F.col("predicate")).alias("quality"))


@query("g21_path_reward", with_views(FEAT + f"SELECT path_id, n, entities, {RND('reward')} AS reward FROM rw"))
def reward_q(spark, sf):
    return pt.path_reward(_steps(spark, sf)).select("path_id", "n", "entities", rnd(F.col("reward")).alias("reward"))


@query("g21_path_reward_older", with_views(FEAT + f"SELECT path_id, {RND('old_reward')} AS reward FROM rw"))
def old_reward_q(spark, sf):
    return pt.path_reward(_steps(spark, sf), older_bonus=True).select("path_id", rnd(F.col("reward")).alias("reward"))


@query("g22_select_best_path", with_views(FEAT + f", sc AS (SELECT split_part(path_id,'_',1) AS graph_id, path_id, {RND('reward+0.2::DOUBLE*least(n/15.0::DOUBLE,1)', 9)} AS score FROM rw) SELECT graph_id, arg_min(path_id, (-score, path_id)) AS path_id, {RND('max(score)')} AS score FROM sc GROUP BY 1"))
def best_path_q(spark, sf):
    r = pt.path_reward(_steps(spark, sf)).withColumn("graph_id", F.split("path_id", "_")[0])
    return pt.select_best_path(r).select("graph_id", "path_id", rnd(F.col("score")).alias("score"))


@query("a29_path_to_graph", with_views("SELECT path_id, label, min(pos) AS path_order, arg_min(layer, (pos, side)) AS layer FROM (SELECT path_id, pos, 0 AS side, subject AS label, subject_layer AS layer FROM steps UNION ALL SELECT path_id, pos, 1, object, object_layer FROM steps) GROUP BY ALL"))
def path_graph_q(spark, sf):
    return pt.path_to_graph(_steps(spark, sf))[0]


@query("g26_thread_quality", with_views(PREV + f""", c AS (SELECT path_id, count(*) AS n, count(*) FILTER (subject=po OR object=ps OR subject=ps OR object=po) AS t FROM pv GROUP BY 1),
 e AS (SELECT DISTINCT path_id, label FROM (SELECT path_id, subject AS label FROM steps UNION ALL SELECT path_id, object FROM steps)), s AS (SELECT path_id, count(*) AS k, bool_or(label='signup') AS hs, bool_or(label='error') AS he FROM e GROUP BY 1),
 q AS (SELECT path_id, CASE WHEN n>1 THEN {RND('100.0::DOUBLE*t/(n-1)', 0)} ELSE 100.0 END AS coherence, {RND('100.0::DOUBLE*(hs::INT+he::INT)/2', 0)} AS coverage, 100.0::DOUBLE*(n-k)/n AS red FROM c JOIN s USING (path_id)),
 z AS (SELECT *, CASE WHEN red<0 OR red>95 THEN 0.0 ELSE {RND('red', 0)} END AS simplification FROM q)
 SELECT path_id, coherence, coverage, simplification, least(10.0, greatest(0.0, {RND("(coherence*0.4::DOUBLE+coverage*0.4::DOUBLE+CASE WHEN simplification>0 AND simplification<95 THEN simplification*0.2::DOUBLE ELSE 0 END)/10", 0)})) AS overall FROM z"""))
def thread_q(spark, sf):
    s = materialize(_steps(spark, sf))
    sizes = s.groupBy("path_id").agg(F.count(F.lit(1)).alias("graph_nodes"))
    users = s.select("path_id").distinct().select("path_id", F.explode(F.array(F.lit("signup"), F.lit("error"))).alias("label"))
    return pt.thread_quality(s, sizes, users).select("path_id", "coherence", "coverage", "simplification", "overall")


@query("g27_choose_subgraph", with_views(SPLIT + """SELECT model, arg_min(subgraph, list_position(pr, subgraph)) AS subgraph FROM inv, (VALUES ('gnn', ['gnn','combined_subgraph','llm']), ('mcts', ['combined_subgraph','mcts_reasoning_path','traversal']), ('default', ['combined_subgraph'])) m(model, pr)
 WHERE node_count>0 AND list_contains(pr, subgraph) GROUP BY model"""))
def choose_q(spark, sf):
    inv = materialize(g.subgraph_inventory(*g.split_by_origin(*_graph(spark, sf))))
    out = None
    for model, priority in lex.SUBGRAPH_PRIORITY.items():
        one = pt.choose_subgraph(inv, priority).select(F.lit(model).alias("model"), "subgraph")
        out = one if out is None else out.unionByName(one)
    return out


@query("g27_score_subgraphs", with_views(SPLIT + """SELECT arg_max(subgraph, s) AS subgraph, max(s) AS score FROM (SELECT subgraph, node_count+link_count+CASE subgraph WHEN 'gnn' THEN 100 WHEN 'mcts_reasoning_path' THEN 90 WHEN 'combined_subgraph' THEN 80 WHEN 'traversal' THEN 70 WHEN 'llm' THEN 60 ELSE 0 END AS s FROM inv WHERE node_count>0)"""))
def score_sub_q(spark, sf):
    inv = g.subgraph_inventory(*g.split_by_origin(*_graph(spark, sf)))
    return pt.score_subgraphs(inv).select("subgraph", "score")


START = "CASE object_layer WHEN 'system' THEN 2.0 WHEN 'data' THEN 1.5 WHEN 'business' THEN 1.0 WHEN 'technology' THEN 0.5 ELSE 0 END"


@query("g18_start_steps", with_views(f"""WITH t AS (SELECT *, (1.0+{START}+{_kw(lex.TWO_LEVEL_QUALITY)})::DOUBLE AS sc FROM steps),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY sc DESC, pos) AS rn FROM t WHERE subject='signup') WHERE rn<=15),
 thin AS (SELECT path_id FROM (SELECT DISTINCT path_id FROM steps) p WHERE (SELECT count(*) FROM u WHERE u.path_id=p.path_id)<10),
 m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path_id, object_layer ORDER BY pos) AS rn FROM t WHERE object_layer<>'unknown') WHERE rn<=CASE WHEN object_layer IN ('business','system') THEN 3 ELSE 2 END AND path_id IN (SELECT path_id FROM thin)),
 a AS (SELECT 0 AS o, * FROM u UNION ALL SELECT 1, * FROM m) SELECT path_id AS graph_id, subject, object, arg_min(pos, (o, pos)) AS pos, arg_min(sc, (o, pos)) AS start_score FROM a GROUP BY 1,2,3"""))
def start_q(spark, sf):
    return pt.start_steps(_triples(spark, sf)).select("graph_id", "subject", "object", F.col("seq").cast("long").alias("pos"), "start_score")


@query("g18_next_steps", with_views("""WITH st AS (SELECT path_id, subject AS ls, object AS lo, pos AS p FROM steps s WHERE pos=(SELECT min(pos) FROM steps x WHERE x.path_id=s.path_id)),
 c AS (SELECT s.path_id, s.pos, s.subject, s.object, 0 AS kind, row_number() OVER (PARTITION BY s.path_id ORDER BY s.pos) AS rn FROM steps s JOIN st ON st.path_id=s.path_id WHERE s.subject=lo),
 x AS (SELECT s.path_id, s.pos, s.subject, s.object, 1 AS kind, row_number() OVER (PARTITION BY s.path_id ORDER BY s.pos) AS rn FROM steps s JOIN st ON st.path_id=s.path_id WHERE s.subject IN (ls,lo) OR s.object IN (ls,lo)),
 b AS (SELECT path_id, subject, object, min((kind,pos)) AS k FROM (SELECT * FROM c WHERE rn<=20 UNION ALL SELECT * FROM x WHERE rn<=15) GROUP BY ALL)
 SELECT b.path_id AS graph_id, subject, object FROM b JOIN st USING (path_id) WHERE NOT (subject=lo AND object=ls)"""))
def next_q(spark, sf):
    t = materialize(_triples(spark, sf))
    first = first_by(t, ["graph_id"], ["seq"]).join(pt._empty_states(t), "graph_id")
    return pt.next_steps(pt._extend(first), t).select("graph_id", "subject", "object")


@query("g19_step_priority", with_views(PREV + f"""SELECT path_id, pos, (1.0+{_case(lex.PROGRESSION_MATRIX, 'pl', 'object_layer')}+{_kw(lex.ACTION_QUALITY)}+CASE WHEN object_layer='unknown' THEN 0 WHEN object_layer=pl THEN 1 ELSE 2 END)::DOUBLE AS priority FROM pv WHERE pl IS NOT NULL"""))
def priority_q(spark, sf):
    s = pt.with_previous(_steps(spark, sf)).filter(F.col("p_layer").isNotNull())
    counts = {x: F.when(F.col("p_layer") == x, 1).otherwise(0) for x in pt.LAYERS}
    return s.select("path_id", "pos", pt.step_priority(F.col("predicate"), F.col("object_layer"), F.col("p_layer"), counts).alias("priority"))


@query("g24_fallback_path", with_views("SELECT path_id AS graph_id, rn::INTEGER AS pos, subject, object FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY CASE WHEN subject='signup' THEN 0 ELSE 1 END, pos) AS rn FROM steps) WHERE rn<=5"))
def fallback_q(spark, sf):
    return pt.fallback_path(_triples(spark, sf)).select("graph_id", "pos", "subject", "object")


@query("j8_bridges", with_views(f"""WITH st AS (SELECT path_id, min(pos) AS p0 FROM steps GROUP BY 1), pa AS (SELECT s.* FROM steps s JOIN st USING (path_id) WHERE s.pos<p0+3),
 e AS (SELECT DISTINCT path_id, x FROM (SELECT path_id, subject AS x FROM pa UNION ALL SELECT path_id, object FROM pa)),
 b AS (SELECT s.path_id, s.pos, ({_kw(lex.TWO_LEVEL_QUALITY)}+{_case(lex.BRIDGE_VALUES, 'subject_layer', 'object_layer')})::DOUBLE AS score FROM steps s WHERE EXISTS (SELECT 1 FROM e WHERE e.path_id=s.path_id AND e.x=s.subject) AND EXISTS (SELECT 1 FROM e WHERE e.path_id=s.path_id AND e.x=s.object)
  AND NOT EXISTS (SELECT 1 FROM pa WHERE pa.path_id=s.path_id AND pa.subject=s.subject AND pa.object=s.object))
 SELECT path_id AS graph_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY score DESC, pos) AS rn FROM b) WHERE rn<=5"""))
def bridges_q(spark, sf):
    s = materialize(_steps(spark, sf))
    start = s.groupBy("path_id").agg(F.min("pos").alias("p0"))
    head = s.join(start, "path_id").filter(F.col("pos") < F.col("p0") + 3).drop("p0")
    t = _triples(spark, sf)
    return pt.bridges(head, t).select("graph_id", F.col("seq").cast("long").alias("pos"), "score")


@query("g20_beam_search")
def beam_q(spark, sf):
    return pt.beam_search(_triples(spark, sf)).select("graph_id", "path_key", "n", "reward", "score")


@query("g23_post_process_path")
def post_q(spark, sf):
    return pt.post_process_path(materialize(_steps(spark, sf).drop("subject_is_user", "object_is_user")), _triples(spark, sf))


@query("g25_layered_path")
def layered_q(spark, sf):
    return pt.layered_path(_triples(spark, sf), depth=3).select("graph_id", "path_key", "n", "reward", "score")
