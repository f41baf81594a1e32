"""Ordered paths through layered graphs: features, reward, next steps, beam search.

Step tables: path_id, pos (dense), subject, predicate, object, subject_layer, object_layer.
Triple tables for search: graph_id, seq, subject, predicate, object, subject_layer,
object_layer, subject_is_user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.functions import lexicons as lex
from threadgraph.functions.text import keyword_value, layer_by_keyword, pair_value
from threadgraph.operators.common import first_by, rnd, top_k
from threadgraph.session import materialize

LAYERS = ["business", "system", "data", "technology"]


def entity_types(ends: DataFrame, layers=LAYERS) -> DataFrame:
    """Layer per label; on records that carry a known layer the last one wins."""
    ok = ends.filter(F.col("domain_type").isin(*layers))
    return ok.groupBy("graph_id", "label").agg(F.max_by("domain_type", F.struct("seq", "side")).alias("layer"))


def relation_quality(predicate: Column) -> Column:
    return keyword_value(predicate, lex.RELATION_QUALITY)


def resolve_entity_types(nodes: DataFrame, groups=lex.LAYER_KEYWORDS_LONG) -> DataFrame:
    """Layer per label: the node's own layer, else the prototype layer (``layer_found``, if
    present), else the keyword layer; labels without one of the four layers are left out."""
    known = lambda c: F.when(F.lower(c).isin(*LAYERS), F.lower(c))
    options = [known(c) for c in ("domain_type", "layer_found") if c in nodes.columns]
    layer = F.coalesce(*options, layer_by_keyword(F.col("label"), groups))
    rows = nodes.select("graph_id", "label", "id", layer.alias("layer")).filter(F.col("layer").isin(*LAYERS))
    return first_by(rows, ["graph_id", "label"], ["id"]).select("graph_id", "label", "layer")


# --- features and reward -------------------------------------------------------------------

def with_previous(steps: DataFrame) -> DataFrame:
    """Each step next to its predecessor. The join key (path, position) is unique, so one very
    long path spreads over all tasks."""
    prev = steps.select("path_id", (F.col("pos") + 1).alias("pos"), F.col("subject").alias("p_subject"), F.col("object").alias("p_object"),
                        F.col("object_layer").alias("p_layer"))
    return steps.join(prev, ["path_id", "pos"], "left")


def pair_features(subject, obj, s_layer, o_layer, p_subject, p_object, p_layer) -> dict[str, Column]:
    """0/1 and score columns of a step given its predecessor; null predecessor gives zeros."""
    has = p_object.isNotNull()
    shares = (subject == p_subject) | (subject == p_object) | (obj == p_subject) | (obj == p_object)
    known = has & (p_layer != "unknown") & (o_layer != "unknown")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return {
        "direct": flag(has & (subject == p_object)), "semantic": flag(has & shares), "known": flag(known),
        "progress": F.when(known, pair_value(p_layer, o_layer, lex.PROGRESSION_VALUES)).otherwise(0.0),
        "switch": flag(has & (p_layer != s_layer) & (p_layer != "unknown") & (s_layer != "unknown")),
        "run_start": flag(~has | (p_layer != o_layer)),
    }


def path_features(steps: DataFrame) -> DataFrame:
    """One row of counters per path, in one aggregation over the paired steps."""
    s = with_previous(steps)
    c = F.col
    s = s.withColumns(pair_features(c("subject"), c("object"), c("subject_layer"), c("object_layer"), c("p_subject"), c("p_object"), c("p_layer")))
    if "subject_is_user" not in steps.columns:
        s = s.withColumn("subject_is_user", F.lit(None).cast("boolean")).withColumn("object_is_user", F.lit(None).cast("boolean"))
    layer = lambda x: F.sum(F.when(F.col("subject_layer") == x, 1).otherwise(0) + F.when(F.col("object_layer") == x, 1).otherwise(0))
    first = F.col("p_object").isNull()
    agg = s.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("direct").alias("direct"), F.sum("semantic").alias("semantic"), F.sum("known").alias("known"),
        F.sum("progress").alias("progress"), F.sum("switch").alias("switches"), F.sum("run_start").alias("runs"),
        F.sum(relation_quality(F.col("predicate"))).alias("quality"), *[layer(x).alias(f"n_{x}") for x in LAYERS],
        F.sum(F.when(F.col("object_layer") == "technology", 1).otherwise(0)).alias("tech"),
        F.sum(F.when(F.col("subject_is_user") | F.col("object_is_user"), 1).otherwise(0)).alias("user_steps"),
        F.max(F.when(first & F.col("subject_is_user"), 1).otherwise(0)).alias("user_start"),
        F.max(F.when(F.col("subject_is_user").isNotNull(), 1).otherwise(0)).alias("has_users"))
    # distinct entities: one row per (path, entity) first, then a count
    ents = steps.select("path_id", F.explode(F.array("subject", "object")).alias("e")).distinct().groupBy("path_id").agg(F.count(F.lit(1)).alias("entities"))
    return agg.join(ents, "path_id")


def coherence(n: Column, direct: Column, semantic: Column) -> Column:
    return F.when(n < 2, 1.0).otherwise(F.greatest(direct / (n - 1), semantic / (n - 1) * 0.7))


def progression(n: Column, progress: Column, known: Column) -> Column:
    return F.when(n < 2, 0.0).otherwise(progress / F.greatest(known, F.lit(1)))


def _steps_of(col: Column, *levels: tuple[float, float]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for limit, value in levels:
        out = out.when(col >= limit, F.lit(value))
    return out.otherwise(F.lit(0.0))


def reward(c: dict[str, Column], target: Column | None = None, older_bonus: bool = False) -> Column:
    """Path reward from the counters of :func:`path_features` (or of a search state)."""
    n = c["n"]
    length = F.least(n / 10.0, F.lit(1.0)) + F.when(n > 10, (n - 10) * 0.05).otherwise(0.0) + _steps_of(n, (15, 0.3), (12, 0.2), (8, 0.1))
    layers = sum((F.when(c[f"n_{x}"] > 0, 1).otherwise(0) for x in LAYERS), F.lit(0))
    prog = progression(n, c["progress"], c["known"]) + F.when(layers >= 3, 0.3).otherwise(0.0)
    coh = coherence(n, c["direct"], c["semantic"]) + F.when(n > 1, c["direct"] / (n - 1) * 0.4).otherwise(0.0)
    align = F.when(c["has_users"] == 0, 1.0).otherwise(F.least(c["user_steps"] / n + F.when(c["user_start"] == 1, 0.3).otherwise(0.0), F.lit(1.0)))
    if older_bonus:
        bonus = (F.when(c["last_layer"] == "technology", 0.1).otherwise(0.0) if "last_layer" in c else F.lit(0.0)) + _steps_of(c["runs"], (3, 0.1)) + _steps_of(n, (15, 0.1), (10, 0.05))
    else:
        bonus = (_steps_of(c["entities"], (20, 0.15), (15, 0.10), (10, 0.05)) + _steps_of(c["tech"], (5, 0.12), (3, 0.08), (1, 0.04))
                 + _steps_of(n, (20, 0.20), (15, 0.15), (12, 0.10)) + _steps_of(c["switches"], (5, 0.10), (3, 0.06)))
    total = 0.30 * length + 0.25 * prog + 0.20 * coh + 0.10 * F.least(layers / 4.0, F.lit(1.0)) + 0.08 * c["quality"] / n + 0.05 * align + bonus
    if target is not None:
        total = total + 0.02 * F.least(target / 3.0, F.lit(1.0))
    return F.when(n > 0, F.greatest(F.lit(0.0), total)).otherwise(0.0)


def _cols(df: DataFrame) -> dict[str, Column]:
    return {x: F.col(x) for x in df.columns}


def path_reward(steps: DataFrame, older_bonus: bool = False) -> DataFrame:
    f = path_features(steps)
    if older_bonus:
        last = steps.groupBy("path_id").agg(F.max_by("object_layer", "pos").alias("last_layer"))
        f = f.join(last, "path_id")
    return f.withColumn("reward", reward(_cols(f), older_bonus=older_bonus))


def select_best_path(scored: DataFrame, key: str = "graph_id", path: str = "path_id") -> DataFrame:
    """Highest reward plus 0.2 min(n / 15, 1) per graph; ties go to the smaller path id."""
    s = scored.withColumn("score", rnd(F.col("reward") + 0.2 * F.least(F.col("n") / 15.0, F.lit(1.0)), 9)).withColumn("_neg", -F.col("score"))
    return first_by(s, [key], ["_neg", path]).drop("_neg")


def link_coherence_percent(steps: DataFrame) -> DataFrame:
    """Percent of links that touch the previous link in any of four ways; 100 for one link."""
    s = with_previous(steps)
    touch = ((F.col("subject") == F.col("p_object")) | (F.col("object") == F.col("p_subject")) | (F.col("subject") == F.col("p_subject")) | (F.col("object") == F.col("p_object")))
    a = s.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(touch, 1).otherwise(0)).alias("t"))
    return a.select("path_id", F.when(F.col("n") > 1, rnd(100.0 * F.col("t") / (F.col("n") - 1), 0)).otherwise(100.0).alias("coherence"))


def thread_quality(steps: DataFrame, graph_sizes: DataFrame, user_entities: DataFrame) -> DataFrame:
    """Coherence, coverage of user entities, simplification and the overall 0-10 score.

    ``graph_sizes``: path_id, graph_nodes. ``user_entities``: path_id, label.
    """
    ents = steps.select("path_id", F.explode(F.array("subject", "object")).alias("label")).distinct()
    size = ents.groupBy("path_id").agg(F.count(F.lit(1)).alias("path_nodes"))
    users = user_entities.select("path_id", "label").distinct()
    cov = users.join(ents.withColumn("hit", F.lit(1)), ["path_id", "label"], "left").groupBy("path_id").agg(
        rnd(100.0 * F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 0).alias("coverage"))
    j = link_coherence_percent(steps).join(size, "path_id").join(graph_sizes, "path_id").join(cov, "path_id", "left")
    red = 100.0 * (F.col("graph_nodes") - F.col("path_nodes")) / F.col("graph_nodes")
    simp = F.when(red < 0, 0.0).when(red > 95, 0.0).otherwise(rnd(red, 0))
    j = j.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("simplification", simp)
    j = j.withColumn("simplification_label", F.when(red > 95, "Low").otherwise(F.concat(F.col("simplification").cast("int").cast("string"), F.lit("%"))))
    used = F.when((F.col("simplification") > 0) & (F.col("simplification") < 95), F.col("simplification") * 0.2).otherwise(0.0)
    overall = rnd((F.col("coherence") * 0.4 + F.col("coverage") * 0.4 + used) / 10.0, 0)
    return j.withColumn("overall", F.least(F.lit(10.0), F.greatest(F.lit(0.0), overall)))


def path_to_graph(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node per distinct label with its first position and layer; link per step."""
    ends = steps.select("path_id", F.explode(F.array(
        F.struct(F.col("pos").alias("o"), F.lit(0).alias("side"), F.col("subject").alias("label"), F.col("subject_layer").alias("layer")),
        F.struct(F.col("pos").alias("o"), F.lit(1).alias("side"), F.col("object").alias("label"), F.col("object_layer").alias("layer")))).alias("e"))
    nodes = ends.groupBy("path_id", F.col("e.label").alias("label")).agg(F.min("e.o").alias("path_order"), F.min_by("e.layer", F.struct("e.o", "e.side")).alias("layer"))
    links = steps.select("path_id", F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"), F.col("pos").alias("path_order"))
    return nodes, links


def dedup_path(steps: DataFrame) -> DataFrame:
    return first_by(steps, ["path_id", "subject", "object"], ["pos"])


# --- bridges and post-processing -----------------------------------------------------------

def bridge_score(predicate: Column, s_layer: Column, o_layer: Column) -> Column:
    return keyword_value(predicate, lex.TWO_LEVEL_QUALITY) + pair_value(s_layer, o_layer, lex.BRIDGE_VALUES)


def bridges(steps: DataFrame, triples: DataFrame, k: int = 5, best_first: bool = True) -> DataFrame:
    """Triples between path entities that are not path steps, the k best (or lowest) scores."""
    # one row per path entity or step: merged, as their compressed files look small enough to broadcast
    ents = steps.select(F.col("path_id").alias("graph_id"), F.explode(F.array("subject", "object")).alias("e")).distinct().hint("merge")
    used = steps.select(F.col("path_id").alias("graph_id"), "subject", "object").distinct().hint("merge")
    t = triples.join(ents.withColumnRenamed("e", "subject"), ["graph_id", "subject"], "left_semi")
    t = t.join(ents.withColumnRenamed("e", "object"), ["graph_id", "object"], "left_semi").join(used, ["graph_id", "subject", "object"], "left_anti")
    t = t.withColumn("score", bridge_score(F.col("predicate"), F.col("subject_layer"), F.col("object_layer")))
    order = F.col("score").desc() if best_first else F.col("score")
    return top_k(t, ["graph_id"], [order, F.col("seq")], k, "rank")


def post_process_path(steps: DataFrame, triples: DataFrame) -> DataFrame:
    """Drop repeated pairs, keep the largest connected piece, add bridges at the end."""
    from threadgraph.operators.connectivity import path_components

    once = materialize(dedup_path(steps))
    comps = path_components(once).select(F.col("graph_id").alias("path_id"), F.col("id").alias("subject"), "component")
    marked = once.join(comps.hint("merge"), ["path_id", "subject"])
    size = marked.groupBy("path_id", "component").agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("p"))
    best = size.groupBy("path_id").agg(F.min_by("component", F.struct(-F.col("k"), F.col("p"))).alias("component"))
    kept = materialize(marked.join(best.hint("merge"), ["path_id", "component"], "left_semi").select(*once.columns))
    length = kept.groupBy("path_id").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    extra = bridges(kept, triples).withColumnRenamed("graph_id", "path_id").join(length.filter("n >= 2").hint("merge"), "path_id")
    extra = extra.withColumn("pos", F.col("last") + F.col("rank"))
    return kept.select(*[F.col(c) for c in ("path_id", "pos", "subject", "predicate", "object", "subject_layer", "object_layer")]).unionByName(
        extra.select("path_id", F.col("pos").cast("long").alias("pos"), "subject", "predicate", "object", "subject_layer", "object_layer"))


def fallback_path(triples: DataFrame, n: int = 5) -> DataFrame:
    """First triples of user subjects, filled up with the first others."""
    return top_k(triples, ["graph_id"], [F.when(F.col("subject_is_user"), 0).otherwise(1), F.col("seq")], n, "pos")


# --- search --------------------------------------------------------------------------------

def start_priority(predicate: Column, o_layer: Column) -> Column:
    bonus = F.when(F.lit(False), F.lit(0.0))
    for layer, value in lex.START_LAYER_BONUS.items():
        bonus = bonus.when(o_layer == layer, F.lit(value))
    return 1.0 + bonus.otherwise(0.0) + keyword_value(predicate, lex.TWO_LEVEL_QUALITY)


def step_priority(predicate: Column, o_layer: Column, last_layer: Column, layer_counts: dict[str, Column], similarity: Column | None = None) -> Column:
    """1 + layer progression + predicate bonus + bonus for rare layers + half the similarity."""
    rare = F.when(F.lit(False), F.lit(0.0))
    for x, cnt in layer_counts.items():
        rare = rare.when((o_layer == x) & (cnt == 0), F.lit(2.0)).when((o_layer == x) & (cnt < 2), F.lit(1.0))
    out = 1.0 + pair_value(last_layer, o_layer, lex.PROGRESSION_MATRIX) + keyword_value(predicate, lex.ACTION_QUALITY) + rare.otherwise(0.0)
    return out if similarity is None else out + 0.5 * F.coalesce(similarity, F.lit(0.0))


def start_steps(triples: DataFrame, limit: int = 15, few: int = 10) -> DataFrame:
    """Opening triples: the best of user subjects, plus a layer mix where they are few."""
    t = triples.withColumn("start_score", start_priority(F.col("predicate"), F.col("object_layer")))
    user = top_k(t.filter("subject_is_user"), ["graph_id"], [F.col("start_score").desc(), F.col("seq")], limit)
    counts = user.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    thin = triples.select("graph_id").distinct().join(counts.filter(F.col("_n") >= few), "graph_id", "left_anti")
    quota = F.when(F.col("object_layer").isin("business", "system"), 3).otherwise(2)
    mix = top_k(t.filter(F.col("object_layer").isin(*LAYERS)), ["graph_id", "object_layer"], [F.col("seq")], 3, "_rn").filter(F.col("_rn") <= quota).drop("_rn")
    mix = mix.join(thin, "graph_id", "left_semi").select(*t.columns)
    both = user.withColumn("_o", F.lit(0)).unionByName(mix.withColumn("_o", F.lit(1)))
    return first_by(both, ["graph_id", "subject", "object"], ["_o", "seq"]).drop("_o")


STATE_COUNTERS = ["n", "direct", "semantic", "known", "switches", "runs", *[f"n_{x}" for x in LAYERS], "tech", "user_steps", "user_start", "has_users"]


def _extend(actions: DataFrame) -> DataFrame:
    """State plus action: all counters move on by row-local arithmetic."""
    c = F.col
    f = pair_features(c("subject"), c("object"), c("subject_layer"), c("object_layer"), c("last_subject"), c("last_object"), c("last_layer"))
    layer = lambda x: c(f"n_{x}") + F.when(c("subject_layer") == x, 1).otherwise(0) + F.when(c("object_layer") == x, 1).otherwise(0)
    ents = F.array_distinct(F.concat("entities", F.array("subject", "object")))
    step = F.struct("subject", "predicate", "object", "subject_layer", "object_layer")
    return actions.select(
        "graph_id", F.concat_ws(">", F.nullif("path_key", F.lit("")), c("seq").cast("string")).alias("path_key"),
        F.concat("steps", F.array(step)).alias("steps"), ents.alias("entities"),
        (c("n") + 1).alias("n"), (c("direct") + f["direct"]).alias("direct"),
        (c("semantic") + f["semantic"]).alias("semantic"), (c("known") + f["known"]).alias("known"), (c("progress") + f["progress"]).alias("progress"),
        (c("switches") + f["switch"]).alias("switches"), (c("runs") + f["run_start"]).alias("runs"), (c("quality") + relation_quality(c("predicate"))).alias("quality"),
        *[layer(x).alias(f"n_{x}") for x in LAYERS], (c("tech") + F.when(c("object_layer") == "technology", 1).otherwise(0)).alias("tech"),
        (c("user_steps") + F.when(c("subject_is_user") | c("object_is_user"), 1).otherwise(0)).alias("user_steps"),
        F.when(c("n") == 0, F.when(c("subject_is_user"), 1).otherwise(0)).otherwise(c("user_start")).alias("user_start"),
        F.lit(1).alias("has_users"), c("subject").alias("last_subject"), c("object").alias("last_object"), c("object_layer").alias("last_layer"),
        c("last_object").alias("second_object"))


def _empty_states(graphs: DataFrame) -> DataFrame:
    step = "struct<subject:string,predicate:string,object:string,subject_layer:string,object_layer:string>"
    text = lambda *names: {x: F.lit(None).cast("string") for x in names}
    return graphs.select("graph_id").distinct().withColumns({
        "path_key": F.lit(""), "steps": F.array().cast(f"array<{step}>"), "entities": F.array().cast("array<string>"),
        **{x: F.lit(0) for x in STATE_COUNTERS}, "progress": F.lit(0.0), "quality": F.lit(0.0), **text("last_subject", "last_object", "last_layer", "second_object")})


def next_steps(states: DataFrame, triples: DataFrame, cont: int = 20, expand: int = 15, short: int = 8, cap: int = 30) -> DataFrame:
    """Actions of every state: follow-ups of the last two objects, then (on short paths)
    triples touching the path; repeats, direct returns and objects met three times are out.

    Both sources take triples in ``seq`` order, so the first ``cont`` triples per entity and
    side always suffice; hub entities are cut to those before the join.
    """
    side = lambda e, is_subject: F.struct(F.col(e).alias("entity"), F.lit(is_subject).alias("out"))
    ends = triples.select("*", F.explode(F.array(side("subject", True), side("object", False))).alias("_e")).select(*triples.columns, "_e.entity", "_e.out")
    ends = top_k(ends, ["graph_id", "entity", "out"], [F.col("seq")], max(cont, expand))
    # only keys and flags of a state travel through the limits; its arrays join back once
    front = states.select("graph_id", "path_key", "n", "last_object", "second_object", F.explode("entities").alias("entity"))
    near = (F.col("entity") == F.col("last_object")) | F.coalesce(F.col("entity") == F.col("second_object"), F.lit(False))
    front = front.select("graph_id", "path_key", "n", "entity", near.alias("near")).filter(F.col("near") | (F.col("n") < short))
    j = front.join(ends, ["graph_id", "entity"]).withColumn("kind", F.when(F.col("near") & F.col("out"), 0).otherwise(1))
    j = j.filter((F.col("kind") == 0) | (F.col("n") < short))
    once = first_by(j.drop("entity", "near", "out"), ["graph_id", "path_key", "seq"], ["kind"])
    # follow-ups also touch the path, so they count in both lists, each with its own limit
    a = top_k(once.filter("kind = 0"), ["graph_id", "path_key"], [F.col("seq")], cont)
    b = top_k(once.filter(F.col("n") < short), ["graph_id", "path_key"], [F.col("seq")], expand).withColumn("kind", F.lit(1))
    both = first_by(a.unionByName(b), ["graph_id", "path_key", "subject", "object"], ["kind", "seq"]).drop("n")
    full = both.join(states, ["graph_id", "path_key"])
    back = (F.col("subject") == F.col("last_object")) & (F.col("object") == F.col("last_subject"))
    met = F.size(F.filter("steps", lambda s: (s["subject"] == F.col("object")) | (s["object"] == F.col("object"))))
    return top_k(full.filter(~back & (met < 3)), ["graph_id", "path_key"], [F.col("kind"), F.col("seq")], cap)


def with_reward(states: DataFrame, target: str | None = None) -> DataFrame:
    c = _cols(states)
    return states.withColumn("entity_count", F.size("entities")).withColumn(
        "reward", rnd(reward({**c, "entities": F.size("entities")}, target=c[f"n_{target}"] if target else None), 9))


def beam_search(triples: DataFrame, width: int = 3, depth: int = 15, per_state: int = 5, keep: int = 2, target: str | None = None,
                states: DataFrame | None = None) -> DataFrame:
    """Best path per graph; every graph advances one step per round in the same job.

    Per state the five actions of highest priority are tried, the two of highest reward
    survive, and the best ``width`` states per graph go on. Returns the best state seen.
    """
    triples = materialize(triples if "object_is_user" in triples.columns else triples.withColumn("object_is_user", F.lit(False)))
    counts = {x: F.col(f"n_{x}") for x in LAYERS}
    best = None
    cur = states
    for level in range(depth):
        if cur is None:
            acts = start_steps(triples).drop("start_score").join(_empty_states(triples), "graph_id")
        else:
            acts = next_steps(cur, triples, cap=10)
        prio = step_priority(F.col("predicate"), F.col("object_layer"), F.col("last_layer"), counts)
        acts = top_k(acts.withColumn("_p", prio), ["graph_id", "path_key"], [F.col("_p").desc(), F.col("seq")], per_state)
        grown = with_reward(_extend(acts), target).withColumn("_parent", F.regexp_replace("path_key", ">?[^>]*$", ""))
        grown = top_k(grown, ["graph_id", "_parent"], [F.col("reward").desc(), F.col("path_key")], keep)
        cur = materialize(top_k(grown, ["graph_id"], [F.col("reward").desc(), F.col("path_key")], width).drop("_parent", "entity_count"))
        best = cur if best is None else best.unionByName(cur)
        if cur.limit(1).count() == 0:
            break
        cur = cur.drop("reward")
    return select_best_path(materialize(best), path="path_key")


def state_steps(best: DataFrame) -> DataFrame:
    """Chosen states as a step table."""
    s = best.select(F.col("graph_id").alias("path_id"), F.posexplode("steps").alias("pos", "s"))
    return s.select("path_id", (F.col("pos") + 1).cast("long").alias("pos"), "s.*")


def layered_path(triples: DataFrame, depth: int = 4, width: int = 3) -> DataFrame:
    """Business, system, data, technology in turn: the beam goes on from the best path so far
    with the target term of the next layer. The business round is skipped for graphs whose
    opening already covers it, which the target term makes a no-op."""
    best = None
    for layer in LAYERS:
        nxt = beam_search(triples, width, depth, target=layer, states=None if best is None else best.drop("reward", "score"))
        best = nxt if best is None else materialize(select_best_path(best.drop("score").unionByName(nxt.drop("score").select(*best.drop("score").columns)), path="path_key"))
    return best


def choose_path(triples: DataFrame, depth: int = 15, width: int = 3, stage_depth: int = 4, fallback: int = 5) -> DataFrame:
    """Step table of one path per graph: the best of the staged path and the beam, without repeats, in one piece and
    with bridges; graphs in which neither finds a path get their first triples.

    ``triples`` as for :func:`beam_search`, with ``subject_is_user``. Runs its rounds while the plan is built.
    """
    triples = materialize(triples)
    beam, staged = beam_search(triples, width, depth), layered_path(triples, stage_depth, width)
    state = [c for c in beam.columns if c != "score"]
    best = materialize(select_best_path(beam.select(state).unionByName(staged.select(state)), path="path_key"))
    found = post_process_path(materialize(state_steps(best)), triples)
    missing = triples.join(best.select("graph_id"), "graph_id", "left_anti")
    rest = fallback_path(missing, fallback).select(F.col("graph_id").alias("path_id"), F.col("pos").cast("long").alias("pos"), *found.columns[2:])
    return found.unionByName(rest)


def choose_subgraph(inventory: DataFrame, priority: list[str]) -> DataFrame:
    """First non-empty subgraph of the priority list per graph."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("subgraph"))
    ok = inventory.filter((F.col("node_count") > 0) & (rank > 0)).withColumn("_r", rank)
    return first_by(ok, ["graph_id"], ["_r"]).drop("_r")


# fixed values
SUBGRAPH_BONUS = {"gnn": 100, "mcts_reasoning_path": 90, "combined_subgraph": 80, "traversal": 70, "llm": 60}


def score_subgraphs(inventory: DataFrame, bonus: dict[str, int] = SUBGRAPH_BONUS) -> DataFrame:
    """nodes + links + type bonus, best subgraph per graph."""
    b = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in bonus.items() for x in kv]), F.col("subgraph")), F.lit(0))
    s = inventory.withColumn("score", F.col("node_count") + F.col("link_count") + b).withColumn("_n", -F.col("score"))
    return first_by(s.filter("node_count > 0"), ["graph_id"], ["_n", "subgraph"]).drop("_n")
