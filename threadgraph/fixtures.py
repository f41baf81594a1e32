"""Views that lay the driver tables out as graphs, paths, texts and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgraph.operators.common import bucketed_index, prefix_lag


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _pad(col: str):
    return F.lpad(F.col(col).cast("string"), 13, "0")


def _triple(df: DataFrame, seq, sid, slabel, predicate, oid, olabel, origin, layer) -> DataFrame:
    return df.select(
        seq.alias("seq"), sid.alias("subject_id"), slabel.alias("subject_label"), F.lit(predicate).alias("predicate"),
        oid.alias("object_id"), olabel.alias("object_label"), F.lit(origin).alias("origin"),
        F.lit(layer).alias("domain_type"),
    )


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """One global graph ``all`` over customers, orders, parts, suppliers, nations and regions."""
    cust = table(spark, sf, "customer")
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    supp = table(spark, sf, "supplier")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    order_label = lambda c: F.concat(F.lit("Order "), F.col(c).cast("string"))

    places = _triple(
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey")),
        F.concat(F.lit("1"), _pad("o_orderkey")), _id("c", "o_custkey"), F.col("c_name"), "places",
        _id("o", "o_orderkey"), order_label("o_orderkey"), "user", "business")
    # dealt by part once: what is made distinct then meets its part without being moved again
    of_part = lambda *cols: lines.select(*cols).filter(F.col("l_partkey").isNotNull()).repartition("l_partkey").distinct()
    contains = _triple(
        of_part("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")),
        F.concat(F.lit("2"), _pad("l_orderkey"), _pad("l_partkey")), _id("o", "l_orderkey"), order_label("l_orderkey"),
        "contains", _id("p", "l_partkey"), F.col("p_name"), "domain", "system")
    uses = _triple(
        of_part("l_partkey", "l_suppkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")),
        F.concat(F.lit("3"), _pad("l_partkey"), _pad("l_suppkey")), _id("p", "l_partkey"), F.col("p_name"), "uses",
        _id("s", "l_suppkey"), F.col("s_name"), "domain", "data")
    supp_nation = _triple(
        supp.join(nation, F.col("s_nationkey") == F.col("n_nationkey")),
        F.concat(F.lit("4"), _pad("s_suppkey")), _id("s", "s_suppkey"), F.col("s_name"), "is_part_of",
        _id("n", "n_nationkey"), F.col("n_name"), "domain", "technology")
    cust_nation = _triple(
        cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
        F.concat(F.lit("5"), _pad("c_custkey")), _id("c", "c_custkey"), F.col("c_name"), "is_part_of",
        _id("n", "n_nationkey"), F.col("n_name"), "connection", "business")
    nation_region = _triple(
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")),
        F.concat(F.lit("6"), _pad("n_nationkey")), _id("n", "n_nationkey"), F.col("n_name"), "belongs_to",
        _id("r", "r_regionkey"), F.col("r_name"), "domain", "technology")
    out = places
    for part_df in (contains, uses, supp_nation, cust_nation, nation_region):
        out = out.unionByName(part_df)
    return out.select(F.lit("all").alias("graph_id"), *out.columns)


def order_triples(spark: SparkSession, sf: str) -> DataFrame:
    """One graph per order: customer, order, its parts, their suppliers, nations and regions.

    Rows are dealt by ``graph_id``, so what follows graph by graph needs no further exchange.
    """
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    supp = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    geo = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = F.col("gkey")
    olabel = F.concat(F.lit("Order "), g.cast("string"))
    order_id = _id("o", "gkey")

    def link(seq, sid, slabel, predicate, oid, olabel, origin, layer):
        return F.struct(*[c.alias(n) for c, n in zip(
            (seq, sid, slabel, F.lit(predicate), oid, olabel, F.lit(origin), F.lit(layer)),
            ("seq", "subject_id", "subject_label", "predicate", "object_id", "object_label", "origin", "domain_type"))])

    def rows(df, *links):
        # orders and lines are dealt by graph before they become links: links of one graph are then made and met in one place
        dealt = df.withColumn("graph_id", _id("o", "gkey")).repartition("graph_id")
        return dealt.select("gkey", "graph_id", F.explode(F.array(*links)).alias("x")).select("gkey", "graph_id", "x.*")

    head = orders.withColumnRenamed("o_orderkey", "gkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    head = head.join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    heads = rows(
        head,
        link(F.concat(F.lit("1"), _pad("gkey")), _id("c", "o_custkey"), F.col("c_name"), "places", order_id, olabel, "user", "business"),
        F.when(F.col("n_name").isNotNull(), link(
            F.concat(F.lit("5"), _pad("gkey")), _id("c", "o_custkey"), F.col("c_name"), "is_part_of", _id("n", "n_nationkey"), F.col("n_name"), "connection", "business")))
    full = lines.withColumnRenamed("l_orderkey", "gkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    full = full.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(geo, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    known = lambda x: F.when(F.col("n_name").isNotNull(), x)
    # the joins run once; repeated lines and what several lines of an order have in common are made distinct without moving the links
    body = rows(
        full,
        link(F.concat(F.lit("2"), _pad("gkey"), _pad("l_partkey")), order_id, olabel, "contains", _id("p", "l_partkey"), F.col("p_name"), "domain", "system"),
        link(F.concat(F.lit("3"), _pad("gkey"), _pad("l_partkey"), _pad("l_suppkey")), _id("p", "l_partkey"), F.col("p_name"), "uses", _id("s", "l_suppkey"), F.col("s_name"), "domain", "data"),
        known(link(F.concat(F.lit("4"), _pad("gkey"), _pad("l_suppkey")), _id("s", "l_suppkey"), F.col("s_name"), "is_part_of", _id("n", "n_nationkey"), F.col("n_name"), "domain", "technology")),
        known(link(F.concat(F.lit("6"), _pad("gkey"), _pad("n_nationkey")), _id("n", "n_nationkey"), F.col("n_name"), "belongs_to", _id("r", "r_regionkey"), F.col("r_name"), "domain", "technology")))
    return heads.unionByName(body.distinct()).filter(F.col("seq").isNotNull()).drop("gkey")


def seeds(spark: SparkSession, sf: str, segment: str = "FURNITURE") -> DataFrame:
    cust = table(spark, sf, "customer").filter(F.col("c_mktsegment") == segment)
    return cust.select(F.lit("all").alias("graph_id"), _id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select(
        F.lit("all").alias("graph_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


LAYER_OF_REMAINDER = ["business", "system", "data", "technology"]


def vector_layers(vecs: DataFrame) -> DataFrame:
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYER_OF_REMAINDER]), (F.col("label") % 4 + 1).cast("int"))
    return vecs.withColumn("layer", layer)


def vector_links(spark: SparkSession, sf: str) -> DataFrame:
    """Two out-links per vector, by modular steps over the whole table."""
    emb = table(spark, sf, "embeddings").select("vec_id")
    n = emb.groupBy(F.lit("all").alias("graph_id")).agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(F.struct(F.lit(7).alias("a"), F.lit(1).alias("b")), F.struct(F.lit(13).alias("a"), F.lit(5).alias("b")))
    both = emb.withColumn("graph_id", F.lit("all")).join(n, "graph_id").select("vec_id", "n", F.explode(steps).alias("st"))
    target = (F.col("vec_id") * F.col("st.a") + F.col("st.b")) % F.col("n")
    return both.select(
        F.lit("all").alias("graph_id"), _id("v", "vec_id").alias("source"),
        F.concat(F.lit("v"), target.cast("string")).alias("target"))


EVENT_LAYER = {"signup": "business", "view": "system", "click": "data", "purchase": "technology", "error": "unknown"}
EVENT_PREDICATE = ["implements", "enables", "uses", "contains", "other"]


def path_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered steps per user and week: previous event type to event type."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    ev = ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"),
                 F.date_format(F.date_trunc("week", F.col("ts")), "yyyyMMdd")).alias("path_id"),
        F.date_format("ts", "yyyyMMdd").alias("day"), "ts", "event_id", "event_type")
    ev = prefix_lag(ev, ["path_id"], "day", ["ts", "event_id"], ["event_type"])
    ev = bucketed_index(ev, ["path_id"], "day", ["ts", "event_id"]).filter(F.col("prev_event_type").isNotNull())
    predicate = F.element_at(F.array(*[F.lit(p) for p in EVENT_PREDICATE]), (F.col("event_id") % 5 + 1).cast("int"))
    layer = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_LAYER.items() for x in kv]), F.col(c))
    return ev.select(
        "path_id", F.col("pos").alias("pos"), F.col("prev_event_type").alias("subject"), predicate.alias("predicate"),
        F.col("event_type").alias("object"), layer("prev_event_type").alias("subject_layer"),
        layer("event_type").alias("object_layer"))


def prompt_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turn and the assistant turn right after it, matched on (conversation, turn + 1)."""
    conv = table(spark, sf, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    reply = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"),
        "prompt", "response")


MODEL_OF_FLAG = {"A": "gnn", "N": "mcts", "R": "rmodel"}
METRICS = ["discount", "tax", "quantity", "price", "node_count"]


def eval_wide(spark: SparkSession, sf: str) -> DataFrame:
    """eval_id, domain, model and one column per metric."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    model = F.element_at(F.create_map(*[F.lit(x) for kv in MODEL_OF_FLAG.items() for x in kv]), F.col("l_returnflag"))
    agg = lines.groupBy("l_orderkey", model.alias("model")).agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
        (F.avg("l_quantity") / 50).alias("quantity"), (F.avg("l_extendedprice") / 100000).alias("price"),
        F.size(F.collect_set("l_partkey")).cast("double").alias("node_count"))
    keyed = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return agg.join(keyed, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("eval_id"), F.col("c_mktsegment").alias("domain"), "model", *METRICS)


def eval_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = eval_wide(spark, sf)
    return wide.unpivot(["eval_id", "domain", "model"], METRICS, "metric", "value")
