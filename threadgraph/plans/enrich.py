"""The whole enrichment of user triples by a domain graph, for many graphs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadgraph.functions.text import parse_triple_lines, surrogate_id
from threadgraph.operators.corpus import drop_generic
from threadgraph.operators.graph import (
    dedup_unordered_pairs, jaccard, links_to_triples, materialize_graph, split_by_origin, subgraph_inventory,
)
from threadgraph.operators.similarity import graph_conv_embed, semantic_connections, similarity_connections, topk_per_level
from threadgraph.plans.paths import beam_search, path_to_graph, state_steps
from threadgraph.plans.pruning import LADDER, prune_by_similarity
from threadgraph.session import materialize

RECORD = ["graph_id", "seq", "subject_id", "subject_label", "predicate", "object_id", "object_label", "origin", "domain_type"]


def _records(df: DataFrame, rank: int, origin: str) -> DataFrame:
    """Common record columns; ``rank`` keeps the order of the sources in ``seq``."""
    layer = F.col("domain_type") if "domain_type" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"seq": F.concat(F.lit(f"{rank}|"), F.col("seq").cast("string")), "origin": F.lit(origin), "domain_type": layer}).select(*RECORD)


def enrich(user_triples: DataFrame, kg_nodes: DataFrame, kg_links: DataFrame, user_vectors: DataFrame, candidates: DataFrame,
           hops: int = 1, threshold: float = 0.55, min_records: int = 10, depth: int = 15) -> dict[str, DataFrame]:
    """User records, pruned domain records, candidate records, connections, embedding links,
    node and link tables per subgraph, overlap and a path.

    ``user_triples``: graph_id, seq, subject_label, predicate, object_label. ``kg_nodes`` and
    ``user_vectors``: graph_id, id, label, vec, layer. ``candidates``: graph_id, text.
    """
    uid = lambda role: surrogate_id(F.col("graph_id"), F.col("seq"), role)
    user = _records(user_triples.withColumns({"subject_id": uid("user_s"), "object_id": uid("user_o")}), 0, "user")

    nodes, links = prune_by_similarity(kg_nodes, kg_links, user_vectors, hops, ladder=[0.85, *LADDER[1:]])
    nodes = materialize(nodes)
    domain = links_to_triples(links.withColumn("origin", F.lit("domain")), nodes, "inner")
    layer = nodes.select("graph_id", F.col("id").alias("subject_id"), F.col("layer").alias("domain_type"))
    domain = _records(domain.join(layer, ["graph_id", "subject_id"], "left"), 1, "domain")

    cand = parse_triple_lines(candidates).withColumn("seq", F.lpad(F.col("line_no").cast("string"), 9, "0"))
    cand = dedup_unordered_pairs(drop_generic(cand.withColumn("origin", F.lit("llm"))))
    cand = _records(cand.withColumns({"subject_id": uid("gen_s"), "object_id": uid("gen_o")}), 2, "llm")

    label = nodes.select("graph_id", "id", "label")
    def named(df: DataFrame, users: DataFrame) -> DataFrame:
        s = users.select("graph_id", F.col("id").alias("subject_id"), F.col("label").alias("subject_label"))
        o = label.select("graph_id", F.col("id").alias("object_id"), F.col("label").alias("object_label"))
        d = df.drop("object_label", "subject_label").join(s, ["graph_id", "subject_id"]).join(o, ["graph_id", "object_id"])
        return d.withColumn("seq", F.concat_ws("|", "subject_id", "object_id", "predicate"))
    conn = _records(named(similarity_connections(user_vectors, nodes, threshold), user_vectors), 3, "connection")

    records = materialize(user.unionByName(domain).unionByName(cand).unionByName(conn))
    large = records.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_records).select("graph_id")
    entities = nodes.unionByName(user_vectors.select(*nodes.columns)).dropDuplicates(["graph_id", "id"]).join(large, "graph_id", "left_semi")
    emb = materialize(graph_conv_embed(entities.select("graph_id", "id", "vec"), links).join(entities.select("graph_id", "id", "label", "layer"), ["graph_id", "id"]))
    seeds = emb.join(user_vectors.select("graph_id", "id"), ["graph_id", "id"], "left_semi")
    near = named(semantic_connections(seeds.select("graph_id", "id", "vec"), emb, 0.5), emb)
    level = named(topk_per_level(seeds, emb), emb)
    gnn = _records(near.select("graph_id", "seq", "subject_id", "subject_label", "predicate", "object_id", "object_label").unionByName(
        level.select("graph_id", "seq", "subject_id", "subject_label", "predicate", "object_id", "object_label")), 4, "gnn")

    records = materialize(records.unionByName(gnn))
    all_nodes, all_links = materialize_graph(records)
    sub_nodes, sub_links = split_by_origin(all_nodes, all_links)

    users = user.select("graph_id", F.explode(F.array("subject_label", "object_label")).alias("l")).distinct().withColumn("is_user", F.lit(True))
    layers = emb.select("graph_id", F.col("label").alias("l"), "layer").dropDuplicates(["graph_id", "l"])
    pool = records.filter("origin <> 'connection'").join(large, "graph_id", "left_semi").select(
        "graph_id", "seq", F.col("subject_label").alias("subject"), "predicate", F.col("object_label").alias("object"))
    for end in ("subject", "object"):
        pool = pool.join(users.withColumnsRenamed({"l": end, "is_user": f"{end}_is_user"}), ["graph_id", end], "left")
        pool = pool.join(layers.withColumnsRenamed({"l": end, "layer": f"{end}_layer"}), ["graph_id", end], "left")
        pool = pool.fillna(False, [f"{end}_is_user"]).fillna("unknown", [f"{end}_layer"])
    steps = materialize(state_steps(beam_search(pool, depth=depth)))
    path_nodes, path_links = path_to_graph(steps)
    return {
        "records": records, "nodes": sub_nodes, "links": sub_links, "inventory": subgraph_inventory(sub_nodes, sub_links),
        "similarity": jaccard(user, domain), "path": steps, "path_nodes": path_nodes, "path_links": path_links,
    }
