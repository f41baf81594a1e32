"""Similarity pruning of a domain graph around user entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadgraph.functions.text import clean_label
from threadgraph.operators.common import top_k
from threadgraph.operators.connectivity import adjacency, khop
from threadgraph.operators.graph import incident_links, induce
from threadgraph.operators.similarity import max_similarity
from threadgraph.session import materialize

LADDER = [0.65, 0.6, 0.55, 0.5, 0.45, 0.4]


def relevant_nodes(nodes: DataFrame, users: DataFrame, ladder=LADDER, enough: int = 5, top: int = 30, few: int = 10, fallback: int = 50) -> tuple[DataFrame, DataFrame]:
    """Node ids that start the pruned graph, and every node's best similarity.

    The threshold ladder is one aggregate per graph: a count per rung, then the first rung
    with more than ``enough`` nodes (the last rung if none).
    """
    sims = materialize(max_similarity(users, nodes))
    counts = sims.groupBy("graph_id").agg(*[F.sum(F.when(F.col("similarity") >= t, 1).otherwise(0)).alias(f"c{i}") for i, t in enumerate(ladder)])
    rung = F.when(F.lit(False), F.lit(0.0))
    for i, t in enumerate(ladder):
        rung = rung.when(F.col(f"c{i}") > enough, F.lit(t))
    counts = counts.select("graph_id", rung.otherwise(F.lit(ladder[-1])).alias("t"))
    above = sims.join(counts, "graph_id").filter("similarity >= t").select("graph_id", "id")
    best = top_k(sims, ["graph_id"], [F.col("similarity").desc(), F.col("id")], fallback, "rn")
    named = users.select("graph_id", clean_label(F.col("label")).alias("_k")).distinct()
    exact = nodes.withColumn("_k", clean_label(F.col("label"))).join(named, ["graph_id", "_k"], "left_semi").select("graph_id", "id")
    picked = above.unionByName(exact).unionByName(best.filter(F.col("rn") <= top).select("graph_id", "id")).distinct()
    size = picked.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    thin = size.filter(F.col("n") < few).select("graph_id")
    picked = picked.join(thin, "graph_id", "left_anti").unionByName(best.join(thin, "graph_id", "left_semi").select("graph_id", "id"))
    return materialize(picked), sims


def prune_by_similarity(nodes: DataFrame, links: DataFrame, users: DataFrame, hops: int = 1, ladder=LADDER,
                        min_links: int = 3, fallback_nodes: int = 20) -> tuple[DataFrame, DataFrame]:
    """Relevant nodes, expanded by ``hops`` and induced.

    Graphs that keep fewer than ``min_links`` links switch to their most similar nodes with
    all incident links; the switch is a per-graph flag, so all graphs stay in one job.
    """
    start, sims = relevant_nodes(nodes, users, ladder)
    ball = khop(adjacency(links), start, hops).select("graph_id", "id").distinct()
    kept_nodes, kept_links = induce(nodes, links, materialize(ball))
    kept_links = materialize(kept_links)
    enough = kept_links.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_links).select("graph_id")
    top = top_k(sims.join(enough, "graph_id", "left_anti"), ["graph_id"], [F.col("similarity").desc(), F.col("id")], fallback_nodes)
    near = incident_links(links, top)
    ends = near.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    near_nodes = nodes.join(ends, ["graph_id", "id"], "left_semi").select(*nodes.columns)
    good = lambda df: df.join(enough, "graph_id", "left_semi").select(*df.columns)
    return good(kept_nodes).unionByName(near_nodes), good(kept_links).unionByName(near.select(*kept_links.columns))
