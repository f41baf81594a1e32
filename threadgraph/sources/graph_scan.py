"""Reading property graphs as node and link tables, pattern and property lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.functions.text import clean_label


def _name(fields) -> Column:
    return F.coalesce(*[F.nullif(clean_label(F.col(f)), F.lit("")) for f in fields])


def scan_graph(nodes: DataFrame, edges: DataFrame, fields=("localName", "name", "label", "title")) -> tuple[DataFrame, DataFrame]:
    """Nodes that touch an edge and all links (self and parallel ones kept).

    The label is the first filled name field. A node seen as a source falls back to its id,
    one only ever seen as a target does not; the source view wins.
    """
    named = nodes.select("id", _name(fields).alias("_name"), F.coalesce(F.get("labels", F.lit(0)), F.lit("Node")).alias("type"))
    sides = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(0).alias("side")), F.struct(F.col("target").alias("id"), F.lit(1).alias("side")))).alias("e"))
    seen = sides.groupBy(F.col("e.id").alias("id")).agg(F.min("e.side").alias("side"))
    out = named.join(seen, "id").select(
        "id", F.coalesce("_name", F.when(F.col("side") == 0, F.col("id")).otherwise("")).alias("label"), "type")
    return out, edges.select("source", "target", "label")


def pattern_query(links: DataFrame, roots: DataFrame, first: str, arms: list[tuple[str, str]]) -> DataFrame:
    """root -first-> middle, then each optional (predicate, direction) arm of the middle node.

    A middle node without any arm gives one row with null arm columns.
    """
    base = links.filter(F.col("label") == first).join(roots.select("graph_id", F.col("id").alias("source")), ["graph_id", "source"], "left_semi")
    base = base.select("graph_id", F.col("source").alias("root"), F.col("target").alias("middle"))
    hit = F.lit(False)
    for predicate, direction in arms:
        hit = hit | (F.col("label") == predicate)
    direction = F.create_map(*[F.lit(x) for arm in arms for x in arm])
    arm_rows = links.filter(hit).withColumn("_d", F.element_at(direction, F.col("label")))
    arm_rows = arm_rows.select(
        "graph_id", F.when(F.col("_d") == "out", F.col("source")).otherwise(F.col("target")).alias("middle"),
        F.col("label").alias("relation"), F.when(F.col("_d") == "out", F.col("target")).otherwise(F.col("source")).alias("other"))
    return base.join(arm_rows.distinct(), ["graph_id", "middle"], "left").dropDuplicates(["graph_id", "root", "middle", "relation", "other"])


def property_match(nodes: DataFrame, key: str, value, order: list[str], limit: int = 10) -> DataFrame:
    return nodes.filter(F.col(key) == value).orderBy(*order).limit(limit)
