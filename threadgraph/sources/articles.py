"""Article collections: reading, column mapping, extra fields and the partitioned index sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadgraph.functions.text import truncate

TOPIC_CHARS, URL_CHARS = 1000, 8000


def scan_articles(spark: SparkSession, paths: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """CSV files by index name; rows without any value are dropped, ``index`` tells the source."""
    parts = []
    for index, path in paths.items():
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        df = (reader.schema(schema) if schema else reader).csv(path)
        parts.append(df.na.drop("all").withColumn("index", F.lit(index)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def column_mapping(columns: list[str]) -> dict[str, str]:
    """Source column for Topics and URLs: the first rule whose columns exist."""
    for topic, url in (("description", "url"), ("text", "url"), ("Content", "Query")):
        if topic in columns and url in columns:
            return {"Topics": topic, "URLs": url}
    out = {}
    topics = [c for c in columns if c.lower() not in ("id", "unnamed: 0", "index")]
    urls = [c for c in columns if "url" in c.lower()]
    if "Topics" in columns or topics:
        out["Topics"] = "Topics" if "Topics" in columns else topics[0]
    if "URLs" in columns or urls:
        out["URLs"] = "URLs" if "URLs" in columns else urls[0]
    return out


def normalize_articles(df: DataFrame) -> DataFrame:
    """Topics and URLs by the mapping rules, trimmed and cut to the index limits."""
    m = column_mapping([c for c in df.columns if c != "index"])
    pick = lambda name: F.trim(F.col(m[name]).cast("string")) if name in m else F.lit("")
    rest = [c for c in df.columns if c not in m.values()]
    return df.select(*rest, truncate(pick("Topics"), TOPIC_CHARS).alias("Topics"), truncate(pick("URLs"), URL_CHARS).alias("URLs"))


def truncated_counts(df: DataFrame) -> DataFrame:
    flag = lambda c: F.sum(F.when(F.col(c).endswith("..."), 1).otherwise(0))
    return df.groupBy("index").agg(F.count(F.lit(1)).alias("docs"), flag("Topics").alias("topics_truncated"), flag("URLs").alias("urls_truncated"))


def extra_fields_map(df: DataFrame, keep=("index", "Topics", "URLs"), limit: int = URL_CHARS) -> DataFrame:
    """All other non-null columns as one string map, over-long values left out."""
    rest = [c for c in df.columns if c not in keep]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    extra = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (F.length(v) <= limit)) if rest else F.create_map().cast("map<string,string>")
    return df.select(*[c for c in keep if c in df.columns], extra.alias("extra"))


def write_indices(df: DataFrame, path: str) -> None:
    """Append to one folder per index. A task retry rewrites only its own files."""
    df.write.mode("append").partitionBy("index").parquet(path)


def index_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("index").agg(F.count(F.lit(1)).alias("docs"))
