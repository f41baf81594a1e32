"""Helpers of the training-data operators: tables, keys, intermediate tables, span digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgraph.session import checkpoint_dir, materialize

#: White space that separates words in every contract: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    return materialize(df)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        base = root.toUri().getPath()
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            if target.toUri().getPath().startswith(base):
                fs.delete(target, True)


def fingerprint(text: Column) -> Column:
    """Key part that tells rows with one id and different texts apart; equal rows stay equal."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) with the key ``fp``; other columns, whatever their names, are left out."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))


def attach(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join two tables of documents by ``doc_id`` (null ids match) and ``fp``; keys appear once."""
    r = right.withColumnsRenamed({"doc_id": "_doc_id", "fp": "_fp"})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("fp") == F.col("_fp"))
    return left.join(r, on, how).drop("_doc_id", "_fp")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined; ``spans`` is an array of (start, rank, end, kind), sorted here."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")
