"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rnd(col: Column, digits: int = 6) -> Column:
    """Half-up rounding by scaling; plain double arithmetic, the same in every engine."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def grouped(df: DataFrame, *keys):
    """``groupBy(*keys)`` for aggregates that hold strings, which Spark sorts: a hash ``_h`` of the keys comes first.

    A sort compares the first eight bytes of its first key in place and whole rows only when these are equal;
    behind a ``graph_id`` shared by all rows that would be every time. The result has the column ``_h``.
    """
    return df.groupBy(F.xxhash64(*keys).alias("_h"), *keys)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the one with the smallest (or largest) ``order``.

    An aggregate, not a window, so each task keeps one candidate per key before the
    shuffle and a hot key costs no more than a rare one.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in rest])
    best = grouped(df, *keys).agg(pick(row, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. ``row_number() <= k`` is cut to k rows per task before the shuffle."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def prefix_lag(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], cols: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """``lag`` over a long sequence without putting a whole key into one task.

    ``bucket`` splits each key into consecutive stretches. The window runs inside a
    stretch; the first row of a stretch takes its predecessor from the last row of the
    previous stretch, found on one summary row per stretch.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    row = F.struct(*[F.col(c) for c in cols])
    inside = df.withColumn("_prev", F.lag(row).over(inner))
    ends = df.groupBy(*keys, bucket).agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("_end"))
    outer = Window.partitionBy(*keys).orderBy(bucket)
    ends = ends.select(*keys, bucket, F.lag("_end").over(outer).alias("_before"))
    joined = inside.join(ends, [*keys, bucket], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_before"))
    return joined.select(*df.columns, *[prev[c].alias(prefix + c) for c in cols])


def bucketed_index(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Dense 0-based position per key: local row number plus the sizes of earlier stretches."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = df.withColumn("_rn", F.row_number().over(inner) - 1)
    return local.join(sizes, [*keys, bucket]).select(*df.columns, (F.col("_rn") + F.col("_off")).cast("long").alias(name))
