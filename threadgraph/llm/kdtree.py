"""Sharding by a k-d tree over document metadata.

A node of the tree stands for a run of shard numbers. It is cut along its widest metadata
dimension at the weighted quantile that gives each side bytes in proportion to its shards,
until every node is one shard. The cuts of a level are found for all its nodes at once by
histograms that close in on them: each round is one aggregate with at most ``BUCKETS`` rows
a node, no row is moved. Tree and cuts are tables; the driver only asks whether a node is
still open.

A dimension is a number per row. Rows with equal numbers (one source may hold a third of
them) are told apart by a hash of the row and then by its place in the input, so that a cut can
fall anywhere. Slots are numbered inside hash stretches of a shard, each offset by the
stretches before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgraph.llm import query
from threadgraph.llm.common import discard, stored, table

#: Histogram cells a node and round; part of a shard's bytes by which a cut may miss; rows numbered in one stretch.
BUCKETS, TOLERANCE, STRETCH = 4096, 1 / 2000, 100_000
#: A row's place on a dimension takes ``PLACE`` bits, followed by ``TIE`` bits of its hash.
PLACE, TIE = 36, 26
#: More shards than this would make the table of nodes too large to hand to every task.
MAX_SHARDS = 1_000_000
LAST = 2**63 - 1


def coordinate(column: Column, kind: str) -> Column:
    """A column as a number in its own order, null below all; of strings the first six bytes count."""
    if kind == "string":
        return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode(column, "utf-8")), 1, 12), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))
    number = column.cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(None)).otherwise(number)


def narrow_rows(docs: DataFrame, dims: Sequence[str], text: str = "text") -> DataFrame:
    """What is cut: ``doc_id, size, crc``, the row's hash and number, and its key on each dimension."""
    kinds = dict(docs.dtypes)
    body = F.coalesce(F.col(text), F.lit(""))
    spots = [coordinate(F.col(c), kinds[c]).alias(f"x{i}") for i, c in enumerate(dims)]
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), *spots)
    rows = stored(rows.withColumns({"tie": F.xxhash64("doc_id", "crc", "size"), "at": F.monotonically_increasing_id()}))
    box = rows.agg(F.count(F.lit(1)).alias("n"), *[f(f"x{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def key(i: int) -> Column:
        lo, hi = box[f"lo{i}"], box[f"hi{i}"]
        share = F.lit(0.0) if lo is None or hi == lo else F.coalesce((F.col(f"x{i}") - lo) / (hi - lo), F.lit(0.0))
        return F.shiftleft(F.floor(share * float(2**PLACE - 1)).cast("long"), TIE) + F.shiftrightunsigned("tie", 64 - TIE)

    return rows.select("doc_id", "size", "crc", "tie", "at", *[key(i).alias(f"k{i}") for i in range(len(dims))])


def _pick(n_dims: int) -> Column:
    """The row's key on the dimension chosen for its node."""
    return F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k{i}")) for i in range(n_dims)])


def _widest(rows: DataFrame, n_dims: int, leaf: float) -> DataFrame:
    """Nodes of a level with their widest dimension, its range and the bytes wanted on the left."""
    ends = [f(f"k{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    nodes = rows.filter("k > 1").groupBy("node", "k").agg(F.sum("size").alias("bytes"), *ends)
    wide = [F.struct((F.shiftright(f"hi{i}", TIE) - F.shiftright(f"lo{i}", TIE)).alias("w"), F.lit(-i).alias("i"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in range(n_dims)]
    best = F.array_max(F.array(*wide))
    nodes = nodes.withColumns({"b": best, "kl": F.floor(F.col("k") / 2).cast("int")})
    return nodes.select(
        "node", "k", "kl", (-F.col("b.i")).alias("dim"), (F.col("bytes") * F.col("kl") / F.col("k")).cast("long").alias("want"), F.lit(leaf * TOLERANCE).alias("slack"),
        F.lit(0).cast("long").alias("before"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("last"))


def _close_in(rows: DataFrame, nodes: DataFrame, n_dims: int) -> DataFrame:
    """One round: the histogram cell of each open node in which the wanted bytes are reached.

    ``key`` is set once a node's cut is known to fall among rows of one key; then their
    numbers are cut in the same way. A node with ``last`` is closed: rows up to
    (``key``, ``last``) go left.
    """
    n = F.broadcast(nodes.filter("last IS NULL").select("node", "dim", "lo", "hi", "key"))
    inside = rows.filter("k > 1").join(n, "node").withColumn("own", _pick(n_dims))
    inside = inside.withColumn("v", F.when(F.col("key").isNull(), F.col("own")).when(F.col("own") == F.col("key"), F.col("at")))
    inside = inside.filter(F.col("v").between(F.col("lo"), F.col("hi")))
    cell = F.expr(f"(v - lo) div ((hi - lo) div {BUCKETS} + 1)")
    cells = inside.groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("w"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    w = Window.partitionBy("node").orderBy("cell")
    cells = cells.withColumn("cum", F.sum("w").over(w)).join(F.broadcast(nodes.select("node", "before", "want")), "node")
    hit = cells.filter("before + cum >= want").groupBy("node").agg(F.min_by(F.struct("w", "mn", "mx", "cum"), "cell").alias("c"))
    new = nodes.join(F.broadcast(hit), "node", "left")
    done = (F.col("c.w") <= F.col("slack")) | (F.col("c.mn") == F.col("c.mx"))
    before = F.col("before") + F.col("c.cum") - F.col("c.w")
    # take the last cell, too, if that comes nearer
    take = F.col("before") + F.col("c.cum") - F.col("want") <= F.col("want") - before
    end = F.when(take, F.col("c.mx")).otherwise(F.col("c.mn") - 1)
    deeper = F.col("key").isNull() & (F.col("c.w") > F.col("slack")) & (F.col("c.mn") == F.col("c.mx"))
    is_open = F.col("last").isNull()
    return stored(new.select(
        "node", "k", "kl", "dim", "want", "slack", F.when(is_open, before).otherwise(F.col("before")).alias("before"),
        F.when(deeper, F.lit(0)).when(is_open, F.col("c.mn")).otherwise(F.col("lo")).cast("long").alias("lo"),
        F.when(deeper, F.lit(LAST - 1)).when(is_open, F.col("c.mx")).otherwise(F.col("hi")).alias("hi"),
        F.when(deeper, F.col("c.mn")).when(is_open & done & F.col("key").isNull(), end).otherwise(F.col("key")).alias("key"),
        F.when(~is_open, F.col("last")).when(deeper | ~done, F.lit(None)).when(F.col("key").isNull(), F.lit(LAST)).otherwise(end).alias("last")))


def kd_shards(docs: DataFrame, dims: Sequence[str], shards: int | None = None, target_bytes: int | None = None, text: str = "text") -> DataFrame:
    """``doc_id, size, crc, shard, slot`` of every row; ``shards`` leaves, or as many as ``target_bytes`` asks for.

    The bytes of all shards are near equal: each cut misses its share by at most a row or
    1/2000 of a shard. A null text has no bytes and counts 16; equal texts are ordinary rows, so a
    group larger than a shard spreads over several. Null in a dimension lies lowest; columns
    that are no dimension do not matter. Repeated rows are cut by their place in the
    input. Fewer rows than shards leave shards empty, an empty table gives no rows. The
    loop runs Spark jobs while the plan is built.
    """
    rows = stored(narrow_rows(docs, dims, text).withColumn("node", F.lit(0)))
    total = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if shards is None:
        shards = max(1, math.ceil((total["b"] or 0) / target_bytes))
    if not 0 < shards <= MAX_SHARDS:
        raise ValueError(f"shards must lie between 1 and {MAX_SHARDS}")
    rows = rows.withColumn("k", F.lit(shards))
    for _ in range(math.ceil(math.log2(shards))):
        nodes = stored(_widest(rows, len(dims), (total["b"] or 0) / shards))
        while nodes.filter("last IS NULL").limit(1).count():
            nodes, old = _close_in(rows, nodes, len(dims)), nodes
            discard(old)
        cut = F.broadcast(nodes.select("node", "kl", "dim", "key", "last"))
        left = (_pick(len(dims)) < F.col("key")) | ((_pick(len(dims)) == F.col("key")) & (F.col("at") <= F.col("last")))
        side = F.when(F.col("kl").isNull(), F.struct("node", "k")).when(left, F.struct("node", F.col("kl").alias("k"))).otherwise(
            F.struct((F.col("node") + F.col("kl")).alias("node"), (F.col("k") - F.col("kl")).alias("k")))
        moved = rows.join(cut, "node", "left").withColumn("_s", side)
        new = stored(moved.select(*[c for c in rows.columns if c not in ("node", "k")], F.col("_s.node").alias("node"), F.col("_s.k").alias("k")))
        discard(rows, nodes)
        rows = new
    return numbered(rows.withColumnRenamed("node", "shard"), total["n"], shards).select("doc_id", "size", "crc", "shard", "slot")


def numbered(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard, in order of the rows' hashes.

    Stretches of a shard are ranges of hashes; one that repeated rows make large is dealt
    out by row number.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / shards / STRETCH))))
    h = F.shiftrightunsigned("tie", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("h", h)
    parts = rows.groupBy("shard", "h").agg(F.ceil(F.count(F.lit(1)) / (4 * STRETCH)).alias("parts")).filter("parts > 1")
    rows = rows.join(parts, ["shard", "h"], "left").withColumn("part", F.coalesce(F.expr("at % parts"), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("h", "part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "h", "part").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("shard", "h", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"))
    inner = Window.partitionBy("shard", "h", "part").orderBy("tie", "at")
    return rows.withColumn("i", F.row_number().over(inner) - 1).join(sizes, ["shard", "h", "part"]).withColumn("slot", (F.col("i") + F.col("off")).cast("long"))


@query("op13_kdtree_shards")
def kdtree_q(spark, sf_dir):
    out = kd_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], shards=40)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
