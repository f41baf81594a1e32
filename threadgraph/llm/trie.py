"""Prefix trie of conversations, built as a z-fast trie.

Conversations are strings of turns. A compacted node of the trie is a prefix (its extent) at which
conversations end or part; it owns the edge of depths (p, e] from its parent's extent p to
its own e. The node is filed under the hash of its extent's prefix at the two-fattest depth
of the edge, so a conversation finds the deepest extent it contains by a fat binary search
over depths, with as many joins as its length has bits.

Conversations are inserted in batches. In each, all that are still outside locate the edge at which they
leave the trie; edges are split where they leave, and of those that go on with the same
next turn one, picked by hash, brings its rest as a new leaf. The others follow in later batches, at
a deeper place; as the pick is random their number halves, so batches grow with the logarithm of a
group. At last edges are expanded to one row per depth.

A prefix is known by a 128-bit digest of two sums of turn hashes salted by position. Sums run
over stretches of rows, so that a very long conversation needs no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgraph.llm import query
from threadgraph.llm.common import SPACE, stored, table

#: Every ``FAMILY`` ids share the opening of the first; ids in one chunk of an ends digest.
FAMILY, CHUNK = 20, 4096


# --- rebuilt conversations ------------------------------------------------------------------

def _running(df: DataFrame, keys: list[str], stretch: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums per key in ``order``; stretches of a key are summed apart and offset."""
    inner = Window.partitionBy(*keys, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = df.groupBy(*keys, stretch).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*keys, stretch, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = df.withColumns({f"_i_{n}": F.sum(c).over(inner) for n, c in sums.items()}).join(offsets, [*keys, stretch])
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns ``conv_id, d, role, text`` of the rebuilt conversations (d from 1).

    Turns are ordered by ``turn`` (null first), equal turns by role and text. Conversation c opens with the
    first h turns of the family's first conversation and goes on with its own after the h-th; h = crc32(c) mod 4.
    Rows without conv_id belong to no conversation. The row order is a range sort over all
    columns, so one conversation may fill many partitions.
    """
    turn = F.col("turn")
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the hash tells rows apart for the range split; it orders nothing that role and text would not
    order = ["conv_id", "turn", "role", "text"]
    rows = stored(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()))
    rows = _running(rows, ["conv_id"], "part", ["turn", "role", "text"], {"i": F.lit(1).cast("long")})
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    rows = stored(rows.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}))
    ids = rows.select("conv_id", "h", "base").distinct()
    # at most three turns a family
    opening = rows.filter("conv_id = base AND i <= 3").select("base", F.col("i").alias("d"), "role", "text")
    had = opening.groupBy("base").agg(F.count(F.lit(1)).alias("had"))
    first = ids.filter("conv_id <> base").join(opening, "base").filter("d <= h").select("conv_id", "d", "role", "text", F.lit(-1).alias("part"))
    own = rows.filter("conv_id = base OR i > h").join(had, "base", "left")
    d = F.when(F.col("conv_id") == F.col("base"), F.col("i")).otherwise(F.least("h", F.coalesce("had", F.lit(0))) + F.col("i") - F.col("h"))
    own = own.select("conv_id", d.alias("d"), "role", "text", "part")
    return ids.select("conv_id"), first.unionByName(own)


def prefixes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, d, key, words`` of every prefix, the empty one (d = 0) included; ``words`` runs over the prefix."""
    # every char but the six of white space is part of a word
    bare = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    n = F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")
    wide = lambda *c: F.xxhash64(*c).cast("decimal(20,0)")
    size = F.octet_length("role")  # keeps role and text apart
    rows = turns.select("conv_id", "d", "part", n.alias("n"), wide("d", size, "role", "text").alias("a"), wide("text", F.lit("turn"), "role", size, "d").alias("b"))
    rows = _running(rows, ["conv_id"], "part", ["d"], {"sa": F.col("a"), "sb": F.col("b"), "words": F.col("n")})
    key = F.md5(F.concat_ws(":", "d", "sa", "sb").cast("binary"))
    root = ids.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit("").alias("key"), F.lit(0).cast("long").alias("words"))
    return root.unionByName(rows.select("conv_id", F.col("d").cast("long").alias("d"), key.alias("key"), "words"))


# --- the z-fast trie ------------------------------------------------------------------------

def two_fattest(lo: Column, hi: Column) -> Column:
    """The number in (lo, hi] that the highest power of two divides."""
    bits = F.length(F.bin(lo.bitwiseXOR(hi))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", hi, bits), bits)


def _filed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes with their handle (two-fattest depth ``f`` of the edge, ``fkey``) and first turn's key ``ckey``."""
    at = nodes.withColumns({"f": two_fattest(F.col("p"), F.col("e")), "c": F.col("p") + 1})
    k = lambda n: paths.select(F.col("sid").alias("ref"), F.col("d").alias(n), F.col("key").alias(n + "key"))
    return at.join(k("f"), ["ref", "f"]).join(k("c"), ["ref", "c"]).drop("c")


def _locate(out: DataFrame, trie: DataFrame, paths: DataFrame, bits: int) -> DataFrame:
    """For conversations ``sid, n, lo`` (a known extent): the deepest extent ``lo`` on their path and the edge left.

    A step looks the handle in the middle of (lo, hi] up. With its node's extent on the
    path the search goes on below it, otherwise the path ends in this edge or above the handle.
    """
    z = trie.select("f", "fkey", "e", "key")
    s = out.select("sid", "n", "lo", F.col("n").alias("hi"))
    for step in range(bits):
        f = two_fattest(F.col("lo"), F.col("hi"))
        on = paths.select("sid", F.col("d").alias("f"), F.col("key").alias("fkey"))
        looked = s.withColumn("f", F.when(F.col("lo") < F.col("hi"), f)).join(on, ["sid", "f"], "left").join(z, ["f", "fkey"], "left")
        ext = paths.select("sid", F.col("d").alias("e"), F.col("key").alias("own"))
        looked = looked.join(ext, ["sid", "e"], "left")
        inside = F.col("own") == F.col("key")
        s = looked.select(
            "sid", "n", F.when(inside, F.col("e")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("f").isNull() | inside, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"))
        if step % 4 == 3:
            s = stored(s)
    return s.select("sid", "n", "lo")


def zfast_trie(seqs: DataFrame, paths: DataFrame) -> DataFrame:
    """Compacted nodes ``key, e, p, pkey, ref`` of distinct conversations; ``ref`` is one whose path holds the extent.

    ``seqs`` has ``sid, n`` and ``paths`` the rows ``sid, d, key`` of their prefixes from d = 0 on. The
    root has e = 0 and no parent. Loops over batches; every batch is written.
    """
    spark = seqs.sparkSession
    longest = seqs.agg(F.max("n")).first()[0] or 0
    bits = int(longest).bit_length()
    shape = "key string, e long, p long, pkey string, ref long, f long, fkey string, ckey string"
    trie = stored(spark.createDataFrame([], shape))
    out = stored(seqs.filter("n > 0").select("sid", "n", F.lit(0).cast("long").alias("lo")))
    while out.limit(1).count():
        found = stored(_locate(out, trie, paths, bits))
        on = lambda d, k: paths.select("sid", F.col("d").alias(d), F.col("key").alias(k))
        # the edge below the extent that begins with the conversation's next turn
        below = found.filter("lo < n").withColumn("c", F.col("lo") + 1).join(on("c", "ckey"), ["sid", "c"])
        edge = trie.select("ckey", "key", "e", "ref")
        below = below.join(edge, "ckey", "left").select("sid", "n", "lo", "key", "e", "ref")
        # how far path and edge agree
        theirs = paths.select(F.col("sid").alias("ref"), F.col("d"), F.col("key").alias("k"))
        mine = paths.select("sid", "d", F.col("key").alias("k"))
        met = below.filter("key IS NOT NULL").join(mine, "sid").filter("d > lo AND d < e")
        depth = met.join(theirs, ["ref", "d", "k"]).groupBy("sid").agg(F.max("d").alias("x"))
        left = stored(below.join(depth, "sid", "left").withColumn("x", F.coalesce("x", "lo")).join(on("x", "xkey"), ["sid", "x"]))
        nxt = left.filter("x < n").withColumn("c", F.col("x") + 1).join(on("c", "next"), ["sid", "c"])
        chosen = nxt.groupBy("next").agg(F.min_by(F.struct("sid", "n", "x", "xkey"), F.struct(F.xxhash64("sid"), F.col("sid"))).alias("b")).select("b.*")
        chosen = stored(chosen)
        leaf = chosen.join(on("n", "key"), ["sid", "n"]).select("key", F.col("n").alias("e"), F.col("x").alias("p"), F.col("xkey").alias("pkey"), F.col("sid").alias("ref"))
        # split edges: each stretch between cuts is a node, the last one is the old node
        cuts = left.filter("x > lo").select("key", "x", "xkey").distinct()
        old = trie.select("key", "e", "p", "pkey", "ref").join(cuts.select("key").distinct(), "key", "left_semi")
        ends = cuts.unionByName(old.select("key", F.col("e").alias("x"), F.col("key").alias("xkey")))
        w = Window.partitionBy("key").orderBy("x")
        ends = ends.withColumns({"p0": F.lag("x").over(w), "pkey0": F.lag("xkey").over(w)})
        parts = ends.join(old.select("key", "p", "pkey", "ref"), "key").select(
            F.col("xkey").alias("key"), F.col("x").alias("e"), F.coalesce("p0", "p").alias("p"), F.coalesce("pkey0", "pkey").alias("pkey"), "ref")
        new = _filed(leaf.unionByName(parts), paths)
        trie = stored(trie.join(old.select("key"), "key", "left_anti").unionByName(new.select(*trie.columns)))
        # in the trie are those that ended at an extent or a cut, and the chosen ones
        rest = left.filter("x < n").join(chosen.select("sid"), "sid", "left_anti")
        out = stored(rest.select("sid", "n", F.col("x").alias("lo")))
    root = spark.createDataFrame([("", 0, None, None, None)], "key string, e long, p long, pkey string, ref long")
    return trie.select("key", "e", "p", "pkey", "ref").unionByName(root)


# --- measures and edges ---------------------------------------------------------------------

def subtree(nodes: DataFrame, sums: list[str], mins: list[str]) -> DataFrame:
    """``key`` with sums and minima over all nodes below and including each, by doubling: as many rounds as the height has bits."""
    s = stored(nodes.select("key", F.col("pkey").alias("anc"), *sums, *mins))
    while s.filter("anc IS NOT NULL").limit(1).count():
        up = s.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("key")).agg(
            *[F.sum(c).alias(f"u_{c}") for c in sums], *[F.min(c).alias(f"u_{c}") for c in mins])
        far = s.select(F.col("key").alias("anc"), F.col("anc").alias("far"))
        s = stored(s.join(up, "key", "left").join(far, "anc", "left").select(
            "key", F.col("far").alias("anc"), *[(F.col(c) + F.coalesce(f"u_{c}", F.lit(0))).alias(c) for c in sums], *[F.least(c, f"u_{c}").alias(c) for c in mins]))
    return s.drop("anc")


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of comma-joined pieces per key; rows come sorted by key and piece number."""
    key, digest = None, None
    for batch in batches:
        keys, hexes = [], []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if k == key:
                digest.update(b"," + piece.encode())
                continue
            if digest is not None:
                keys.append(key)
                hexes.append(digest.hexdigest())
            key, digest = k, hashlib.sha256(piece.encode())
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "ends": pa.array(hexes, pa.string())})
    if digest is not None:
        yield pa.record_batch({"key": pa.array([key], pa.string()), "ends": pa.array([digest.hexdigest()], pa.string())})


def ends_digests(members: DataFrame) -> DataFrame:
    """``key, ends``: digest of the ids that end at a node. Ids are packed into chunks of a bounded range, chunks are streamed in order."""
    chunk = F.expr(f"conv_id div {CHUNK}")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = members.groupBy("key", chunk.alias("chunk")).agg(ids.alias("piece"))
    return pieces.repartition("key").sortWithinPartitions("key", "chunk").select("key", "piece").mapInArrow(_streamed_digests, "key string, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A null role or text counts as empty, rows without conv_id are left out, equal turn numbers are
    ordered by role and text, repeated rows are turns of their own. Other columns
    do not matter. Conversations without turns end at the root; an empty table has no rows. The
    digest of a node's ids is a single stream by its nature, its memory is bounded.
    """
    ids, turns = rebuilt(conversations)
    every = stored(prefixes(ids, turns))
    full = stored(every.groupBy("conv_id").agg(F.max("d").alias("n"), F.max_by("key", "d").alias("key")))
    here = stored(full.groupBy("key", "n").agg(F.min("conv_id").alias("sid"), F.count(F.lit(1)).alias("n_here")))
    paths = stored(every.join(here.select(F.col("sid").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "sid"))
    nodes = stored(zfast_trie(here.select("sid", "n"), paths))
    kids = nodes.filter("pkey IS NOT NULL").groupBy(F.col("pkey").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    none = F.lit(None).cast("long")
    own = nodes.join(here.select("key", "sid", "n_here"), "key", "left").join(kids, "key", "left").select(
        "key", "pkey", "e", "p", "ref", F.coalesce("kids", F.lit(0)).cast("long").alias("kids"), F.coalesce("n_here", F.lit(0)).alias("n_convs"),
        F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), F.coalesce("sid", none).alias("conv_id"))
    own = stored(own)
    sums = subtree(own, ["n_convs", "n_leaves"], ["conv_id"])
    words = lambda d, name: paths.select(F.col("sid").alias("ref"), F.col("d").alias(d), F.col("words").alias(name))
    full_nodes = own.select("key", "pkey", "e", "p", "ref", "kids").join(sums, "key").join(words("e", "we"), ["ref", "e"], "left").join(words("p", "wp"), ["ref", "p"], "left")
    full_nodes = stored(full_nodes.withColumn("own", F.coalesce((F.col("n_convs") - 1) * (F.col("we") - F.col("wp")), F.lit(0).cast("long"))))
    saved = subtree(full_nodes.withColumn("saved", F.col("own")), ["saved"], [])
    parent = full_nodes.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent_id"))
    tree = full_nodes.join(saved, "key").join(ends_digests(full), "key", "left").join(parent, "pkey", "left").filter("n_convs > 0")
    # edges become one row a depth, in blocks so that a long edge is no long array
    block = F.explode(F.expr(f"sequence((p + 1) div {CHUNK}, e div {CHUNK})"))
    deep = tree.filter("p IS NOT NULL").withColumn("block", block)
    deep = deep.withColumn("depth", F.explode(F.sequence(F.greatest(F.col("p") + 1, F.col("block") * CHUNK), F.least("e", F.col("block") * CHUNK + CHUNK - 1))))
    deep = deep.withColumn("above", F.col("depth") - 1).join(words("above", "wa"), ["ref", "above"])
    last = F.col("depth") == F.col("e")
    nothing = hashlib.sha256(b"").hexdigest()
    deep = deep.select(
        "conv_id", "depth", F.when(F.col("above") == F.col("p"), F.col("parent_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("kids")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("own") + (F.col("n_convs") - 1) * (F.col("we") - F.col("wa"))).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(nothing)).alias("ends_sha256"))
    root = tree.filter("p IS NULL").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))
    return root.unionByName(deep)


CHECK = """WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,'')) AS i,
  {'r': coalesce(role,''), 't': coalesce(text,'')} AS x FROM conversations WHERE conv_id IS NOT NULL),
 tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
 ids AS (SELECT c, c - c % 20 AS b, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ord(substring(c::VARCHAR, k, 1))::BIGINT),
   lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM o), tab),
 re AS (SELECT ids.c, o.i AS k, o.x FROM ids JOIN o ON o.c = ids.b AND (o.i <= ids.h OR ids.b = ids.c)
  UNION ALL SELECT ids.c, 1000000 + o.i, o.x FROM ids JOIN o ON o.c = ids.c AND o.i > ids.h AND ids.b <> ids.c),
 q AS (SELECT ids.c, coalesce(l, []) AS l FROM ids LEFT JOIN (SELECT c, list(x ORDER BY k) AS l FROM re GROUP BY c) USING (c)),
 m AS (SELECT c, l, d, l[1:d] AS k FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM q)),
 n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs FROM m GROUP BY d, k),
 kids AS (SELECT k[1:d-1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
 f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(k[d].t, '[ \\t-\\r]+'), lambda w: w <> '')) END AS own
  FROM n LEFT JOIN kids USING (k)),
 sub AS (SELECT k[1:j] AS k, sum(own) AS saved, sum((n_children = 0)::INT) AS leaves FROM (SELECT k, own, n_children, unnest(range(0, d + 1)) AS j FROM f) GROUP BY 1),
 e AS (SELECT l AS k, string_agg(c::VARCHAR, ',' ORDER BY c) AS s FROM q GROUP BY 1)
 SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
 FROM f JOIN sub USING (k) LEFT JOIN e USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.k[1:f.d-1]"""


@query("op12_conversation_trie", CHECK)
def trie_q(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
