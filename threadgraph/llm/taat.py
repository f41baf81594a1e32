"""Ranked lexical search, a term at a time with limited accumulators.

The index is one row per document: its length and the counts of those of its words that
occur in a query. Accumulators (query, partial score) are kept in the row of their
document, so no contribution is ever shuffled. Terms are taken rarest first, in steps of
document frequency for all queries of a block together; a step is one pass over the rows,
which drops the postings it used up. Each query knows its k-th highest partial score and, for
each class of document lengths, the most that its remaining terms can add. Once that is less than
the k-th partial score no accumulator is made in that class any more; those there are go
on taking terms exactly, unless they, too, can no longer reach the k-th score.

Scores are whole numbers throughout, so partial sums in any order agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadgraph.llm import bloom, query
from threadgraph.llm.common import discard, stored, table

#: What separates terms: ASCII but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Document frequency up to which the first step goes, and the factor from step to step; texts handled at a time.
FIRST_STEP, STEP, ROWS = 64, 4, 500
#: (query, term) pairs handled at a time, and documents a query asks for.
BLOCK, K = 200_000, 50


def terms(text: Column) -> Column:
    """Distinct terms of a text; a null text has none."""
    return F.array_remove(F.array_distinct(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS)), "")


def _counts(bitmap):
    """Per text its number of terms, and (term, count) of those that a query may hold."""

    def one(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        split = pc.split_pattern_regex(pc.ascii_lower(texts), GAPS)
        row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        words = split.flatten().dictionary_encode()
        code, names = words.indices.to_numpy(), words.dictionary.to_pylist()
        keys = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in names], np.uint64)
        real = np.array([w != "" for w in names], bool)
        n = np.bincount(row[real[code]], minlength=len(texts))
        wanted = bloom.may_hold(bitmap.value, keys) & real
        hit = wanted[code]
        pair, count = np.unique(row[hit] * len(names) + code[hit], return_counts=True)
        ends = np.searchsorted(pair, np.arange(len(texts) + 1) * len(names))
        flat = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(pair % len(names) if len(names) else pair)), pa.array(count.astype(np.int64))], ["term", "tf"])
        return n, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                n, posted = one(b.column("text"))
                yield pa.record_batch({"rid": b.column("rid"), "doc_id": b.column("doc_id"), "n": pa.array(n.astype(np.int64)), "posted": posted})
    return run


def index(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rid, doc_id, n, posted`` of every row with terms; ``posted`` lists (term, tf) for terms of ``wanted`` and perhaps a few more.

    A Bloom filter of fixed size spares terms that no query holds; joins on the term itself follow.
    """
    bitmap = bloom.build(wanted.select(F.xxhash64("term").alias("h")), "h")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shape = "rid long, doc_id long, n long, posted array<struct<term: string, tf: long>>"
    return stored(rows.mapInArrow(_counts(bitmap), shape).filter("n > 0"))


def _kth(state: DataFrame, floor: list[int], k: int) -> dict[int, int]:
    """The k-th highest partial score of each query that has so many; only sums from its last one on can matter."""
    at_least = F.element_at(F.array(*[F.lit(int(x)) for x in floor]), F.col("item") + 1)
    w = Window.partitionBy("item").orderBy(F.col("score").desc())
    high = state.select(F.inline("accs")).filter(F.col("score") >= at_least).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    found = high.groupBy("item").agg(F.min("score").alias("kth"), F.max("_r").alias("n")).filter(F.col("n") == k).collect()
    return {r["item"]: r["kth"] for r in found}


STATE = "rid long, doc_id long, m long, len int, posted array<struct<term: string, tf: long>>, accs array<struct<item: int, score: long>>"


def _take_terms(plan):
    """One step on documents and their accumulators: add the terms that are due, make new accumulators where that
    is still allowed, drop those that cannot reach the k-th score. ``plan`` is the broadcast block of queries."""

    def one(b: pa.RecordBatch, p: dict) -> pa.RecordBatch:
        posted, accs, m, cls = b.column("posted"), b.column("accs"), b.column("m").to_numpy(), b.column("len").to_numpy()
        rows = len(m)
        of = lambda col: np.repeat(np.arange(rows), np.diff(col.offsets.to_numpy()))
        prow, pairs = of(posted), posted.flatten()
        names = pairs.field("term").dictionary_encode()
        lookup = np.array([p["number"].get(w, -1) for w in names.dictionary.to_pylist()] + [-1], np.int64)
        term, tf = lookup[names.indices.to_numpy()], pairs.field("tf").to_numpy()
        due = (term >= p["first"]) & (term < p["next"])
        # every due posting meets the queries that hold its term
        t, r = term[due], prow[due]
        part = 1_000_000_000 * tf[due] // (1000 * tf[due] + 20 * m[r])
        n = p["starts"][t + 1] - p["starts"][t]
        at = np.repeat(p["starts"][t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = p["live"].shape[0]
        item = p["items"][at].astype(np.int64)
        row = np.repeat(r, n)
        add_key, add = row * width + item, np.repeat(part, n) * p["weights"][at]
        had = accs.flatten()
        had_key = of(accs) * width + had.field("item").to_numpy()
        may = p["live"][item, cls[row]] | np.isin(add_key, had_key)
        key = np.concatenate([had_key, add_key[may]])
        value = np.concatenate([had.field("score").to_numpy(), add[may]])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        score = np.add.reduceat(value, first) if len(key) else value
        key = key[first]
        item, row = key % width, key // width
        able = score + p["rest"][item, cls[row]] >= p["kth"][item]
        item, row, score = item[able], row[able], score[able]
        ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
        new = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(item.astype(np.int32)), pa.array(score)], ["item", "score"]))
        later = term >= p["next"]
        ends = np.searchsorted(prow[later], np.arange(rows + 1)).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(ends), pairs.filter(pa.array(later)))
        return pa.record_batch({"rid": b.column("rid"), "doc_id": b.column("doc_id"), "m": b.column("m"), "len": b.column("len"), "posted": rest, "accs": new})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                # a copy: offsets of a slice do not start at 0
                yield one(batch.take(pa.array(np.arange(at, min(at + ROWS, batch.num_rows)))), plan.value)
    return run


def _rank_block(docs: DataFrame, pairs: list, best: list, k: int) -> DataFrame:
    """``item, rid, doc_id, score`` of what may be a query's ``k`` best, with exact scores; ``item`` is a number in the block.

    ``pairs`` are (item, term, df, w) and ``best`` (term, class, largest contribution before the weight).
    """
    spark = docs.sparkSession
    order = sorted({(df, term) for _, term, df, _ in pairs})
    number = {term: i for i, (_, term) in enumerate(order)}
    dfs = np.array([df for df, _ in order], np.int64)
    pairs = sorted((number[term], item, w) for item, term, _, w in pairs)
    n_items, n_len = max(p[1] for p in pairs) + 1, max((c for _, c, _ in best), default=0) + 1
    top = np.zeros((len(order), n_len), np.int64)
    for term, c, x in best:
        if term in number:
            top[number[term], c] = x
    term_of, items, weights = (np.array(x, np.int64) for x in zip(*pairs))
    starts = np.searchsorted(term_of, np.arange(len(order) + 1))
    rest = np.zeros((n_items, n_len), np.int64)
    np.add.at(rest, items, weights[:, None] * top[term_of])
    kth, live = np.zeros(n_items, np.int64), np.ones((n_items, n_len), bool)
    state, done, upto = docs.withColumn("accs", F.array().cast("array<struct<item: int, score: long>>")), 0, FIRST_STEP
    while done < len(order):
        open_terms = np.flatnonzero(live.any(axis=1)[items] & (term_of >= done))
        if len(open_terms):
            while upto < dfs[term_of[open_terms[0]]]:
                upto *= STEP
            nxt = int(np.searchsorted(dfs, upto, "right"))
        else:
            nxt = len(order)  # survivors take all that is left
        now = (term_of >= done) & (term_of < nxt)
        np.subtract.at(rest, items[now], weights[now, None] * top[term_of[now]])
        plan = spark.sparkContext.broadcast({"number": number, "first": done, "next": nxt, "starts": starts, "items": items, "weights": weights, "live": live.copy(), "rest": rest.copy(), "kth": kth.copy()})
        new = stored(state.mapInArrow(_take_terms(plan), STATE))
        if done:
            discard(state)
        state, done = new, nxt
        for i, x in _kth(state, kth.tolist(), k).items():
            kth[i] = x
        live &= (rest > 0) & (rest >= kth[:, None])
    at_least = F.element_at(F.array(*[F.lit(int(x)) for x in kth]), F.col("item") + 1)
    return state.select("rid", "doc_id", F.inline("accs")).filter((F.col("score") >= at_least) & (F.col("score") > 0))


def search(docs: DataFrame, queries: DataFrame, k: int = K, query_id: str = "item_id") -> DataFrame:
    """``query_id, rank, doc_id, score``: each query's ``k`` best documents with a score above 0.

    Every row of ``docs`` is a document, repeated rows, too; equal scores go by ascending
    doc_id, null ids last. A null or empty text has no terms; a query without terms that
    occur has no row, and neither has an empty table. Queries are rows; equal query ids with
    different texts are ranked as one query that holds the terms of both. Columns with
    other names do not matter. Queries are taken in blocks of about ``BLOCK`` (query, term)
    pairs, which bounds what the driver and the tasks hold of them. The loop runs Spark
    jobs while the plan is built.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(query_id).cast("string")), F.lit("null"))
    names = queries.select(name.alias("item"), F.col(query_id)).distinct()
    asked = stored(queries.select(name.alias("item"), F.explode(terms(F.col("text"))).alias("term")).distinct())
    base = index(docs, asked.select("term").distinct())
    total = base.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = total["N"], total["L"] or 1
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L")
    # length classes double; a class's bound holds for all its documents
    rows = base.select("rid", "doc_id", m.alias("m"), F.floor(F.log2("n")).cast("int").alias("len"), "posted")
    part = F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")
    seen = rows.select("rid", "m", "len", F.inline("posted")).join(asked.select("term").distinct(), "term").groupBy("term", "len").agg(F.count(F.lit(1)).alias("n"), F.max(part).alias("best"))
    seen = stored(seen)
    df = seen.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    blocks = max(1, -(-asked.count() // BLOCK))
    todo = stored(asked.join(df.select("term", "df", weight.alias("w")), "term").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))))
    out = None
    for block in range(blocks):
        mine = todo.filter(F.col("block") == block)
        pairs = mine.select("item", "term", "df", "w").collect()
        if not pairs:
            continue
        items = sorted({r["item"] for r in pairs})
        numbers = {x: i for i, x in enumerate(items)}
        best = [tuple(r) for r in seen.join(mine.select("term").distinct(), "term", "left_semi").select("term", "len", "best").collect()]
        found = _rank_block(rows, [(numbers[r["item"]], r["term"], r["df"], r["w"]) for r in pairs], best, k)
        labels = F.element_at(F.array(*[F.lit(x) for x in items]), F.col("item") + 1)
        found = found.withColumn("item", labels)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.limit(0).select("rid", "doc_id", F.lit("").alias("item"), F.lit(0).cast("long").alias("score"))
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "rid")
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(names, "item").select(query_id, "rank", "doc_id", "score")


_TERMS = f"regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
CHECK = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
 t AS (SELECT r, doc_id, unnest(ts) AS term FROM d), n AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY ALL),
 tot AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM n), f AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL),
 q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
 w AS (SELECT term, floor(1000*ln((2*nd+2)::DOUBLE/(2*count(*)+1)))::BIGINT AS w FROM f, tot WHERE term IN (SELECT term FROM q) GROUP BY term, nd),
 s AS (SELECT item_id, doc_id, r, sum(w * ((1000000000*tf) // (1000*tf + 20*(50 + (50*n.n*nd) // nt))))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (r), tot GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, r)::INTEGER AS rank FROM s WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""


@query("op11_ranked_search", CHECK)
def search_q(spark, sf_dir):
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
