"""Language-model scoring with a weighted backoff automaton.

States are the root, the start of a text, every word and, up to ``order`` - 1 words, every
sequence seen in training. A state has explicit arcs for the words that followed it in training
and one failure arc to the state without its first word, at last to the root, whose arcs are
the smoothed single words. With discount D, history h, h' without its first word, and word w

    p(w | h)    = (c(h w) - D) / c(h) + fail(h) * p(w | h')     for kept arcs (c(h w) >= min_count)
    fail(h)     = 1 - sum over kept arcs of (c(h w) - D) / c(h)
    otherwise     fail(h) * p(w | h')

so every state is a distribution; a history never seen fails with weight one. Texts are cut into
chunks with a list of their own distinct words. The distinct sequences of a chunk go by hash to
buckets, which add up the counts of all chunks and answer each block of hashes with a block of
totals. Longest sequences go first: their totals give each chunk its part of the kept mass of
their histories, which is added up when the histories are counted. Each chunk then walks its
texts from left to right, the state being the last ``order`` - 1 words read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.llm import bloom, query
from threadgraph.llm.common import discard, stored, table

CHUNK_TOKENS = 1_500_000
ADD, DISCOUNT, MIN_COUNT, ORDER = 0.1, 0.75, 1, 3
#: Parts into which the sequences of a length are dealt by hash; each is added up in memory.
BUCKETS = 1024
#: Names of the start state and of the end token; words have no blanks, so neither is a word.
START, END = " start", " end"


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 10; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    values = values.astype(kind)
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return planes.T.copy().view(kind).ravel()


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: ids, held-out flags, token counts, codes (start, words, end of each text), words, training counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {START: 0, END: 1}
        ids, flags, sizes, codes, total, id_type = [], [], [], [], 0, None

        def row():
            counts = np.zeros(len(words), np.int64)
            for f, c in zip(flags, codes):
                if not f:
                    counts += np.bincount(c, minlength=len(words)) if len(c) > len(words) // 8 else _sparse(c, len(words))
            names = [w if isinstance(w, str) else w.decode("utf-8", "surrogatepass") for w in words]
            return pa.RecordBatch.from_arrays([
                pa.array([random.getrandbits(62)], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([flags], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([pack(np.concatenate(codes))], pa.binary()), pa.array([names], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                ["chunk", "doc_ids", "flags", "sizes", "codes", "words", "counts"])

        for b in batches:
            id_type = b.schema.field("doc_id").type
            for i, f, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text")):
                text = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                code = [0]
                code += [words.setdefault(w, len(words)) for w in text]
                code.append(1)
                ids.append(i)
                flags.append(f)
                sizes.append(len(code))
                codes.append(np.array(code, np.uint32))
                total += len(code)
                if total >= CHUNK_TOKENS:
                    yield row()
                    words = {START: 0, END: 1}
                    ids, flags, sizes, codes, total = [], [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(cut, f"chunk bigint, doc_ids array<{kind}>, flags array<boolean>, sizes array<int>, codes binary, words array<string>, counts array<bigint>")


def _sparse(c: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, c, 1)
    return out


class _Level(NamedTuple):
    """Distinct sequences of one length in a chunk: history (number among those one shorter) and last word, number without
    the first word, hash, count in training texts; ``place`` is the number of the sequence that ends at a position, or -1."""

    hist: np.ndarray
    last: np.ndarray
    suffix: np.ndarray
    key: np.ndarray
    own: np.ndarray
    place: np.ndarray


def _levels(codes: np.ndarray, sizes: np.ndarray, flags: np.ndarray, keys: np.ndarray, order: int) -> dict[int, _Level]:
    """Sequences of 2 to ``order`` words inside texts, by length."""
    n = len(keys)
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    training = ~np.repeat(flags, sizes)
    place, key, out = codes.astype(np.int64), keys, {}
    for k in range(2, order + 1):
        at = np.flatnonzero(offset >= k - 1)
        values, where = np.unique(place[at - 1] * n + codes[at], return_inverse=True)
        hist, last = values // n, values % n
        suffix = np.empty(len(values), np.int64)
        suffix[where] = place[at]
        own = np.bincount(where, training[at], len(values)).astype(np.int64)
        key = bloom.mix(key[hist] * np.uint64(0x9E3779B97F4A7C15) + keys[last])
        place = np.full(len(codes), -1, np.int64)
        place[at] = where
        out[k] = _Level(hist, last, suffix, key, own, place)
    return out


def _dealt(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences in the order of their buckets, and where each bucket begins."""
    bucket = (key % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(BUCKETS + 1))


def _answers(b: pa.RecordBatch, r: int, column: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals of a chunk's sequences over all chunks: count in training, kept mass as a history."""
    n, mass = np.zeros(len(key), np.int64), np.zeros(len(key))
    got = b.column(column)[r].values
    if got is not None and len(got):
        order, cuts = _dealt(key)
        for bucket, x, y in zip(got.field("bucket").to_pylist(), got.field("n").to_pylist(), got.field("mass").to_pylist()):
            here = order[cuts[bucket]:cuts[bucket + 1]]
            n[here] = unpack(x, "<i8")
            mass[here] = unpack(y, "<f8")
    return n, mass


def _history_mass(level: _Level, n: np.ndarray, min_count: int, size: int) -> np.ndarray:
    """Kept mass of histories as far as this chunk's texts make it: an arc's (c - D) is shared out over its c occurrences."""
    kept = (n >= min_count) & (level.own > 0)
    return np.bincount(level.hist[kept], level.own[kept] * (1 - DISCOUNT / n[kept]), size)


def _read(b: pa.RecordBatch, r: int):
    words = b.column("words")[r].values
    return words, unpack(b.column("codes")[r].as_py()), np.array(b.column("sizes")[r].as_py(), np.int64), np.array(b.column("flags")[r].as_py(), bool)


def _keys(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def totals(cut: DataFrame, k: int, order: int, min_count: int) -> DataFrame:
    """``chunk, gK``: for each chunk the totals of its sequences of ``k`` words, bucket by bucket. ``cut`` has those of ``k`` + 1 below ``order``."""
    def emit(batches):
        for b in batches:
            for r in range(b.num_rows):
                words, codes, sizes, flags = _read(b, r)
                levels = _levels(codes, sizes, flags, _keys(words), min(k + 1, order))
                level = levels[k]
                mass = np.zeros(len(level.key))
                if k < order:
                    longer = levels[k + 1]
                    mass = _history_mass(longer, _answers(b, r, f"g{k + 1}", longer.key)[0], min_count, len(level.key))
                by, cuts = _dealt(level.key)
                some = np.flatnonzero(np.diff(cuts))
                part = [by[cuts[x]:cuts[x + 1]] for x in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), b.column("chunk")[r].as_py(), np.int64)), pa.array(some.astype(np.int32)), pa.array([level.key[x].tobytes() for x in part], pa.binary()),
                    pa.array([pack(level.own[x]) for x in part], pa.binary()), pa.array([pack(mass[x], "<f8") for x in part], pa.binary())], ["chunk", "bucket", "keys", "n", "mass"])

    def add(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([unpack(x) for x in t.column("n").to_pylist()]))[at]
        mass = np.bincount(at, np.concatenate([unpack(x, "<f8") for x in t.column("mass").to_pylist()]))[at]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        return pa.table([t.column("chunk"), t.column("bucket"), pa.array([pack(x, "<i8") for x in np.split(n, ends)], pa.binary()), pa.array([pack(x, "<f8") for x in np.split(mass, ends)], pa.binary())],
                        ["chunk", "bucket", "n", "mass"])

    blocks = cut.mapInArrow(emit, "chunk bigint, bucket int, keys binary, n binary, mass binary")
    out = stored(blocks.groupBy("bucket").applyInArrow(add, "chunk bigint, bucket int, n binary, mass binary"))
    return out.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "mass")).alias(f"g{k}"))


def word_mass(cut: DataFrame, min_count: int) -> DataFrame:
    """``word, mass``: kept mass of the states of one word; ``cut`` has ``g2``."""
    def weigh(batches):
        for b in batches:
            for r in range(b.num_rows):
                words, codes, sizes, flags = _read(b, r)
                level = _levels(codes, sizes, flags, _keys(words), 2)[2]
                mass = _history_mass(level, _answers(b, r, "g2", level.key)[0], min_count, len(words))
                some = np.flatnonzero(mass > 0)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(mass[some])], ["word", "mass"])

    return cut.mapInArrow(weigh, "word string, mass double").groupBy("word").agg(F.sum("mass").alias("mass"))


def score_texts(docs: DataFrame, min_count: int = MIN_COUNT, order: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Training texts are those not held out; counts cover all of them. ``base_score`` sums the
    smoothed single words, ``score`` is the automaton's log10 probability of the text and its
    end. A null or empty text is its end alone; repeated rows count as often as they occur.
    States hold up to ``order`` - 1 words (``order`` is 2 or more).
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    cut = stored(chunks(docs))
    listed = cut.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    words = stored(listed.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"))
    # the start is a state, not a token
    total = words.filter(F.col("word") != START).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v_train = int(total["n"]), int(total["v"])
    bare = cut.drop("counts", "doc_ids")
    found = {}
    for k in range(order, 1, -1):
        found[k] = totals(bare.join(found[k + 1], "chunk", "left") if k < order else bare, k, order, min_count)
    full = stored(words.join(word_mass(bare.join(found[2], "chunk", "left"), min_count), "word", "left").select("word", "c", F.coalesce("mass", F.lit(0.0)).alias("mass")))
    discard(words)
    own = cut.select("chunk", F.posexplode("words").alias("at", "word"))
    known = stored(own.join(full, "word").groupBy("chunk").agg(F.collect_list(F.struct("at", "c", "mass")).alias("known")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    space = n_train + ADD * (v_train + 1)

    def walk(batches):
        for b in batches:
            for r in range(b.num_rows):
                words, codes, sizes, flags = _read(b, r)
                c, mass = np.zeros(len(words)), np.zeros(len(words))
                got = b.column("known")[r].values
                if got is not None and len(got):
                    at = got.field("at").to_numpy(zero_copy_only=False)
                    c[at] = got.field("c").to_numpy(zero_copy_only=False)
                    mass[at] = got.field("mass").to_numpy(zero_copy_only=False)
                uni = (c + ADD) / space
                fail = 1 - np.divide(mass, c, out=np.zeros(len(words)), where=c > 0)
                # the state before a token is the words before it: its arc where there is one, and its failure to the shorter state
                p, times, step = uni, c, np.zeros(len(codes))
                for k, level in _levels(codes, sizes, flags, _keys(words), order).items():
                    n, longer_mass = _answers(b, r, f"g{k}", level.key)
                    arc = np.divide(n - DISCOUNT, times[level.hist], out=np.zeros(len(n)), where=n >= min_count)
                    p = arc + fail[level.hist] * p[level.suffix]
                    times, fail = n, 1 - np.divide(longer_mass, n, out=np.zeros(len(n)), where=n > 0)
                    some = level.place >= 0
                    step[some] = np.log10(p)[level.place[some]]
                begin = np.cumsum(sizes) - sizes
                tokens = np.ones(len(codes), bool)
                tokens[begin] = False
                second = codes[tokens]
                starts = np.cumsum(sizes - 1) - (sizes - 1)
                per_text = lambda x: np.add.reduceat(x, starts) if len(x) else np.empty(0)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_ids")[r].values, pa.array(flags), pa.array(sizes - 1), pa.array(per_text((c[second] > 0).astype(np.int64)), pa.int64()),
                    pa.array(per_text(np.log10(uni)[second])), pa.array(per_text(step[tokens]))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    ready = cut.drop("counts").join(known, "chunk", "left")
    for k in found:
        ready = ready.join(found[k], "chunk", "left")
    out = ready.mapInArrow(walk, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_train).cast("long"))


@query("op10_backoff_scores")
def lm_q(spark, sf_dir):
    out = score_texts(table(spark, sf_dir, "documents"), order=ORDER)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
