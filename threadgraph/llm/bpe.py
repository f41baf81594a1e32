"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words and the distinct words counted with a shuffle; each distinct
   word is then encoded once: the *word table* (word, n, ids).
2. Texts are split again into chunks of a few hundred thousand words. A chunk is one row:
   its own list of distinct words and, for each document, the positions in that list.
3. The chunk's words are joined to the word table, their ids return to the chunk by position,
   and the documents of the chunk are put together. The most frequent words (``hot_words``, a
   fixed number of rows) are handed to every task instead, so a word that stands in every
   chunk makes no hot key; all other words go through the join.
4. Decoding looks each id up in the id-to-piece table, which has the vocabulary's fixed size,
   so that join needs no shuffle inside the chunk tasks; ``decode`` is the same for any table of ids.
"""

from __future__ import annotations

import json
import random
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgraph.llm import query
from threadgraph.llm.common import stored, table

CHUNK_WORDS = 750_000
HOT_WORDS = 200_000

# The normaliser and splitter that the vocabulary file names.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=2)
def _settings(path: str):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {i: p for p, i in special.items()}
    at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
    return special, at, [pieces.get(i, "") for i in range(max(pieces) + 1)]


def split_words(text: str, special_at) -> list[str]:
    """Words as the tokenizer's normaliser and splitter make them; control tokens stay whole.

    Lower case is taken character by character, so a final sigma is not special.
    """
    out: list[str] = []
    for k, part in enumerate(special_at.split(text) if special_at else [text]):
        if k % 2:
            out.append(part)
        elif part:
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += _SPLIT.findall(low)
    return out


def _texts(batches: Iterator[pa.RecordBatch], path: str):
    special_at = _settings(path)[1]
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
            yield i, split_words(t.as_py() or "", special_at)


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """``word, n, ids``: every distinct word of all texts, encoded once (ids: little-endian 32 bit)."""
    def count(batches):
        seen: Counter = Counter()
        size = 0
        for _, words in _texts(batches, path):
            seen.update(words)
            size += len(words)
            if size >= 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen, size = Counter(), 0
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def encode(batches):
        from tokenizers import Tokenizer, pre_tokenizers

        special = _settings(path)[0]
        model = Tokenizer.from_file(path).model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        for b in batches:
            ids = []
            for w in b.column("word").to_pylist():
                if w in special:
                    got = [special[w]]
                else:
                    got = [t.id for piece, _ in to_bytes(w) for t in model.tokenize(piece)]
                ids.append(np.array(got, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    counted = docs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "word string, n bigint, ids binary")


def chunks(docs: DataFrame, path: str, hot) -> DataFrame:
    """One row per chunk: documents as positions in [words of ``hot``] + [the chunk's other words].

    ``hot`` is a broadcast Arrow table of words; its size is fixed by the caller.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        known = {w: k for k, w in enumerate(hot.value.column("word").to_pylist())}
        start = len(known)
        own: dict[str, int] = {}
        ids, sizes, codes, total = [], [], [], 0

        def row():
            flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
            planes = flat.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()  # bytes of one weight together
            return pa.RecordBatch.from_arrays([
                pa.array([random.getrandbits(62)], pa.int64()), pa.array([ids], pa.list_(doc_type)), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([zlib.compress(planes.tobytes(), 1)], pa.binary()), pa.array([list(own)], pa.list_(pa.string()))],
                ["chunk", "doc_ids", "sizes", "codes", "words"])

        doc_type = None
        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for i, words in _texts([b], path):
                code = [start + own.setdefault(w, len(own)) if c is None else c for w, c in zip(words, map(known.get, words))]
                ids.append(i)
                sizes.append(len(words))
                codes.append(np.array(code, np.uint32))
                total += len(words) + 50
                if total >= CHUNK_WORDS:
                    yield row()
                    own, ids, sizes, codes, total = {}, [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(cut, f"chunk bigint, doc_ids array<{kind}>, sizes array<int>, codes binary, words array<string>")


def encode_decode(docs: DataFrame, path: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row of ``docs`` (``doc_id``, ``text``).

    ``ids`` are packed as little-endian unsigned 32-bit integers. A null or empty text has no
    ids and decodes to an empty text; repeated rows each give a row; other columns are left out.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    words = stored(word_table(docs, path))
    hot = spark.sparkContext.broadcast(words.orderBy(F.desc("n"), "word").limit(hot_words).select("word", "ids").toArrow())
    cut = stored(chunks(docs, path, hot))
    rest = cut.select("chunk", F.posexplode("words").alias("at", "word"))
    found = rest.join(words.select("word", "ids"), "word").groupBy("chunk").agg(F.collect_list(F.struct("at", "ids")).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches):
        pieces = np.array(_settings(path)[2], dtype=object)
        hot_part = hot.value.column("ids").to_pylist()
        hot_len = np.fromiter((len(x) // 4 for x in hot_part), np.int64, len(hot_part))
        hot_flat = np.frombuffer(b"".join(hot_part), "<u4")
        for b in batches:
            for r in range(b.num_rows):
                doc_ids, sizes = b.column("doc_ids")[r], b.column("sizes")[r].as_py()
                got = b.column("found")[r].values
                lens, flat = hot_len, hot_flat
                if got is not None and len(got):
                    order = np.argsort(got.field("at").to_numpy(zero_copy_only=False))
                    own = got.field("ids").take(pa.array(order)).to_pylist()
                    lens = np.concatenate([hot_len, np.fromiter((len(x) // 4 for x in own), np.int64, len(own))])
                    flat = np.concatenate([hot_flat, np.frombuffer(b"".join(own), "<u4")])
                starts = np.concatenate([[0], np.cumsum(lens)])
                raw = zlib.decompress(b.column("codes")[r].as_py())
                codes = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                ids_out, text_out, n_out, at = [], [], [], 0
                for size in sizes:
                    code = codes[at:at + size]
                    at += size
                    n = lens[code]
                    total = int(n.sum())
                    shift = np.repeat(starts[code] - (np.cumsum(n) - n), n)
                    ids = flat[shift + np.arange(total)]
                    ids_out.append(ids.tobytes())
                    text_out.append(" ".join(pieces[ids]))
                    n_out.append(total)
                yield _out(doc_ids.values, n_out, ids_out, text_out)

    return cut.join(found, "chunk", "left").select("doc_ids", "sizes", "codes", "found").mapInArrow(build, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")


def _out(doc_ids, n, ids, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece``: the vocabulary, whose size is fixed by its file."""
    return spark.createDataFrame(list(enumerate(_settings(path)[2])), "id int, piece string")


def decode(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """Decode arrays of ids: each id is joined to its piece, pieces return by position.

    Rows are one per ``key``; an empty or null array decodes to an empty text and an id
    outside the vocabulary to nothing.
    """
    rows = ids.select(key, F.posexplode_outer(column).alias("at", "id"))
    joined = rows.join(F.broadcast(piece_table(ids.sparkSession, path)), "id", "left")
    got = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return joined.groupBy(key).agg(F.array_join(F.transform(got, lambda x: x["piece"]), " ").alias("decoded"))


@query("op4_bpe_roundtrip")
def bpe_q(spark, sf_dir):
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
