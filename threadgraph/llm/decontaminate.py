"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other values keeps
its template. Windows of template tokens are hash-joined between documents and benchmark
items. In an alignment each value of the item must have one value in the document, and a few
words must be plain; otherwise the resemblance is chance. Windows of the
plain lower-case words are joined as well, so a copy that lost its capitals is found too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadgraph.llm import bloom, query
from threadgraph.llm.common import documents, stored, table

WINDOW = 8
#: An alignment counts from this many template tokens on (or the whole of a shorter item).
MIN_TOKENS = 13
#: Plain words that an alignment holds at least, or half of the tokens it needs where that is less.
MIN_PLAIN = 4

UNITS = frozenset("""mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years
meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres
dollar dollars euro euros cent cents usd eur gbp percent % $ € £ °c °f c f k v w a hz pa n j kw mw mph kph""".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*%?")
_JOINED = re.compile(r"([$€£+-]?[0-9][0-9.,:/]*)([^\W\d_]+|[%°]\w*)")
_EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w%°]+$")
_WORD, _NUM, _UNIT, _CAP = range(4)
_MARK = {_NUM: np.uint64(0x9E3779B97F4A7C15), _UNIT: np.uint64(0xC2B2AE3D27D4EB4F), _CAP: np.uint64(0x165667B19E3779F9)}


class _Words(dict):
    """Raw word → its row of value hash, type and end of sentence; -row - 1 where a number and its unit take two rows."""

    def __init__(self):
        self.values, self.types, self.ends = [], [], []

    def __missing__(self, raw: str) -> int:
        bare = _EDGE.sub("", raw)
        end = raw.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":")
        low = bare.lower()
        joined = _JOINED.fullmatch(bare)
        if joined and joined[2].lower() in UNITS:
            at = self._add(joined[1], _NUM, False)
            self._add(joined[2].lower(), _UNIT, end)
            self[raw] = -at - 1
            return -at - 1
        if _NUMBER.fullmatch(bare) or low in NUMBER_WORDS:
            kind = _NUM
        elif low in UNITS:
            kind = _UNIT
        else:
            kind = _CAP if bare[:1].isupper() else _WORD
        self[raw] = at = self._add(low, kind, end)
        return at

    def _add(self, value: str, kind: int, end: bool) -> int:
        self.values.append(xxhash.xxh64_intdigest(value))
        self.types.append(kind if value else -1)
        self.ends.append(end)
        return len(self.values) - 1


class _Templates:
    """Template tokens of texts; words seen before are looked up."""

    def __init__(self):
        self.words, self.size = _Words(), 0
        self.table = [np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)]

    def _rows(self, text: str) -> np.ndarray:
        if len(self.words) > 1_500_000:
            self.words, self.size = _Words(), 0
        raw = text.split()
        at = list(map(self.words.__getitem__, raw))
        if at and min(at) < 0:
            at = [r for a in at for r in ((a,) if a >= 0 else (-a - 1, -a))]
        w = self.words
        if len(w.values) != self.size:
            if len(self.table[0]) < len(w.values):  # grow by doubling
                room = max(1 << 16, 2 * len(w.values))
                self.table = [np.concatenate([t[:self.size], np.zeros(room - self.size, t.dtype)]) for t in self.table]
            for t, new in zip(self.table, (w.values, w.types, w.ends)):
                t[self.size:len(new)] = new[self.size:]
            self.size = len(w.values)
        return np.array(at, np.int64)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, slot type (0: plain word) and value hash of each template token.

        ``plain`` holds the hashes of all words before names were joined.
        """
        at = self._rows(text)
        value, kind, ends = (t[at] for t in self.table) if len(at) else (np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool))
        if (kind < 0).any():  # words of punctuation alone; an end of sentence goes to the word before
            keep = kind >= 0
            value, kind, ends = value[keep], kind[keep], ends[keep]
        plain = value
        after = np.concatenate([[True], ends[:-1]]) if len(ends) else ends
        before_num = np.concatenate([[False], kind[:-1] == _NUM]) if len(kind) else ends
        kind = np.where((kind == _CAP) & after, _WORD, kind)  # a capital that starts a sentence is no name
        kind = np.where((kind == _UNIT) & ~before_num, _WORD, kind)  # a unit follows a number
        name = kind == _CAP
        if name.any():  # a run of names is one slot
            first = ~(name & np.concatenate([[False], name[:-1]]))
            if not first.all():
                starts = np.flatnonzero(first)
                joined = np.add.reduceat(value * np.uint64(31), starts)
                kind = kind[first]
                value = np.where(kind == _CAP, joined, value[first])
        template = value.copy()
        for t, mark in _MARK.items():
            template[kind == t] = mark
        return template, kind, value, plain


def both_windows(tokens, width: int, item: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(form, positions, hashes): form 0 of the plain words, form 1 of the template.

    A document without slots has one form, as its template is its plain words; an item has both.
    """
    template, kind, _, plain = tokens
    out = [(0, *windows(plain, width, 0))]
    if item or (kind != _WORD).any():
        out.append((1, *windows(template, width, 1)))
    return out


def windows(template: np.ndarray, width: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all windows."""
    n = len(template) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x100000001B3) + bloom.mix(template[k:k + n] + np.uint64(k + 1))
    return np.arange(n), bloom.mix(h + np.uint64(2 * width + form))


def _beside_words(ok: np.ndarray, kind: np.ndarray, width: int) -> np.ndarray:
    """``ok`` without runs of windows of slots alone: an alignment that counts has plain words, so its windows join others that have."""
    if not ok.any():
        return ok
    plain = np.concatenate([[0], np.cumsum(kind == _WORD)])
    worded = ok & (plain[width:] > plain[:-width])
    run = np.cumsum(~ok)
    return ok & (np.bincount(run, worded)[run] > 0)


_SLOTS = pa.list_(pa.int64())


def _slots(kind, value, at, width):
    inside = np.flatnonzero(kind[at:at + width] != _WORD) + at
    return [int(x) for x in value[inside].view(np.int64)]


def _words(kind, at, width):
    return [int(x) for x in np.flatnonzero(kind[at:at + width] == _WORD) + at]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """All windows of the benchmark: ``item_id, form, width, at, n, h, slots, words`` (places of the plain words); an item shorter than a window is one window of its own width."""
    kind_id = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Templates()
        for b in batches:
            out = []
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                got = made.tokens(t or "")
                for form, n in ((0, len(got[3])), (1, len(got[0]))):
                    width = min(window, n)
                    if width:
                        _, at, h = both_windows(got, width, True)[form]
                        out += [(i, form, width, int(a), n, int(x), _slots(got[1], got[2], a, width) if form else [], _words(got[1], a, width) if form else list(range(a, a + width))) for a, x in zip(at, h.view(np.int64))]
            cols = list(zip(*out)) if out else [[]] * 8
            types = [b.schema.field("item_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), _SLOTS, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item_id", "form", "width", "at", "n", "h", "slots", "words"])

    return items.select("item_id", "text").mapInArrow(cut, f"item_id {kind_id}, form int, width int, at int, n int, h bigint, slots array<bigint>, words array<int>")


def document_windows(docs: DataFrame, held, widths: list[int]) -> DataFrame:
    """Windows of documents that pass the filter of benchmark windows: ``doc_id, fp, form, width, at, h, slots``."""
    kind_id = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Templates()
        for b in batches:
            out = []
            ids, fps = b.column("doc_id").to_pylist(), b.column("fp").to_pylist()
            for r, t in enumerate(b.column("text")):
                got = made.tokens(t.as_py())
                for width in widths:
                    for form, at, h in both_windows(got, width, False):
                        ok = bloom.may_hold(held.value, h)
                        if form:
                            ok = _beside_words(ok, got[1], width)
                        if ok.any():
                            out += [(ids[r], fps[r], form, width, int(a), int(x), _slots(got[1], got[2], a, width) if form else []) for a, x in zip(at[ok], h[ok].view(np.int64))]
            cols = list(zip(*out)) if out else [[]] * 7
            types = [b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), _SLOTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "fp", "form", "width", "at", "h", "slots"])

    return docs.mapInArrow(cut, f"doc_id {kind_id}, fp bigint, form int, width int, at int, h bigint, slots array<bigint>")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Contaminated documents: ``doc_id, fp, item_id, n_windows, coverage, verbatim``, one row per document and item.

    Windows that match with one shift between document and item form an alignment. It counts
    when its slots are consistent (one value in the document for each of the item) and it spans
    ``min_tokens`` template tokens, or the whole item where that is shorter, with ``MIN_PLAIN``
    plain words, or half of those tokens. ``verbatim``: all slot values are equal. Null and empty texts
    match nothing; rows with equal id and text give one row per item; no window of any text is left out.
    ``n_windows`` and ``coverage`` are those of the best alignment.
    """
    known = stored(item_windows(items, window))
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())
    held = bloom.build(known, "h")
    found = stored(document_windows(documents(docs), held, widths))
    k = known.select("item_id", F.col("at").alias("item_at"), "n", "form", "width", "h", F.col("slots").alias("item_slots"), "words")
    hits = found.join(k, ["form", "width", "h"])
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    hits = hits.select("doc_id", "fp", "item_id", "n", "form", "width", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "words", pairs.alias("pairs"))
    # an alignment counts by all its windows, or by those of which half are plain words
    rich = 2 * F.size("words") >= F.col("width")
    union = lambda c, of: F.array_distinct(F.flatten(F.collect_set(F.when(of, F.col(c)))))
    lines = hits.groupBy("doc_id", "fp", "item_id", "form", "shift", "n", "width").agg(*[c for name, of in (("all", F.lit(True)), ("rich", rich)) for c in (
        F.countDistinct(F.when(of, F.col("item_at"))).alias(f"{name}_windows"), union("pairs", of).alias(f"{name}_pairs"), union("words", of).alias(f"{name}_words"))])
    need = F.least(F.lit(min_tokens), F.col("n"))
    case = lambda name: F.struct(F.col(f"{name}_windows").alias("n_windows"), F.col(f"{name}_pairs").alias("pairs"), F.col(f"{name}_words").alias("words"))
    lines = lines.select("doc_id", "fp", "item_id", "n", "width", F.explode(F.array(case("all"), case("rich"))).alias("x")).select("doc_id", "fp", "item_id", "n", "width", "x.*")
    function = F.size(F.array_distinct(F.col("pairs.a"))) == F.size("pairs")
    spans = F.col("n_windows") + F.col("width") - 1 >= need
    worded = F.size("words") >= F.least(F.lit(MIN_PLAIN), F.ceil(need / 2))
    same = ~F.exists("pairs", lambda p: p["a"] != p["b"])
    good = lines.filter(function & spans & worded)
    return good.groupBy("doc_id", "fp", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max((F.col("n_windows") + F.col("width") - 1) / F.col("n")).alias("coverage"), F.max(same).alias("verbatim"))


@query("op2_template_leaks")
def leaks_q(spark, sf_dir):
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_windows", "coverage", "verbatim").distinct()
