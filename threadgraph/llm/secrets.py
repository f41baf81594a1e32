"""Secret scans: strong secrets by pattern, weak parts by linking the parts of one credential.

A weak identifier, a weak secret or an endpoint alone is everyday text. Inside one scope
(``REACH`` characters to either side) they complement each other: a weak secret is reported
when an identifier stands in its scope, an identifier or an endpoint when a secret does.
Scopes are compared by an interval join on bins of ``REACH`` characters. Each bin keeps only
its first and last position of a kind of part, which decides the neighbouring bins exactly,
so a text full of parts makes one row per bin and never pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.llm import query
from threadgraph.llm.common import attach, documents, span_text, stored, table

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 200

_BASE = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), None),  # runs are taken whole, so the length can stand in the pattern
)
_WORDS = ("pass", "secret", "token", "api")
#: The keyword begins a part of the name, so parts may stand before it (DB_PASS, AWS_SECRET_ACCESS_KEY, dbPass); values are taken whole.
_FIELD = r"""(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?ai:%s)["']?\x20*[:=]\x20*["']?(%s)"""
_SCHEME = r"(?<![A-Za-z0-9])(?ai:https?|jdbc(?::[a-z0-9]{1,20})?|postgres(?:ql)?|mysql|redis|mongodb(?:\+srv)?|amqps?|s?ftp|ssh)://"
#: User and password in front of a host.
_LOGIN = r"([^\s/:@?#]++)(?::([^\s/@?#]++))?+@"
_SECRET = r"[A-Za-z0-9+/_=-]{8,}"
#: Kinds of a pattern's groups; a value of kind ``random`` is a secret only if it does not look like a word.
_WEAK = (
    (("identifier",), re.compile(_FIELD % ("user|username|login|account|client_?id|access_?id|access_?key_?id", r"[A-Za-z0-9_.@-]{3,}"))),
    (("secret",), re.compile(_FIELD % ("pwd|pass", _SECRET))),
    (("random",), re.compile(_FIELD % ("key|private|credential|auth|signature", _SECRET))),
    (("random",), re.compile(r"(?<![A-Za-z0-9])(?ai:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]{8,})")),
    (("identifier", "secret", "endpoint"), re.compile(_SCHEME + "(?:" + _LOGIN + ")?+([A-Za-z0-9_.-]{3,})")),
    (("endpoint",), re.compile(_FIELD % ("host|endpoint|server", r"[A-Za-z0-9_.-]{3,}"))),
)
_LETTER, _DIGIT, _INNER_CAPITAL, _SMALL = (re.compile(p) for p in ("[A-Za-z]", "[0-9]", "(?s:.)[A-Z]", "[a-z]"))


def looks_random(value: str) -> bool:
    """Letters with digits, or small letters with capitals after the first character; a plain word or number is neither."""
    return bool(_LETTER.search(value) and _DIGIT.search(value) or _INNER_CAPITAL.search(value) and _SMALL.search(value))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong spans, leftmost non-overlapping per kind; a match that fails its test is not tried again."""
    found = []
    low = text.lower()
    for kind, pattern, test in _BASE:
        if kind == "assign" and not any(w in low for w in _WORDS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if test is None or test(m)]
    return found


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """Parts of a credential that prove nothing alone, each once, by start; the span is the value of the field, the login or the host."""
    if ":" not in text and "=" not in text:
        return []
    found = set()
    for kinds, pattern in _WEAK:
        for m in pattern.finditer(text):
            for g, kind in enumerate(kinds, 1):
                if m[g] is not None and (kind != "random" or looks_random(m[g])):
                    found.add(("secret" if kind == "random" else kind, m.start(g), m.end(g)))
    return sorted(found, key=lambda p: (p[1], p[0], p[2]))


_SPAN = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, weak = [], []
        for t in b.column("text"):
            text = t.as_py()
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in base_spans(text)])
            weak.append([{"kind": k, "start": s, "end": e} for k, s, e in weak_parts(text)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), pa.array(base, _ARROW), pa.array(weak, _ARROW)], ["doc_id", "fp", "base", "weak"])


def scan(docs: DataFrame) -> DataFrame:
    """Strong spans and weak parts of each text, one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "fp", "text").mapInArrow(_scan, f"doc_id {kind}, fp bigint, base {_SPAN}, weak {_SPAN}")


def _present(flag: Column, at: Column) -> tuple[Column, Column]:
    return F.min(F.when(flag, at)), F.max(F.when(flag, at))


def link_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts whose complement starts within ``reach`` characters: ``doc_id, fp, linked``.

    Strong spans count as secrets, access identifiers as identifiers too. Values inside a
    strong span are left out, as that reports them already. Repeated rows give one row.
    """
    weak = found.filter(F.size("weak") > 0)
    rows = weak.select("doc_id", "fp", F.inline(F.concat("weak", "base"))).distinct()
    rows = rows.withColumn("bin", F.floor(F.col("start") / reach))
    is_id = F.col("kind").isin("identifier", "access")
    is_secret = F.col("kind").isin("secret", "assign", "access", "hex")
    is_end = F.col("kind") == "endpoint"
    names = {}
    for name, flag in (("id", is_id), ("sec", is_secret), ("end", is_end)):
        names[f"{name}_lo"], names[f"{name}_hi"] = _present(flag, F.col("start"))
    bins = rows.groupBy("doc_id", "fp", "bin").agg(*[c.alias(n) for n, c in names.items()])
    # each bin tells its neighbours where its first and last part of a kind stand
    told = bins.select("doc_id", "fp", F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), F.lit(-d).alias("side")) for d in (-1, 0, 1)])).alias("t"), *names)
    told = told.select("doc_id", "fp", "t.bin", "t.side", *names)
    wide = told.groupBy("doc_id", "fp", "bin").agg(*[F.max(F.when(F.col("side") == side, F.col(n))).alias(f"{n}_{side + 1}") for side in (-1, 0, 1) for n in names])
    w = rows.filter(F.col("kind").isin("identifier", "secret", "endpoint"))
    v = wide.withColumnsRenamed({"doc_id": "_doc_id", "fp": "_fp", "bin": "_bin"})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("fp") == F.col("_fp")) & (F.col("bin") == F.col("_bin"))
    near = lambda n: (F.coalesce(F.col(f"{n}_hi_0") >= F.col("start") - reach, F.lit(False)) | F.col(f"{n}_lo_1").isNotNull()
                      | F.coalesce(F.col(f"{n}_lo_2") <= F.col("start") + reach, F.lit(False)))
    complete = F.when(F.col("kind") == "secret", near("id") | near("end")).otherwise(near("sec"))
    hits = w.join(v, on).filter(complete).select("doc_id", "fp", "kind", "start", "end")
    return hits.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: strong spans (``base``) and linked weak parts (``linked``).

    Null text is empty and has no spans. Rows with one id are told apart by their text;
    equal rows get equal results. Positions are code points, ends exclusive.
    """
    found = stored(scan(documents(docs)))
    links = link_parts(found, reach)
    out = attach(found.select("doc_id", "fp", "base"), links)
    inside = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    linked = F.filter(F.coalesce("linked", F.array().cast(_SPAN)), lambda s: ~inside(s))
    return out.select("doc_id", "fp", "base", linked.alias("linked"))


def _ranked(spans: str) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int")
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))


@query("op8_secret_scan")
def secrets_q(spark, sf_dir):
    out = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(_ranked("base")), 256).alias("base_sha256"),
                      span_text(F.concat(_ranked("base"), _ranked("linked"))).alias("spans"))
