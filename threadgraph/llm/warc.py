"""WARC archives: write, read back, and resolve revisits by payload digest.

Records are text (a header block, then an HTTP block in UTF-8), so Spark's own text source
and sink carry them: each record ends with the separator of the sink, and the version line
is the separator of the source. Writers commit per task and readers stream, on any store
Spark reaches. Archives are gzip files of at most ``MAX_RECORDS`` records.

Only headers are shuffled to find the original of a digest. Payloads stay where they are
unless the list of revisits is too large for Spark to broadcast.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadgraph.llm import query
from threadgraph.llm.common import stored, table
from threadgraph.session import checkpoint_dir

VERSION = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_RECORDS = 100_000
LAST = 2**63 - 1


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of UTF-8 text: five hex digits are four base-32 digits."""
    h = F.sha1(payload)
    four = lambda k: F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[four(k) for k in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks in a value become blanks."""
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise(F.lit(""))


def write_archive(records: DataFrame, path: str) -> None:
    """Write ``record_id, page_id, type, uri, date, digest, refers_to, refers_uri, payload`` as records; a revisit has no payload."""
    revisit = F.col("type") == "revisit"
    block = F.concat(F.lit(HTTP + GAP), F.when(revisit, F.lit("")).otherwise(F.coalesce("payload", F.lit(""))))
    head = F.concat(
        F.lit(VERSION), _line("WARC-Type", F.col("type")), _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("uri")), _line("Page-ID", F.col("page_id").cast("string")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))),
                                 _line("WARC-Refers-To-Target-URI", F.col("refers_uri")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"))
    rows = records.select(F.concat(head, F.lit(GAP), block).alias("value"))
    # the fastest gzip level: compression is most of the time of a write
    rows.write.option("lineSep", GAP).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", MAX_RECORDS).text(path)


def _declared(value: Column) -> Column:
    head = F.substring_index(value, GAP, 1)
    return F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]{1,18})", 1)


def _heads(pieces: pd.DataFrame) -> pd.DataFrame:
    """First pieces of records in one file, from piece sizes and declared sizes alone."""
    pieces = pieces.sort_values(["start", "at"])
    number, left = -1, 0
    out = []
    for size, want in zip(pieces["size"], pieces["want"]):
        if left > 0:
            left -= size + len(VERSION)
        else:
            number, left = number + 1, (want - size if want > 0 else 0)
        out.append(number)
    return pieces.assign(record=out)[["file", "at", "record"]]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of each record after its version line.

    A payload may hold the version line itself, which cuts its record in pieces. Sizes
    declared in the headers show the files where that happened; there, and only there, the
    pieces are put together again in the order of the file.
    """
    raw = spark.read.option("lineSep", VERSION).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    head = F.octet_length(F.substring_index("value", GAP, 1))
    size = F.octet_length("value").cast("long")
    want = F.when(F.length(_declared(F.col("value"))) > 0, _declared(F.col("value")).cast("long") + head + 2 * len(GAP)).otherwise(F.lit(-1))
    sized = raw.withColumns({"size": size, "want": want})
    whole = F.col("size") == F.col("want")
    broken = stored(sized.filter((F.col("size") > 0) & ~whole).select("file").distinct())
    good = sized.filter(whole)
    if broken.isEmpty():
        return good.select(F.col("value").alias("record"))
    cut = stored(sized.join(broken, "file", "left_semi"))
    numbers = cut.filter((F.col("size") > 0) | (F.col("at") >= 0)).select("file", "start", "at", "size", "want").groupBy("file").applyInPandas(_heads, "file string, at long, record long")
    parts = cut.join(numbers, ["file", "at"]).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "at", "value"))).alias("p"))
    glued = parts.select(F.array_join(F.transform("p", lambda x: x["value"]), VERSION).alias("record")).filter(F.length("record") > 0)
    return good.join(broken, "file", "left_anti").select(F.col("value").alias("record")).unionByName(glued)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records as the columns of ``write_archive``; ``payload`` is what follows the HTTP headers, null for a revisit."""
    head = F.substring_index("record", GAP, 1)
    split = read_records(spark, path).select(head.alias("head"), F.expr("substr(record, length(substring_index(record, '\r\n\r\n', 1)) + 5)").alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    bare = lambda c: F.regexp_replace(c, "[<>]", "")
    block = F.expr("left(rest, length(rest) - 4)")
    payload = F.expr("substr(block, length(substring_index(block, '\r\n\r\n', 1)) + 5)")
    return split.withColumn("block", block).select(
        bare(field("WARC-Record-ID")).alias("record_id"), field("Page-ID").cast("long").alias("page_id"), field("WARC-Type").alias("type"), field("WARC-Target-URI").alias("uri"),
        field("WARC-Date").alias("date"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), bare(field("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Refers-To-Target-URI").alias("refers_uri"), F.when(field("WARC-Type") != "revisit", payload).alias("payload"))


def crawl_archive(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """One response record per row of ``page_id, url, html``; a null html is an empty payload."""
    html = F.coalesce("html", F.lit(""))
    write_archive(pages.select(F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"), "page_id", F.lit("response").alias("type"), F.col("url").alias("uri"), F.lit(date).alias("date"),
                               base32_sha1(html).alias("digest"), F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("refers_uri"), html.alias("payload")), path)


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Copy an archive so that each payload of at least ``min_bytes`` is stored once.

    Per digest the response with the smallest page id (then record id) stays; every other
    response and every revisit of that digest becomes a revisit of it with fresh headers. A
    revisit whose original is in no record keeps the reference it has. Digests are those of
    the headers. A missing page id counts as the largest.
    """
    records = read_archive(spark, source)
    heads = stored(records.select("record_id", "page_id", "type", "uri", "date", "digest", "refers_to", "refers_uri", F.octet_length("payload").alias("bytes")))
    large = heads.filter((F.col("type") == "response") & (F.col("bytes") >= min_bytes))
    first = large.groupBy("digest").agg(F.min(F.struct(F.coalesce("page_id", F.lit(LAST)).alias("p"), F.col("record_id").alias("r"), F.col("uri").alias("u"))).alias("o"))
    joined = heads.filter((F.col("type") == "revisit") | (F.col("bytes") >= min_bytes)).join(first, "digest", "left")
    again = joined.filter((F.col("type") == "revisit") | (F.col("record_id") != F.col("o.r")))
    revisits = stored(again.select("record_id", "page_id", F.lit("revisit").alias("type"), "uri", "date", "digest", F.coalesce("o.r", "refers_to").alias("refers_to"),
                                   F.coalesce("o.u", "refers_uri").alias("refers_uri"), F.lit(None).cast("string").alias("payload")))
    kept = records.join(revisits.select("record_id"), "record_id", "left_anti")
    write_archive(kept.select(revisits.columns).unionByName(revisits), target)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Per record of an archive the size and digest of its full payload, a revisit's through the record it refers to."""
    rows = read_archive(spark, path)
    bare = rows.select("record_id", "page_id", "type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).alias("payload_digest"))
    bare = stored(bare)
    full = bare.filter("type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    out = bare.join(full, "refers_to", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "_digest", "digest").alias("payload_digest"),
                      F.col("type").alias("record_type"), F.col("_page").alias("refers_to"))


CHECK = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g
"""


@query("op1_warc_revisits", CHECK)
def warc_q(spark, sf_dir):
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    crawl_archive(table(spark, sf_dir, "pages"), f"{root}/crawl")
    resolve_revisits(spark, f"{root}/crawl", f"{root}/resolved")
    return contents(spark, f"{root}/resolved")
