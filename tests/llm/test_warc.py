import base64
import hashlib
import uuid

from threadgraph.llm import warc as W
from threadgraph.session import checkpoint_dir


def run(spark, rows, min_bytes=0):
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, type string, digest int")
    W.crawl_archive(pages, root + "/a")
    W.resolve_revisits(spark, root + "/a", root + "/b", min_bytes)
    return root, W.contents(spark, root + "/b")


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def test_round_trip(spark):
    nested = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n end"
    rows = [(5, "http://a", "same"), (3, "http://b\r\nX: y", "same"), (9, None, None), (7, "u", ""), (1, "u", nested), (2, "u", nested), (4, "u", "ünï\r\n\r\nWARC/1.1\r\n"),
            (6, "u", "WARC/1.1\r\nWARC/1.1\r\n"), (8, "u", "long " * 50000), (10, "u", "\n\n"), (None, "u", "same"), (5, "http://a", "same")]
    _, out = run(spark, rows)
    got = [tuple(r) for r in out.collect()]
    first = {}
    for i, _, h in rows:
        k = digest(h)
        first[k] = min(first.get(k, W.LAST), W.LAST if i is None else i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        same = [g for g in got if g[0] == i and g[2] == digest(h)]
        assert same and all(g[1] == len((h or "").encode()) for g in same)
        for g in same:
            assert (g[3], g[4]) == (("response", None) if g[3] == "response" else ("revisit", first[digest(h)]))
    assert sorted((g[2], g[3]) for g in got if g[3] == "response") == sorted((k, "response") for k in first)


def test_min_bytes_and_empty(spark):
    _, out = run(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], 3)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out.collect()} == {(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)}
    assert run(spark, [])[1].count() == 0


def test_second_pass_keeps_revisits(spark):
    root, _ = run(spark, [(1, "u", "ab"), (2, "v", "ab"), (3, "w", "c")])
    W.resolve_revisits(spark, root + "/b", root + "/c")
    got = {tuple(r) for r in W.contents(spark, root + "/c").collect()}
    assert got == {(1, 2, digest("ab"), "response", None), (2, 2, digest("ab"), "revisit", 1), (3, 1, digest("c"), "response", None)}
