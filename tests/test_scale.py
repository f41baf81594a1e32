"""What the queries write and keep on disk, and inputs laid out as folders."""

import glob
import gzip
import os
import uuid

from pyspark.sql import functions as F

from threadgraph import fixtures as fx
from threadgraph.operators import connectivity as cn
from threadgraph.session import checkpoint_dir, materialize


def _tables(spark, root):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    put("customer", [(1, "Ann", 1), (2, "Bob", 9)], "c_custkey long, c_name string, c_nationkey int")
    put("orders", [(10, 1), (11, 2), (12, 5)], "o_orderkey long, o_custkey long")
    put("lineitem", [(10, 1, 1), (10, 1, 1), (10, 2, 1), (11, 1, 2), (None, 1, 1), (12, 3, 1)], "l_orderkey long, l_partkey long, l_suppkey long")
    put("part", [(1, "bolt"), (2, "nut"), (2, "nut b")], "p_partkey long, p_name string")
    put("supplier", [(1, "S1", 1), (2, "S2", 9)], "s_suppkey long, s_name string, s_nationkey int")
    put("nation", [(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("region", [(0, "R")], "r_regionkey int, r_name string")


def test_order_graph_writes_links_without_labels(spark, tmp_path):
    from threadgraph.catalog.graphs import _order_graph

    _tables(spark, tmp_path)
    got = sorted((r.graph_id, r.subject_id, r.predicate, r.object_id, r.object_label) for r in fx.order_triples(spark, str(tmp_path)).collect())
    assert got == sorted([
        ("o10", "c1", "places", "o10", "Order 10"), ("o10", "c1", "is_part_of", "n1", "N"), ("o10", "o10", "contains", "p1", "bolt"),
        ("o10", "o10", "contains", "p2", "nut"), ("o10", "o10", "contains", "p2", "nut b"), ("o10", "p1", "uses", "s1", "S1"), ("o10", "p2", "uses", "s1", "S1"),
        ("o10", "p2", "uses", "s1", "S1"), ("o10", "s1", "is_part_of", "n1", "N"), ("o10", "n1", "belongs_to", "r0", "R"),
        ("o11", "c2", "places", "o11", "Order 11"), ("o11", "o11", "contains", "p1", "bolt"), ("o11", "p1", "uses", "s2", "S2")])
    nodes, links = _order_graph(spark, str(tmp_path))
    files = links.inputFiles()
    assert spark.read.parquet(*files).columns == ["graph_id", "seq", "source", "target", "label", "origin"]
    assert links.count() == len(got)
    assert sorted(r.id for r in nodes.filter("graph_id = 'o11'").collect()) == ["c2", "o11", "p1", "s2"]


def test_components_leave_only_their_result(spark):
    rows = [("g", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("h", "x", "y")]
    links = spark.createDataFrame(rows, "graph_id string, source string, target string")
    nodes = links.select("graph_id", F.explode(F.array("source", "target")).alias("id"))
    adj = materialize(cn.adjacency(links))
    before = set(os.listdir(checkpoint_dir(spark)))
    out = cn.connected_components(nodes, adj)
    assert len(set(os.listdir(checkpoint_dir(spark))) - before) == 1
    assert {(r.graph_id, r.component) for r in out.collect()} == {("g", "n000"), ("h", "x")}


def test_stream_ingest_reads_a_file_and_a_folder_of_files(spark, tmp_path):
    from threadgraph.catalog import QUERIES, load

    load()
    rows = [(i, "some text", "en", "web" if i % 2 else "book", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    (part,) = glob.glob(f"{tmp_path}/one/*.parquet")
    os.mkdir(f"{tmp_path}/file")
    with open(part, "rb") as src, open(f"{tmp_path}/file/documents.parquet", "wb") as dst:
        dst.write(src.read())
    for form in ("folder", "file"):
        assert QUERIES["st1_stream_ingest"](spark, f"{tmp_path}/{form}").agg(F.sum("docs")).first()[0] == 40


def test_archives_take_the_fastest_compression(spark):
    from threadgraph.llm import warc as W

    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    html = " ".join(f"word{i * i % 977} of {i % 31}" for i in range(20000))
    W.crawl_archive(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").coalesce(1), path)
    (name,) = glob.glob(f"{path}/*.gz")
    raw = gzip.open(name).read()
    assert html.encode() in raw
    assert os.path.getsize(name) > (len(gzip.compress(raw, 1)) + len(gzip.compress(raw, 6))) / 2


def test_token_ids_are_not_stored_between_joins(spark, monkeypatch):
    import public_tokenizers

    from threadgraph.llm import bpe

    made = []
    monkeypatch.setattr(bpe, "stored", lambda df: made.append(materialize(df)) or made[-1])
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "two zwölf")], "doc_id long, text string")
    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), hot_words=1)
    assert {r.doc_id: r.n_tokens > 0 for r in out.collect()} == {1: True, 2: False, 3: True}
    assert len(made) == 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_tables_are_built_once(spark):
    from threadgraph.operators import graph as g

    cols = "graph_id string, seq string, subject_id string, subject_label string, predicate string, object_id string, object_label string, origin string, domain_type string"
    rows = [("g", "2", "a", "late", "p", "b", "B", "user", "data"), ("g", "1", "a", "A", "p", "c", "C", "domain", None), ("g", "3", "b", "B", "q", "a", "x", "user", "data")]
    t = spark.createDataFrame(rows + rows[:1], cols)
    nodes, links = g.materialize_graph(t)
    assert "Aggregate" not in _plan(nodes) and "Join" not in _plan(links)
    assert sorted((r.id, r.label, r.origin_label, r.domain_type, r.first_seq) for r in nodes.collect()) == [
        ("a", "A", "domain", "other", "1"), ("b", "B", "user", "data", "2"), ("c", "C", "domain", "other", "1")]
    assert sorted(r.seq for r in links.collect()) == ["1", "2", "2", "3"]
    inv = g.subgraph_inventory(*g.split_by_origin(nodes, links))
    assert "SortAggregate" not in _plan(inv)
    got = {r.subgraph: (r.node_count, r.link_count, r.first_node, r.first_link_source) for r in inv.collect()}
    assert got == {"domain": (2, 1, "a", "a"), "user": (1, 0, "b", None), "combined_subgraph": (3, 4, "a", "a")}
    kept, merged = g.consolidate(nodes, links)
    assert "Aggregate" not in _plan(merged)
    assert sorted((r.source, r.target, r["count"]) for r in merged.collect()) == [
        ("consolidated_A", "consolidated_B", 2), ("consolidated_A", "consolidated_C", 1), ("consolidated_B", "consolidated_A", 1)]


def test_first_by_sorts_on_a_hash(spark):
    from threadgraph.operators.common import first_by

    df = spark.createDataFrame([("g", "a", "2", "x"), ("g", "a", "1", "y"), ("g", None, "3", "z")], "graph_id string, id string, seq string, v string")
    out = first_by(df, ["graph_id", "id"], ["seq"])
    assert "Sort [xxhash64" in _plan(out) or "Sort [_groupingexpression" in _plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [("g", "a", "1", "y"), ("g", None, "3", "z")]


def test_centrality_rounds_leave_no_tables(spark):
    import warnings

    from threadgraph.operators import communities as cm

    pairs = [(i, i + 1) for i in range(30)] + [(0, 7), (0, 9)]
    adj = spark.createDataFrame([("g", f"n{a}", f"n{b}") for x, y in pairs for a, b in ((x, y), (y, x))], "graph_id string, node string, nbr string")
    folder = checkpoint_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = {r.node: r.x for r in cm.eigenvector_scores(adj, max_rounds=12).collect()}
    assert len(set(os.listdir(folder)) - before) <= 4
    x = dict.fromkeys(got, 1.0)
    for _ in range(12):
        y = dict(x)
        for a, b in pairs:
            y[f"n{a}"] += x[f"n{b}"]
            y[f"n{b}"] += x[f"n{a}"]
        length = sum(v * v for v in y.values()) ** 0.5
        x = {k: v / length for k, v in y.items()}
    assert len(got) == 31 and all(abs(got[k] - x[k]) < 1e-9 for k in x)
