"""Order graphs are dealt by graph once; what follows graph by graph moves no links."""

import random

from test_scale import _tables

from threadgraph.catalog import corpus, graphs, similarity
from threadgraph.operators import similarity as sm


def moved(df):
    """Exchanges of rows by graph or document, but for the one that deals orders and lines."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x for x in plan if " Exchange hashpartitioning(" in x.replace("- ", " ") and ("graph_id" in x or "doc_id" in x) and "REPARTITION_BY_COL" not in x]


def test_graph_text_moves_no_links(spark, tmp_path):
    _tables(spark, tmp_path)
    out = graphs.graph_text_q(spark, str(tmp_path))
    assert not moved(out)
    got = {r.graph_id: r.graph_text.split("\n") for r in out.collect()}
    assert got["o11"] == ["c2 places o11", "o11 contains p1", "p1 uses s2"] and len(got["o10"]) == 10


def test_ring_moves_no_nodes(spark, tmp_path):
    _tables(spark, tmp_path)
    out = similarity.ring_q(spark, str(tmp_path))
    assert not moved(out)
    got = sorted((r.subject_id, r.object_id) for r in out.filter("graph_id = 'o11'").collect())
    assert got == sorted([("c2", "o11"), ("c2", "p1"), ("c2", "s2"), ("o11", "p1"), ("o11", "s2"), ("o11", "c2"), ("p1", "s2"), ("p1", "c2"), ("p1", "o11")])


def test_ring_against_plain_python(spark):
    rnd = random.Random(5)
    ents = {f"g{g}": rnd.sample(range(100, 200), rnd.choice([0, 2, 3, 4, 5, 30])) for g in range(25)}
    seeds = {g: rnd.sample(range(100, 200), rnd.choice([0, 1, 4])) + ids[:rnd.choice([0, 3])] for g, ids in ents.items()}
    frame = lambda d: spark.createDataFrame([(g, str(x)) for g, ids in d.items() for x in sorted(set(ids))], "graph_id string, id string")
    want = set()
    for g, ids in ents.items():
        ids = sorted(map(str, ids))
        if len(ids) > 3 and g != "g7":
            for s in sorted(set(map(str, seeds[g])))[:3]:
                after = [x for x in ids if x > s][:3]
                want |= {(g, s, x) for x in (after + [x for x in ids[:4] if x != s and x not in after])[:3]}
    found = spark.createDataFrame([("g7",), (None,)], "graph_id string")
    assert {(r.graph_id, r.subject_id, r.object_id) for r in sm.ring_fallback(frame(seeds), frame(ents), found).collect()} == want


def test_triples_by_doc_moves_no_triples(spark, tmp_path):
    _tables(spark, tmp_path)
    out = corpus.by_doc_q(spark, str(tmp_path))
    assert not moved(out)
    assert out.select("doc_id").distinct().collect()[0].doc_id == "o10" and out.count() == 10


def test_description_moves_links_once(spark, tmp_path):
    _tables(spark, tmp_path)
    out = graphs.description_q(spark, str(tmp_path))
    assert not moved(out)
    got = {r.graph_id: (r.node_count, r.link_count, r.group_count, r.relations, r.first_nodes) for r in out.collect()}
    assert got == {"o10": (7, 8, 1, "belongs_to, contains, is_part_of, places, uses", "c1, n1, o10"), "o11": (4, 3, 1, "contains, places, uses", "c2, o11, p1")}


def test_weights_move_no_sequence(spark, tmp_path):
    _tables(spark, tmp_path)
    out = graphs.weighted_links_q(spark, str(tmp_path))
    assert "max(seq" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.a, r.b, r.weight) for r in out.filter("graph_id = 'o11'").collect())
    assert got == [("c2", "o11", 1.0), ("o11", "p1", 1.0), ("p1", "s2", 1.0)]
