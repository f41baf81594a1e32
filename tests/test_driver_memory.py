"""Joins must not send tables that grow with the input to the driver for a broadcast."""

import numpy as np

from threadgraph.operators import similarity as sm
from threadgraph.plans import paths as pt
from threadgraph.session import materialize


def broadcasts(df):
    """The sub-plans below every broadcast of a planned, not yet run, query."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for i, line in enumerate(lines):
        at = line.find("BroadcastExchange")
        if at >= 0:
            below = [x for x in lines[i + 1:]]
            end = next((n for n, x in enumerate(below) if len(x) - len(x.lstrip(" :+-*()0123456789")) <= at), len(below))
            out.append("\n".join(below[:end]))
    return out


def test_similarity_join_broadcasts_cell_sizes_not_vectors(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_ROWS", 32)
    rows = [("all", f"v{i}", [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).normal(size=(200, 64)))]
    v = spark.createDataFrame(rows, "graph_id string, id string, vec array<double>")
    near = sm.similar_pairs(v, v, None, 2)
    found = broadcasts(near)
    assert found and not [x for x in found if "vec" in x]
    assert near.count() == 400


def test_pivot_sample_is_written_before_it_is_collected(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_ROWS", 32)
    written, real = [], sm.materialize
    monkeypatch.setattr(sm, "materialize", lambda df: written.append(df.columns) or real(df))
    rows = [("all", f"v{i}", [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).normal(size=(100, 8)))]
    sm.PivotTree.fit(spark.createDataFrame(rows, "graph_id string, id string, vec array<double>"))
    assert ["vec"] in written


def test_path_entities_and_steps_are_not_broadcast(spark):
    cols = "path_id string, pos long, subject string, predicate string, object string, subject_layer string, object_layer string"
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("a", "b")]
    rows = [(f"p{i}", n, a, "uses", b, "system", "data") for i in range(50) for n, (a, b) in enumerate(pairs)]
    steps = materialize(spark.createDataFrame(rows, cols))
    more = [(f"p{i}", "9", "c", "uses", "a", "system", "data") for i in range(50)]
    triples = materialize(spark.createDataFrame(more, "graph_id string, seq string, subject string, predicate string, object string, subject_layer string, object_layer string"))
    assert broadcasts(pt.bridges(steps, triples)) == []
    done = pt.post_process_path(steps, triples)
    assert broadcasts(done) == []
    got = {tuple(r) for r in done.filter("path_id = 'p7'").select("pos", "subject", "object").collect()}
    assert got == {(0, "a", "b"), (1, "b", "c"), (2, "c", "a")}
