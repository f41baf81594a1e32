"""Results are whole: no silent caps on metrics, rounds or lines."""

from pyspark.sql import functions as F

from threadgraph.functions import text as tx
from threadgraph.operators import communities as cm
from threadgraph.operators import connectivity as cn
from threadgraph.operators import graph as gr
from threadgraph.plans import evaluation as ev


def test_all_metric_pairs(spark):
    rows = [(e, "m", f"x{k:03d}", float((e * (k + 1)) % 7 + 1)) for e in range(4) for k in range(250)]
    long = spark.createDataFrame(rows, "eval_id long, model string, metric string, value double")
    out = ev.pair_correlations(long)
    assert out.count() == 250 * 249 // 2
    r = out.filter("metric_a = 'x000' and metric_b = 'x001'").first()
    x, y = [(e * 1) % 7 + 1 for e in range(4)], [(e * 2) % 7 + 1 for e in range(4)]
    mx, my = sum(x) / 4, sum(y) / 4
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert abs(r["r"] - want) < 1e-9 and r["n"] == 4


def test_null_ends_do_not_cut_a_text_short(spark):
    links = spark.createDataFrame([("g", f"{i:03d}", None, None, "t") for i in range(60)], "graph_id string, seq string, source string, label string, target string")
    assert gr.graph_text(links, 30).first()["graph_text"] == ("  t\n" * 60)[:30] + "... (truncated)"
    texts = spark.createDataFrame([("k", i, None if i < 20 else f"text {i}") for i in range(25)], "k string, i int, t string")
    assert tx.join_texts(texts, "k", "i", "t", 20).first()["text"].startswith("text 20\n\ntext 21")


def test_edges_on_no_shortest_path_count(spark):
    w = spark.createDataFrame([("g", "u", "x", 0.1), ("g", "v", "x", 0.1), ("g", "u", "v", 1.0)], "graph_id string, a string, b string, weight double")
    nodes = spark.createDataFrame([("g", x) for x in "uvx"], "graph_id string, id string")
    got = {r["id"] for r in cm.edge_betweenness_cut(nodes, w, share=0.5, min_size=3, max_size=50).collect()}
    assert got == {"u", "v", "x"}


def test_long_weighted_path(spark):
    n = 60  # each round is a job; the rounds follow the path whatever its length
    adj = spark.createDataFrame([("g", a, b) for i in range(n) for a, b in ((f"{i:03d}", f"{i + 1:03d}"), (f"{i + 1:03d}", f"{i:03d}"))], "graph_id string, node string, nbr string")
    nodes = spark.createDataFrame([("g", "000")], "graph_id string, id string")
    assert cn.shortest_distances(nodes, adj).agg(F.max("d")).first()[0] == n


def test_blocks_do_not_mix_graphs(spark):
    rows = [(g, a, b, 1.0) for g in ("g", "h") for a, b in (("a", "b"), ("b", "c"), ("a", "c"))]
    w = spark.createDataFrame(rows, "graph_id string, a string, b string, weight double")
    out = cm.spectral_communities(w, k=2, min_size=1).groupBy("graph_id", "id").count()
    assert out.filter("count > 1").count() == 0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501), "b": np.concatenate([np.zeros(300), rng.exponential(size=77) ** 6]), "c": np.array([2.5])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None)], "k string, v double")
    for r in ev.exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(data[r["k"]], [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_communities_are_finished(spark):
    n = 120
    ring = spark.createDataFrame([("g", f"{i:03d}", f"{(i + 1) % n:03d}", 1.0) for i in range(n)], "graph_id string, a string, b string, weight double")
    comm = {r["id"]: r["comm"] for r in cm.modularity_partition(ring).collect()}
    size = {c: list(comm.values()).count(c) for c in comm.values()}
    assert len(comm) == n
    for i in range(n):  # no two neighbouring communities would gain by a merge
        a, b = comm[f"{i:03d}"], comm[f"{(i + 1) % n:03d}"]
        assert a == b or size[a] * size[b] >= n / 2


def test_quantiles_behind_outliers(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = {"far": np.concatenate([rng.random(3000), [1e12, -1e300, 1e308]]), "steps": 2.0 ** -np.arange(600.0), "ties": np.repeat([1.0, 2.0, 3.0], 400)}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("ends", float("inf")), ("ends", float("nan"))]
                               + [("ends", float(i)) for i in range(100)] + [("ends", float("-inf"))], "k string, v double")
    data["ends"] = np.concatenate([[-np.inf], np.arange(100.0), [np.inf]])
    qs = [0.01, 0.25, 0.5, 0.9, 0.99]
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in ev.exact_quantiles(df, ["k"], "v", qs, parts=8, limit=5).collect()}
    for k, v in data.items():
        assert np.allclose(got[k], np.quantile(v, qs)), k
    assert ev.exact_quantiles(df.limit(0), ["k"], "v", qs).count() == 0
    assert ev.exact_quantiles(df.filter("k = 'ties'"), [], "v", [0.5]).first()["q0"] == 2.0
