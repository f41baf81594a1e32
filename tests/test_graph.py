import random

import brute
import pytest
from pyspark.sql import functions as F

from threadgraph.operators import communities as cm
from threadgraph.operators import connectivity as cn
from threadgraph.operators import graph as g
from threadgraph.session import materialize

CLIQUE_A = [(f"a{i}", f"a{j}") for i in range(7) for j in range(i + 1, 7)]
CLIQUE_B = [(f"b{i}", f"b{j}") for i in range(7) for j in range(i + 1, 7)]
GRAPHS = {
    "path": [("1", "2"), ("2", "3"), ("3", "4"), ("4", "5")],
    "star": [("c", f"l{i}") for i in range(6)],
    "cliques": CLIQUE_A + CLIQUE_B + [("a0", "b0")],
    "loop": [("x", "x"), ("x", "y"), ("x", "y")],
    "two": [("p", "q"), ("r", "s"), ("s", "t")],
}
random.seed(7)
GRAPHS["random"] = [(f"n{random.randrange(14):02d}", f"n{random.randrange(14):02d}") for _ in range(24)]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(k, f"{i:04d}", a, b, "r", "domain") for name, e in GRAPHS.items() for k in (name, name + "_copy") for i, (a, b) in enumerate(e)]
    links = spark.createDataFrame(rows, "graph_id string, seq string, source string, target string, label string, origin string").cache()
    nodes = links.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    iso = spark.createDataFrame([("two", f"iso{i:02d}") for i in range(25)], "graph_id string, id string")
    return nodes.unionByName(iso).withColumn("label", F.col("id")).cache(), links


def _by_graph(rows, key, value):
    out = {}
    for r in rows:
        out.setdefault(r["graph_id"], {})[r[key]] = r[value]
    return out


def test_components_match_search(data):
    nodes, links = data
    got = _by_graph(cn.connected_components(nodes, cn.adjacency(links)).collect(), "id", "component")
    for name, edges in GRAPHS.items():
        ids = {x for e in edges for x in e} | ({f"iso{i:02d}" for i in range(25)} if name == "two" else set())
        assert got[name] == brute.components(ids, edges)
        if name != "two":
            assert got[name + "_copy"] == got[name]


def test_long_path_component(spark):
    n = 300
    links = spark.createDataFrame([("g", f"{i:04d}", f"{i + 1:04d}") for i in range(n)], "graph_id string, source string, target string")
    nodes = spark.createDataFrame([("g", f"{i:04d}") for i in range(n + 1)], "graph_id string, id string")
    rows = cn.connected_components(nodes, cn.adjacency(links)).collect()
    assert {r["component"] for r in rows} == {"0000"} and len(rows) == n + 1


def test_betweenness_matches_brandes(data):
    nodes, links = data
    adj = cn.adjacency(links).cache()
    node, edge = cn.betweenness(adj, cn.shortest_distances(nodes, adj))
    node = _by_graph(node.collect(), "id", "betweenness")
    edges = {}
    for r in edge.collect():
        edges.setdefault(r["graph_id"], {})[(r["a"], r["b"])] = r["betweenness"]
    for name, e in GRAPHS.items():
        want_n, want_e = brute.betweenness({x for p in e for x in p}, e)
        assert {k: round(v, 6) for k, v in node.get(name, {}).items() if v > 1e-9} == {k: round(v, 6) for k, v in want_n.items() if v > 1e-9}
        assert {k: round(v, 6) for k, v in edges[name].items()} == {k: round(v, 6) for k, v in want_e.items()}


def test_centralities_of_star(data):
    nodes, links = data
    adj = cn.adjacency(links).cache()
    c = {r["graph_id"]: r for r in cn.centralities(nodes, adj).collect()}
    assert c["star"]["max_betweenness_centrality"] == 1.0 and c["star"]["max_degree_centrality"] == 1.0
    assert c["two"]["max_closeness_centrality"] == 0.0  # not connected


def test_weighted_distances(spark):
    rows = [("g", "a", "b", 0.5), ("g", "b", "c", 0.5), ("g", "a", "c", 2.0), ("g", "c", "d", 1.0)]
    w = spark.createDataFrame(rows, "graph_id string, a string, b string, weight double")
    adj = cm._both(w)
    nodes = spark.createDataFrame([("g", x) for x in "abcd"], "graph_id string, id string")
    d = {(r["source"], r["node"]): r["d"] / cn.MICRO for r in cn.shortest_distances(nodes, adj, "weight").collect()}
    assert d[("a", "c")] == 1.0 and d[("a", "d")] == 2.0


def test_communities_split_the_cliques(data):
    nodes, links = data
    nodes, links = nodes.filter("graph_id like 'cliques%'"), links.filter("graph_id like 'cliques%'")
    rows = cm.communities(nodes, links, cn.weighted_links(nodes, links)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["graph_id"], r["community"]), set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == sorted([sorted(f"{c}{i}" for i in range(7)) for c in "ab"] * 2)


def test_edge_cut_removes_the_bridge(data):
    nodes, links = data
    nodes, links = nodes.filter("graph_id = 'cliques'"), links.filter("graph_id = 'cliques'")
    w = cn.weighted_links(nodes, links).withColumn("weight", F.lit(1.0))
    rows = cm.edge_betweenness_cut(nodes, w, share=0.03).collect()
    assert {r["community"] for r in rows} == {"a0", "b0"} and all(r["size"] == 7 for r in rows)


def test_cap_component_keeps_central_nodes(data):
    nodes, links = data
    rows = cm.cap_component(nodes, cn.adjacency(links), min_size=7, max_size=3).filter("graph_id = 'star'").collect()
    assert len(rows) == 3 and "c" in {r["id"] for r in rows}


def test_degrees_and_clustering(data):
    nodes, links = data
    deg = _by_graph(g.degrees(links).collect(), "id", "degree")
    assert deg["loop"] == {"x": 4, "y": 2}
    m = {r["graph_id"]: r for r in g.clustering_and_density(nodes, links).collect()}
    assert m["star"]["clustering_coefficient"] == 0.0 and m["path"]["graph_density"] == 0.4
    assert m["cliques"]["clustering_coefficient"] > 0.9


def test_report_and_isolated(data):
    nodes, links = data
    summary, details = cn.connectivity_report(nodes, links)
    r = {x["graph_id"]: x for x in summary.collect()}
    assert r["two"]["isolated_count"] == 25 and r["two"]["components"] == 27 and r["star"]["hub_count"] == 1
    rows = details.filter("graph_id in ('two', 'star')").collect()
    assert [(x["key"], x["value"]) for x in rows if x["graph_id"] == "star" and x["kind"] == "hub"] == [("c", 6)]
    assert sum(x["kind"] == "isolated" for x in rows) == 25
    iso = g.isolated_nodes(nodes, links)
    groups = nodes.sparkSession.createDataFrame([("two", "A", 2), ("two", "B", 5)], "graph_id string, group string, size int")
    got = cn.assign_isolated(iso, groups, 20).groupBy("group").count().collect()
    assert {x["group"]: x["count"] for x in got} == {"A": 12, "B": 8}  # 2+12 and 5+8 differ by at most one


def test_materialize_rules(spark):
    rows = [("g", "1", "", "A", "p", "b", "B", "user"), ("g", "2", "a", "ns0__x", "p", "b", "B", "user"),
            ("g", "3", "a", "A", "p", "b", "B2", "domain"), ("g", "4", "cccccccccc1", "", "p", "a", "A", "llm")]
    t = spark.createDataFrame(rows, "graph_id string, seq string, subject_id string, subject_label string, predicate string, object_id string, object_label string, origin string")
    nodes, links = g.materialize_graph(t)
    got = {r["id"]: (r["label"], r["group"]) for r in nodes.collect()}
    assert got == {"a": ("A", "domain"), "b": ("B", "user"), "cccccccccc1": ("Entity_ccccccc1", "llm")}
    assert sorted(r["seq"] for r in links.collect()) == ["3", "4"]  # record 2 comes before node a exists


def test_consolidate_merges_labels(spark):
    n = spark.createDataFrame([("g", "1", "X", "domain", "domain", "other", "1"), ("g", "2", "X", "user", "user", "data", "2"), ("g", "3", "Y", "llm", "llm", "system", "3")],
                              "graph_id string, id string, label string, group string, origin_label string, domain_type string, first_seq string")
    l = spark.createDataFrame([("g", "1", "1", "2", "r", "user"), ("g", "2", "1", "3", "r", "user"), ("g", "3", "2", "3", "r", "llm")],
                              "graph_id string, seq string, source string, target string, label string, origin string")
    nodes, links = g.consolidate(n, l)
    x = {r["label"]: r for r in nodes.collect()}
    assert x["X"]["count"] == 2 and x["X"]["group"] == "user" and x["X"]["domain_type"] == "data"
    assert [(r["source"], r["target"], r["count"], r["origins"]) for r in links.collect()] == [("consolidated_X", "consolidated_Y", 2, "llm,user")]


def test_default_triple(spark):
    u = spark.createDataFrame([("g", "2", "B"), ("g", "1", "A"), ("h", "1", "C")], "graph_id string, seq string, label string")
    got = {r["graph_id"]: (r["subject_label"], r["object_label"]) for r in g.default_triple(u).collect()}
    assert got == {"g": ("A", "B"), "h": ("C", "Entity2")}


def test_components_by_contraction(spark):
    import random

    from threadgraph.operators import connectivity as cn

    rng = random.Random(6)
    star = [("star", "hub", f"leaf{i:03d}") for i in range(300)]
    path = [("path", f"{i:03d}", f"{i + 1:03d}") for i in range(400) if i % 57]
    loose = [("loose", f"n{rng.randint(0, 200)}", f"n{rng.randint(0, 200)}") for _ in range(150)]
    edges = star + path + loose + [("loose", "x", "x"), ("loose", "ghost1", "ghost2")]
    links = spark.createDataFrame(edges, "graph_id string, source string, target string")
    ids = {(g, v) for g, a, b in edges for v in (a, b)} - {("loose", "ghost2")} | {("alone", "one")}
    nodes = spark.createDataFrame(sorted(ids), "graph_id string, id string")
    got = {(r["graph_id"], r["id"]): r["component"] for r in cn.connected_components(nodes, cn.adjacency(links)).collect()}
    want = {v: v for v in ids}
    changed = True
    while changed:
        changed = False
        for g, a, b in edges:
            if (g, a) in want and (g, b) in want and want[g, a][1] != want[g, b][1]:
                want[g, a] = want[g, b] = min(want[g, a], want[g, b])
                changed = True
    assert got == {v: c[1] for v, c in want.items()}
    assert cn.connected_components(nodes.limit(0), cn.adjacency(links)).count() == 0


def test_measures_in_waves(spark, tmp_path):
    """A barbell, a star and single nodes in turns of three sources: as by brute force, and nothing of a turn stays."""
    import os
    from itertools import combinations

    from threadgraph.session import checkpoint_dir

    shapes = {"barbell": [*combinations("abcde", 2), ("e", "f"), ("f", "g"), *combinations("ghijk", 2)], "star": [("m", f"l{i}") for i in range(7)]}
    links = spark.createDataFrame([(k, a, b) for k, e in shapes.items() for a, b in e], "graph_id string, source string, target string")
    nodes = spark.createDataFrame([(k, v) for k, e in shapes.items() for v in sorted({x for p in e for x in p})] + [("one", "z"), ("star", "alone")], "graph_id string, id string")
    adj = materialize(cn.adjacency(links))
    root = checkpoint_dir(spark)
    before = set(os.listdir(root))
    node, edge, sums = cn.wave_betweenness(nodes, adj, wave=3)
    left = len(set(os.listdir(root)) - before)
    assert left <= 1 + 4 * 3  # the order of sources, and per turn three results of the four turns
    got_n, got_e = _by_graph(node.collect(), "id", "betweenness"), {}
    for r in edge.collect():
        got_e.setdefault(r["graph_id"], {})[r["a"], r["b"]] = r["betweenness"]
    far = {(r["graph_id"], r["id"]): (r["reach"], r["far"], r["far2"]) for r in sums.collect()}
    close = lambda x: {k: round(v, 6) for k, v in x.items() if v > 1e-9}
    for k, e in shapes.items():
        want_n, want_e = brute.betweenness({x for p in e for x in p}, e)
        assert close(got_n[k]) == close(want_n) and close(got_e[k]) == close(want_e)
        for v in {x for p in e for x in p}:
            d = list(brute.bfs(brute.neighbours(e), v)[0].values())
            assert far[k, v] == (len(d), sum(d), sum(x * x for x in d))
    assert far["one", "z"] == (1, 0.0, 0.0) and len(far) == nodes.count()
    assert sorted(cn.source_sums(nodes, adj, wave=3).collect()) == sorted(sums.collect())
    assert cn.source_sums(nodes.limit(0), adj).count() == 0


def test_links_of_named_records_need_no_join(spark):
    cols = "graph_id string, seq string, subject_id string, subject_label string, predicate string, object_id string, object_label string, origin string"
    plain = [("g", "2", "a", "late", "p", "b", "B", "user"), ("g", "1", "a", "A", "p", "c", "", "domain"), ("h", "3", "b", "B", "q", "a", None, "user"),
             ("g", "2", "a", "late", "p", "b", "B", "user"), ("g", "4", "", "x", "p", "b", "B", "user"), ("g", "5", None, "x", "p", "b", "B", "user"), (None, "6", "a", "A", "p", "b", "B", "user")]
    _, links = g.materialize_graph(spark.createDataFrame(plain, cols))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "parquet" not in plan.lower()
    assert sorted((r.graph_id, r.seq, r.source, r.target) for r in links.collect()) == [("g", "1", "a", "c"), ("g", "2", "a", "b"), ("g", "2", "a", "b"), ("h", "3", "b", "a")]
    odd = plain + [("g", "0", "a", "ns0__x", "p", "c", "C", "user"), ("g", "3", "a", "owl__x", "p", "c", "C", "user"), ("g", None, "d", "D", "p", "c2", "C", "user"),
                   ("g", "7", "d", "D", "p", "a", "A", "user"), ("g", "8", "a", "A", "p", "d", "rdfs__d", "user"), ("g", "9", "a", "A", "p", "e", "rdfs__e", "user")]
    _, links = g.materialize_graph(spark.createDataFrame(odd, cols))
    assert sorted((r.graph_id, r.seq, r.source, r.target) for r in links.collect()) == [
        ("g", "1", "a", "c"), ("g", "2", "a", "b"), ("g", "2", "a", "b"), ("g", "3", "a", "c"), ("h", "3", "b", "a")]
