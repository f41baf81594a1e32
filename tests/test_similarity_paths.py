import numpy as np
import pytest
from pyspark.sql import functions as F

from threadgraph.operators import similarity as sm
from threadgraph.plans import evaluation as ev
from threadgraph.plans import paths as pt


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 8))
    m = np.vstack([c + 0.4 * rng.normal(size=(60, 8)) for c in centers] + [np.zeros((2, 8))])
    df = spark.createDataFrame([("g", f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(m)], "graph_id string, id string, vec array<double>").cache()
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return df, np.round(u @ u.T, 9)


@pytest.mark.parametrize("t", [0.9, 0.6, 0.0, -0.5])
def test_pruned_join_is_exact(vecs, t, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_ROWS", 17)  # force many blocks
    df, s = vecs
    got = {(r["left_id"], r["right_id"]) for r in sm.similar_pairs(df, df, t).collect()}
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(len(s)) for j in range(len(s)) if i != j and s[i, j] >= t}
    assert got == want


@pytest.mark.parametrize("rows", [17, 4096])
def test_topk_and_max(vecs, rows, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_ROWS", rows)
    df, s = vecs
    rows = sm.similar_pairs(df, df, None, 3).collect()
    assert len(rows) == 3 * len(s)
    top = {}
    for r in rows:
        top.setdefault(r["left_id"], []).append(r["similarity"])
    masked = s - 10 * np.eye(len(s))
    for i in range(len(s)):
        assert sorted(top[f"v{i:03d}"], reverse=True) == sorted(masked[i], reverse=True)[:3]
    users = df.filter("id < 'v010'")
    got = {r["id"]: r["similarity"] for r in sm.max_similarity(users, df).collect()}
    assert all(abs(got[f"v{i:03d}"] - s[:10, i].max()) < 1e-9 for i in range(len(s)))


def test_topk_with_threshold_and_graphs_of_different_size(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(8)
    data = {(g, f"{i:03d}"): rng.normal(size=4).round(1) for g, n in (("a", 150), ("b", 3), ("c", 40)) for i in range(n)}
    df = spark.createDataFrame([(g, i, [float(x) for x in v]) for (g, i), v in data.items()], "graph_id string, id string, vec array<double>")
    got = {}
    for r in sm.similar_pairs(df, df, 0.8, 4, keep_self=True).collect():
        got.setdefault((r["graph_id"], r["left_id"]), []).append((-r["similarity"], r["right_id"]))
    unit = {k: v / np.linalg.norm(v) for k, v in data.items()}
    for (g, i), v in unit.items():
        want = sorted((-round(float(v @ w), 9), j) for (h, j), w in unit.items() if h == g)
        assert sorted(got[g, i]) == [x for x in want if x[0] <= -0.8][:4]


def test_bounds_leave_far_cells_out(spark, monkeypatch):
    """Without a threshold, rows of separate clusters visit their own cells only."""
    monkeypatch.setattr(sm, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(1)
    m = np.vstack([c + 0.01 * rng.normal(size=(150, 12)) for c in 5 * np.eye(12)])
    df = spark.createDataFrame([("g", f"{i:04d}", [float(x) for x in r]) for i, r in enumerate(m)], "graph_id string, id string, vec array<double>")
    pairs, joined = [], sm._joined_cells
    monkeypatch.setattr(sm, "_joined_cells", lambda left, *a: pairs.append(left.count()) or joined(left, *a))
    assert sm.similar_pairs(df, df, None, 3).count() == 3 * len(m)
    assert pairs[0] == len(m) and pairs[1] < 4 * len(m)  # of 18 cells


def test_propagate_unit_norm(vecs, spark):
    df, _ = vecs
    links = df.filter("id < 'v200'").select("graph_id", F.col("id").alias("source"), F.lit("v000").alias("target"))
    out = sm.propagate(df, links, 2).collect()
    assert all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-9 for r in out if r["id"] < "v240")


def test_ring_needs_more_than_three(spark):
    e = spark.createDataFrame([("a", x) for x in "1234"] + [("b", x) for x in "12"], "graph_id string, id string")
    got = {(r["subject_id"], r["object_id"]) for r in sm.ring_fallback(e, e, e.limit(0)).collect()}
    assert got == {("1", "2"), ("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("2", "1"), ("3", "4"), ("3", "1"), ("3", "2")}


STEPS = [("p", 1, "u", "implements", "s", "business", "system", True, False), ("p", 2, "s", "uses", "d", "system", "data", False, False),
         ("p", 3, "d", "enables", "t", "data", "technology", False, False)]
COLS = "path_id string, pos long, subject string, predicate string, object string, subject_layer string, object_layer string, subject_is_user boolean, object_is_user boolean"


def test_reward_by_hand(spark):
    r = pt.path_reward(spark.createDataFrame(STEPS, COLS)).first()
    length, prog, coh = 0.3, 1.0 + 0.3, 1.0 + 0.4
    want = 0.30 * length + 0.25 * prog + 0.20 * coh + 0.10 * 1.0 + 0.08 * (1.0 + 0.7 + 1.0) / 3 + 0.05 * min(1 / 3 + 0.3, 1.0) + 0.04
    assert abs(r["reward"] - want) < 1e-9


@pytest.fixture(scope="module")
def search(spark):
    rows = []
    for gid in ("g", "h"):
        edges = [("u", "s1", "implements"), ("u", "s2", "other"), ("s1", "d1", "uses"), ("s1", "d2", "enables"), ("d2", "t1", "solves"), ("d1", "t2", "other"), ("s2", "d1", "uses"), ("t1", "u", "other")]
        layer = {"u": "business", "s": "system", "d": "data", "t": "technology"}
        rows += [(gid, f"{i:02d}", a, p, b, layer[a[0]], layer[b[0]], a == "u", b == "u") for i, (a, b, p) in enumerate(edges)]
    return spark.createDataFrame(rows, "graph_id string, seq string, subject string, predicate string, object string, subject_layer string, object_layer string, subject_is_user boolean, object_is_user boolean")


def test_beam_finds_layered_path_and_counters_agree(search):
    best = pt.beam_search(search, depth=4).cache()
    rows = {r["graph_id"]: r for r in best.collect()}
    assert rows["g"]["path_key"] == rows["h"]["path_key"]
    steps = pt.state_steps(best).withColumn("subject_is_user", F.col("subject") == "u").withColumn("object_is_user", F.col("object") == "u")
    again = {r["path_id"]: r["reward"] for r in pt.path_reward(steps).collect()}
    assert abs(again["g"] - rows["g"]["reward"]) < 1e-6  # running counters equal the aggregate


def test_wider_beam_is_not_worse(search):
    r = [pt.beam_search(search, width=w, depth=3).agg(F.min("score")).first()[0] for w in (1, 3)]
    assert r[1] >= r[0]


def test_layered_and_fallback(search):
    assert pt.layered_path(search, depth=2).count() == 2
    f = [r["subject"] for r in pt.fallback_path(search).filter("graph_id = 'g'").orderBy("pos").collect()]
    assert f[:2] == ["u", "u"] and len(f) == 5


def test_choose_path_is_the_better_one_processed(search):
    only = search.filter("graph_id = 'g'").withColumn("graph_id", F.lit("x"))
    none = only.withColumns({"graph_id": F.lit("y"), "subject_is_user": F.lit(False), "subject_layer": F.lit("other"), "object_layer": F.lit("other")})
    both = only.unionByName(none)
    got = pt.choose_path(both, depth=2, stage_depth=1).collect()
    steps = sorted((r["pos"], r["subject"], r["object"]) for r in got if r["path_id"] == "x")
    beam, staged = pt.beam_search(both, depth=2).drop("score"), pt.layered_path(both, depth=1)
    best = pt.select_best_path(beam.unionByName(staged.select(beam.columns)), path="path_key").filter("graph_id = 'x'")
    want = pt.post_process_path(pt.state_steps(best), both).collect()
    assert steps == sorted((r["pos"], r["subject"], r["object"]) for r in want)
    # no user subject and no known layer: nothing opens a path, so the first triples stand in
    assert sorted((r["pos"], r["subject"], r["object"]) for r in got if r["path_id"] == "y") == [
        (1, "u", "s1"), (2, "u", "s2"), (3, "s1", "d1"), (4, "s1", "d2"), (5, "d2", "t1")]


def test_seeds_per_graph(spark):
    users = spark.createDataFrame([("g", "u1", "red ring"), ("h", "u2", "blue big box"), ("k", "u3", "none")], "graph_id string, id string, label string")
    # the best match of u2 in all graphs stands in g; only the one of its own graph counts
    ents = [("g", "1", "red ring"), ("g", "2", "blue big box here"), ("h", "3", "big tree"), ("h", "4", "red ring"), *[("k", str(i), f"x{i}") for i in range(5, 9)]]
    got = {(r["graph_id"], r["id"]) for r in sm.semantic_seeds(users, spark.createDataFrame(ents, "graph_id string, id string, label string")).collect()}
    assert got == {("g", "1"), ("h", "3"), ("k", "5"), ("k", "6"), ("k", "7")}


def test_post_process_adds_bridges(search, spark):
    steps = spark.createDataFrame([("g", 1, "u", "implements", "s1", "business", "system"), ("g", 2, "s1", "enables", "d2", "system", "data"), ("g", 3, "u", "implements", "s1", "business", "system"),
                                   ("g", 4, "d2", "solves", "t1", "data", "technology")], "path_id string, pos long, subject string, predicate string, object string, subject_layer string, object_layer string")
    got = [(r["subject"], r["object"]) for r in pt.post_process_path(steps, search).orderBy("pos").collect()]
    assert got == [("u", "s1"), ("s1", "d2"), ("d2", "t1"), ("t1", "u")]


def test_p_values():
    # t = 2.0 with 10 degrees of freedom has a two-sided p of 0.07339
    r = 2.0 / np.sqrt(10 + 4.0)
    assert abs(ev.two_sided_p(r, 12) - 0.073388) < 1e-5
    assert ev.two_sided_p(0.0, 30) == pytest.approx(1.0)


def test_topic_match_mixes_vectors_and_tokens(spark):
    from threadgraph.operators.joins import topic_match

    vec = spark.createDataFrame([("cloud", [1.0, 0.0]), ("server farm", [0.9, 0.1]), ("apple tree", [0.0, 1.0])], "topic string, vec array<double>")
    prompts = spark.createDataFrame([("cloud",), ("big tree",), ("42",)], "prompt_topic string")
    topics = spark.createDataFrame([("server farm",), ("apple tree",), ("no vector tree",)], "topic string")
    got = {(r["prompt_topic"], r["topic"]) for r in topic_match(prompts, topics, 0.3, vec).collect()}
    assert got == {("cloud", "server farm"), ("big tree", "apple tree")}


def test_word_overlap_brute(spark):
    from threadgraph.operators.joins import word_overlap_match

    users = {"u1": "red big ring", "u2": "blue", "u3": "none here", "u4": "green small ring box"}
    ents = {"e1": "red ring", "e2": "big red ring", "e3": "ring", "e4": "blue box", "e5": "ring small green", "e6": "small ring green"}
    frame = lambda d, c: spark.createDataFrame(list(d.items()), f"{c} string, label string")
    got = {r["user_id"]: (r["entity_id"], r["shared"]) for r in word_overlap_match(frame(users, "user_id"), frame(ents, "entity_id")).collect()}
    want = {}
    for u, t in users.items():
        best = max(sorted(ents), key=lambda e: len(set(t.split()) & set(ents[e].split())))
        n = len(set(t.split()) & set(ents[best].split()))
        if n:
            want[u] = (best, n)
    assert got == want


def test_token_join_brute(spark, monkeypatch):
    import random

    from threadgraph.operators import joins as jn

    monkeypatch.setattr(jn, "SLICE", 7)  # the hot words are spread over many slices
    rnd, vocab = random.Random(4), ["data", "the"] * 6 + [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 14)))
    left, right = [*{text() for _ in range(60)}, "17", ""], [*{text() for _ in range(90)}, "3.5", ""]
    a = spark.createDataFrame([(x,) for x in left] + [(None,)], "prompt_topic string")
    b = spark.createDataFrame([(x,) for x in right] * 2 + [(None,)], "topic string")
    bag = lambda t: set(t.split()) if not t.replace(".", "").isdigit() else set()
    for t in (0.0, 0.3, 0.5, 0.8):
        sim = {(x, y): len(bag(x) & bag(y)) / (len(bag(x)) * len(bag(y))) ** 0.5 for x in left for y in right if bag(x) & bag(y)}
        want = {p: s for p, s in sim.items() if s > t}
        got = [(r["prompt_topic"], r["topic"], r["similarity"]) for r in jn.topic_match(a, b, t).collect()]
        assert len(got) == len(want) and all(abs(want[x, y] - s) < 1e-12 for x, y, s in got)
        assert {r[0] for r in jn.topics_with_match(a, b, t).collect()} == {x for x, _ in want}
    assert jn.topic_match(a, b.limit(0)).count() == jn.topic_match(a.limit(0), b).count() == 0


def test_similarity_strips_hold_few_numbers(spark):
    """Peak memory of the functions that Python workers run follows a strip, not leaves times rows of a batch."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(8)
    pivots = rng.normal(size=(2048, 8))
    tree = sm.PivotTree(pivots / np.linalg.norm(pivots, axis=1, keepdims=True), 16)
    tree.lo[:], tree.hi[:] = 0.2, 0.9
    vecs, least = pd.Series(list(rng.normal(size=(4000, 8)))), pd.Series([0.8] * 4000)
    tracemalloc.start()
    cells = next(tree.visits().func(iter([(vecs, least)])))
    place = next(tree.leaf().func(iter([vecs])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6  # one product of all rows and leaves alone takes 65 MB
    m = sm._unit_rows(vecs)
    b = np.arccos(np.clip(m @ tree.pivots.T, -1.0, 1.0))
    near = np.maximum(0.0, np.maximum(b - tree.hi, tree.lo - b)) <= np.arccos(0.8) + sm.SLACK
    assert all(list(c) == sorted(set(tree.cell_of[x])) for c, x in zip(cells, near))
    assert (place["leaf"].to_numpy() == np.argmax(m @ tree.pivots.T, axis=1)).all()


def test_best_of_a_strip_against_sorting():
    rng = np.random.default_rng(9)
    for share in (1.0, 0.3, 0.02):
        s = np.round(rng.normal(size=(40, 200)), 1)  # many ties
        ok = rng.random(s.shape) < share
        want = np.zeros_like(ok)
        for r in range(len(s)):
            order = sorted(np.flatnonzero(ok[r]), key=lambda c: (-s[r, c], c))[:7]
            want[r, order] = True
        assert (sm._best(s, ok.copy(), 7) == want).all()


def test_semantic_connections_compute_the_first_hop_once(spark, monkeypatch):
    calls, real = [], sm.materialize
    monkeypatch.setattr(sm, "materialize", lambda df: calls.append(df.columns) or real(df))
    rows = [("all", f"v{i}", f"l{i}", [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(60, 6)))]
    e = spark.createDataFrame(rows, "graph_id string, id string, label string, vec array<double>")
    out = sm.semantic_connections(e.filter("id < 'v2'").select("graph_id", "id", "vec"), e, 0.3)
    assert any("hop" in c for c in calls) and out.count() == 20
