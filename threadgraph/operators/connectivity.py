"""Iterative graph operators. Every one handles many graphs in one job, keyed by ``graph_id``.

The driver only loops over rounds; state lives in DataFrames that are written to the
checkpoint folder each round, and convergence is one aggregate over the written state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadgraph.operators.common import rnd, top_k
from threadgraph.operators.graph import (
    both_ways, clustering_and_density, degrees, isolated_nodes, predicate_like_id,
    predicate_like_label, simple_edges, valid_links,
)
from threadgraph.session import materialize, release

MICRO = 1_000_000_000
#: Steps along pointers in a round of contraction; chains are short, as pointers follow a random order.
HOPS = 4
#: Sources per graph whose distances to all nodes are held at one time.
WAVE = 64


def khop(adj: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Nodes within ``k`` undirected hops of the seeds, with their hop number.

    ``adj`` has graph_id, node, nbr in both directions.
    """
    ball = seeds.select("graph_id", "id").distinct().withColumn("hop", F.lit(0))
    frontier = ball
    for hop in range(1, k + 1):
        step = adj.join(frontier.select("graph_id", F.col("id").alias("node")), ["graph_id", "node"])
        step = step.select("graph_id", F.col("nbr").alias("id")).distinct().join(ball, ["graph_id", "id"], "left_anti")
        frontier = step.withColumn("hop", F.lit(hop))
        if k > 2:
            frontier = materialize(frontier)
        ball = ball.unionByName(frontier)
    return ball


def adjacency(links: DataFrame) -> DataFrame:
    """Distinct symmetric neighbours, self-loops dropped."""
    return both_ways(simple_edges(links))


def connected_components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Smallest node id of the component of every node, by contraction.

    A round points every node at the neighbour that a hash of the round ranks lowest, follows the
    pointers ``HOPS`` times, merges the nodes that arrive at a root into it and goes on with
    the distinct edges between what is left. Hash order keeps pointer chains short on
    any graph, a star is one step; edges inside a merged group are gone at once, so finished components leave
    and rounds shrink geometrically. Groups carry their smallest id along, and labels run back through the
    rounds at the end. Minima are plain aggregates, combined in the tasks; relabelling
    joins have one row a node on one side, so that a hub's edges can be split by AQE.
    """
    names = nodes.select("graph_id", "id").distinct()
    # numbers in the order of the ids: one long instead of two strings from here on
    # ids first, here and in the joins: sorts compare the first key in place, and large graphs share their graph_id
    names = materialize(names.repartitionByRange("id", "graph_id").sortWithinPartitions("id", "graph_id").withColumn("code", F.monotonically_increasing_id()))
    # merged: sorted names compress so well that a file small enough to broadcast holds many times its size
    code = lambda c: names.select("graph_id", F.col("id").alias(c), F.col("code").alias(f"{c}_code")).hint("merge")
    pairs = adj.filter(F.col("node") < F.col("nbr")).join(code("node"), ["node", "graph_id"]).join(code("nbr"), ["nbr", "graph_id"])
    edges = materialize(pairs.select(F.col("node_code").alias("a"), F.col("nbr_code").alias("b")))
    levels: list[tuple[DataFrame, DataFrame]] = []
    low = None  # smallest number in each group of the level; a node stands for itself at first
    while edges.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("r"), F.col(c).alias("n"))
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")))).alias("e")).select("e.*")
        best = ends.groupBy("node").agg(F.min(rank("nbr")).alias("best"))
        to_best = best.select("node", F.col("best.n").alias("up"))
        # ranks fall at every second step, so pointers only meet in pairs: the lower one of a pair is a root
        back = to_best.join(to_best.select(F.col("node").alias("up"), F.col("up").alias("back")), "up")
        root = (F.col("back") == F.col("node")) & (rank("node") < rank("up"))
        up = materialize(back.select("node", F.when(root, F.col("node")).otherwise(F.col("up")).alias("up")))
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        step = up.withColumn("far", F.col("up"))
        for _ in range(HOPS):
            step = step.select("node", F.col("far").alias("up")).join(far, "up")
        # a group's members have all arrived at its root; the others stay what they are
        arrived = materialize(step.select("node", F.when(F.col("up") == F.col("far"), F.col("up")).otherwise(F.col("node")).alias("root")))
        own = arrived.withColumn("low", F.col("node")) if low is None else arrived.join(low, "node")
        low = materialize(own.groupBy("root").agg(F.min("low").alias("low")).withColumnRenamed("root", "node"))
        levels.append((arrived, low))
        to = lambda c, name: arrived.select(F.col("node").alias(c), F.col("root").alias(name))
        moved = edges.join(to("a", "ra"), "a").join(to("b", "rb"), "b").filter("ra <> rb")
        before, edges = edges, materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        release(before, up)
    found = None
    for arrived, lows in reversed(levels):
        label = lows if found is None else lows.join(found, "node", "left").select("node", F.coalesce("label", "low").alias("low"))
        found = arrived.join(label.select(F.col("node").alias("root"), F.col("low").alias("label")), "root").select("node", "label")
    if found is None:
        return names.select("graph_id", "id", F.col("id").alias("component"))
    out = names.join(found.withColumnRenamed("node", "code"), "code", "left").withColumn("label", F.coalesce("label", "code"))
    # few labels stand for many nodes: their names come from the numbers in use only
    used = out.select(F.col("label").alias("code")).distinct().join(names.select("code", F.col("id").alias("component")), "code")
    done = materialize(out.join(used.withColumnRenamed("code", "label"), "label").select("graph_id", "id", "component"))
    release(names, edges, *[x for level in levels for x in level])
    return done


def component_summary(components: DataFrame) -> DataFrame:
    """Components and size of the largest per graph."""
    sizes = components.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("connected_components"), F.max("size").alias("largest_size"), F.sum("size").alias("n"))


def largest_component(nodes: DataFrame, links: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    sizes = components.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.groupBy("graph_id").agg(F.min_by("component", F.struct(-F.col("size"), F.col("component"))).alias("component"))
    keep = components.join(best, ["graph_id", "component"], "left_semi").select("graph_id", "id")
    return nodes.join(keep, ["graph_id", "id"], "left_semi").select(*nodes.columns), valid_links(keep, links)


def path_components(steps: DataFrame) -> DataFrame:
    """Components over path triples that share an entity; entities are the nodes."""
    s = steps.select(F.col("path_id").alias("graph_id"), F.col("subject").alias("source"), F.col("object").alias("target"))
    nodes = s.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    return connected_components(nodes, materialize(adjacency(s)))


def weighted_links(nodes: DataFrame, links: DataFrame, hub: int = 5) -> DataFrame:
    """Undirected weights that damp hubs and predicate-like ends; one row per pair, as duplicates weigh the same."""
    deg = degrees(links)
    ends = deg.join(nodes.select("graph_id", "id", predicate_like_id(F.col("id")).alias("_pi")), ["graph_id", "id"], "left")
    ends = ends.select("graph_id", "id", "degree", F.coalesce("_pi", F.lit(False)).alias("pl"))
    pairs = links.select("graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    for e in ("a", "b"):
        pairs = pairs.join(ends.select("graph_id", F.col("id").alias(e), F.col("degree").alias(f"d{e}"), F.col("pl").alias(f"p{e}")), ["graph_id", e])
    w = F.when((F.col("da") > hub) | (F.col("db") > hub), 1.0 / (F.sqrt((F.col("da") * F.col("db")).cast("double")) + 0.1)).otherwise(1.0)
    w = F.when(F.col("pa") | F.col("pb"), w * 0.7).otherwise(w)
    return pairs.select("graph_id", "a", "b", w.alias("weight"))


# --- shortest paths ------------------------------------------------------------------------

def _kept(made: list[DataFrame] | None):
    """``materialize`` that notes its tables in ``made``, for a later ``release``."""
    def write(df: DataFrame) -> DataFrame:
        out = materialize(df)
        if made is not None:
            made.append(out)
        return out
    return write


def shortest_distances(nodes: DataFrame, adj: DataFrame, weight: str | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """Distances from the given nodes to all of their components: graph_id, source, node, d (long).

    Only pairs improved in the last round are extended. Weights are compared as whole
    micro-units, so equal lengths tie exactly. Tables written on the way are noted in ``made``.
    """
    write = _kept(made)
    w = F.round(F.col(weight) * MICRO).cast("long") if weight else F.lit(1).cast("long")
    hop = adj.select("graph_id", "node", "nbr", w.alias("w"))
    dist = write(nodes.select("graph_id", F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).cast("long").alias("d")).distinct())
    frontier = dist
    while True:
        cand = frontier.join(hop, ["graph_id", "node"]).groupBy("graph_id", "source", F.col("nbr").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("c"))
        better = cand.join(dist, ["graph_id", "source", "node"], "left").filter(F.col("d").isNull() | (F.col("c") < F.col("d")))
        frontier = write(better.select("graph_id", "source", "node", F.col("c").alias("d")))
        if frontier.limit(1).count() == 0:
            break
        if weight:
            merged = dist.unionByName(frontier).groupBy("graph_id", "source", "node").agg(F.min("d").alias("d"))
            dist = write(merged)
        else:
            dist = dist.unionByName(frontier)
    return dist


def _waves(nodes: DataFrame, size: int):
    """The nodes of every graph in turns of ``size``; small graphs are done after the first turn.

    Turns come from counts per (graph, hash bucket), so no graph is put in order in one task.
    """
    ids = nodes.select("graph_id", "id").distinct()
    fine = Window.partitionBy("graph_id", "_b").orderBy("id")
    ids = ids.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(4096))).withColumn("_i", F.row_number().over(fine) - 1)
    counts = ids.groupBy("graph_id", "_b").agg(F.count(F.lit(1)).alias("_c"))
    start = F.coalesce(F.sum("_c").over(Window.partitionBy("graph_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = F.floor((F.col("_i") + F.col("_start")) / size).cast("int")
    ids = materialize(ids.join(counts.withColumn("_start", start), ["graph_id", "_b"]).select("graph_id", "id", turn.alias("wave")))
    for i in range((ids.agg(F.max("wave")).first()[0] or 0) + 1):
        yield ids.filter(F.col("wave") == i).select("graph_id", "id")


def source_sums(nodes: DataFrame, adj: DataFrame, wave: int | None = None) -> DataFrame:
    """Per source: nodes reached (itself included), sum and sum of squares of hop distances.

    Distances of ``wave`` sources a graph exist at a time and are deleted once they are added up.
    """
    parts = []
    for some in _waves(nodes, wave or WAVE):
        made: list[DataFrame] = []
        parts.append(materialize(distance_sums(shortest_distances(some, adj, made=made))))
        release(*made)
    return _union(parts)


def distance_sums(dist: DataFrame) -> DataFrame:
    """``source_sums`` of given pairs."""
    d = F.col("d").cast("double")
    return dist.groupBy("graph_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("reach"), F.sum(d).alias("far"), F.sum(d * d).alias("far2"))


def path_length_stats(sums: DataFrame) -> DataFrame:
    """Mean (2) and sample variance (4) of hop lengths over ordered pairs. ``sums``: as of ``source_sums``."""
    g = sums.filter("reach > 1").groupBy("graph_id").agg(F.sum(F.col("reach") - 1).alias("n"), F.sum("far").alias("s"), F.sum("far2").alias("q"))
    return g.select(
        "graph_id", rnd(F.col("s") / F.col("n"), 2).alias("avg_path_length"),
        F.when(F.col("n") > 1, rnd((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), 4)).otherwise(0.0).alias("path_length_variance"))


def wave_betweenness(nodes: DataFrame, adj: DataFrame, weight: str | None = None, wave: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node and edge betweenness and ``source_sums`` over all sources, ``wave`` sources a graph at a time.

    Each turn leaves one number per node, edge and source; its distances, path counts and flows are
    deleted, so storage follows nodes and edges and not their square.
    """
    sums, by_node, by_edge = [], [], []
    for some in _waves(nodes, wave or WAVE):
        made: list[DataFrame] = []
        dist = shortest_distances(some, adj, weight, made)
        node, edge = betweenness(adj, dist, weight, made)
        sums.append(materialize(distance_sums(dist)))
        by_node.append(materialize(node))
        by_edge.append(materialize(edge))
        release(*made)
    add = lambda parts, *by: _union(parts).groupBy("graph_id", *by).agg(F.sum("betweenness").alias("betweenness"))
    return add(by_node, "id"), add(by_edge, "a", "b"), _union(sums)


def betweenness(adj: DataFrame, dist: DataFrame, weight: str | None = None, made: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Unnormalised node and edge betweenness over the sources of ``dist``.

    Shortest-path edges of every source form a DAG. Path counts flow forward and
    dependencies backward, one DataFrame join per hop for all graphs and sources at once.
    """
    write = _kept(made)
    w = F.round(F.col(weight) * MICRO).cast("long") if weight else F.lit(1).cast("long")
    hop = adj.select("graph_id", F.col("node").alias("v"), F.col("nbr").alias("w"), w.alias("len"))
    d = dist.select("graph_id", "source", "node", "d")
    dag = d.withColumnRenamed("node", "v").join(hop, ["graph_id", "v"]).join(
        d.select("graph_id", "source", F.col("node").alias("w"), F.col("d").alias("dw")), ["graph_id", "source", "w"])
    dag = write(dag.filter("d + len = dw").select("graph_id", "source", "v", "w"))

    cur = d.filter("source = node").select("graph_id", "source", F.col("node").alias("v"), F.lit(1.0).alias("x"))
    counts = [cur]
    while True:
        cur = write(dag.join(cur, ["graph_id", "source", "v"]).groupBy("graph_id", "source", F.col("w").alias("v")).agg(F.sum("x").alias("x")))
        if cur.limit(1).count() == 0:
            break
        counts.append(cur)
    sigma = counts[0]
    for c in counts[1:]:
        sigma = sigma.unionByName(c)
    sigma = sigma.groupBy("graph_id", "source", "v").agg(F.sum("x").alias("sigma"))
    part = dag.join(sigma, ["graph_id", "source", "v"]).join(
        sigma.select("graph_id", "source", F.col("v").alias("w"), F.col("sigma").alias("sw")), ["graph_id", "source", "w"])
    part = write(part.select("graph_id", "source", "v", "w", (F.col("sigma") / F.col("sw")).alias("share")))

    x = part.select("graph_id", "source", "w").distinct().withColumn("x", F.lit(1.0))
    edge_parts, node_parts = [], []
    for _ in range(len(counts)):
        flow = write(part.join(x, ["graph_id", "source", "w"]).select("graph_id", "source", "v", "w", (F.col("share") * F.col("x")).alias("f")))
        if flow.limit(1).count() == 0:
            break
        edge_parts.append(flow.groupBy("graph_id", "v", "w").agg(F.sum("f").alias("f")))
        node_flow = flow.groupBy("graph_id", "source", "v").agg(F.sum("f").alias("f"))
        node_parts.append(node_flow.filter("v <> source").groupBy("graph_id", "v").agg(F.sum("f").alias("f")))
        x = node_flow.select("graph_id", "source", F.col("v").alias("w"), F.col("f").alias("x"))
    if not edge_parts:
        none = adj.limit(0)
        return (none.select("graph_id", F.col("node").alias("id"), F.lit(0.0).alias("betweenness")),
                none.select("graph_id", F.col("node").alias("a"), F.col("nbr").alias("b"), F.lit(0.0).alias("betweenness")))
    node = _union(node_parts).groupBy("graph_id", F.col("v").alias("id")).agg((F.sum("f") / 2).alias("betweenness"))
    edge = _union(edge_parts).groupBy("graph_id", F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).agg((F.sum("f") / 2).alias("betweenness"))
    return node, edge


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def centralities(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Mean and maximum of degree, betweenness and closeness centrality per graph (4 digits)."""
    per = nodes.select("graph_id", "id").distinct()
    n = per.groupBy("graph_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    deg = adj.groupBy("graph_id", F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    node_b, _, far = wave_betweenness(per, adj)
    j = per.join(n, "graph_id").join(deg, ["graph_id", "id"], "left").join(far, ["graph_id", "id"], "left").join(node_b, ["graph_id", "id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    j = j.select(
        "graph_id", F.when(F.col("n") > 1, zero("deg") / (F.col("n") - 1)).otherwise(1.0).alias("dc"),
        F.when(F.col("n") > 2, 2.0 * zero("betweenness") / pairs).otherwise(0.0).alias("bc"),
        F.when(F.col("far") > 0, (F.col("n") - 1) / F.col("far")).otherwise(0.0).alias("cc"),
        (F.col("reach") == F.col("n")).alias("full"))
    agg = j.groupBy("graph_id").agg(
        F.avg("dc").alias("a1"), F.max("dc").alias("m1"), F.avg("bc").alias("a2"), F.max("bc").alias("m2"),
        F.avg("cc").alias("a3"), F.max("cc").alias("m3"), F.min("full").alias("full"))
    closed = lambda c: F.when(F.col("full"), rnd(F.col(c), 4)).otherwise(0.0)
    return agg.select(
        "graph_id", rnd(F.col("a1"), 4).alias("avg_degree_centrality"), rnd(F.col("m1"), 4).alias("max_degree_centrality"),
        rnd(F.col("a2"), 4).alias("avg_betweenness_centrality"), rnd(F.col("m2"), 4).alias("max_betweenness_centrality"),
        closed("a3").alias("avg_closeness_centrality"), closed("m3").alias("max_closeness_centrality"))


def consistency_metrics(nodes: DataFrame, links: DataFrame, adj: DataFrame | None = None) -> DataFrame:
    """Clustering, density, path lengths and components; fixed values below three nodes."""
    adj = adj if adj is not None else materialize(adjacency(valid_links(nodes, links)))
    base = clustering_and_density(nodes, links)
    paths = path_length_stats(source_sums(nodes, adj))
    comps = component_summary(connected_components(nodes, adj))
    j = base.join(paths, "graph_id", "left").join(comps, "graph_id")
    small = F.col("node_count") < 3
    pick = lambda c: F.when(small, F.lit(0.0)).otherwise(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return j.select(
        "graph_id", pick("clustering_coefficient"), pick("graph_density"), pick("path_length_variance"), pick("avg_path_length"),
        F.when(small, F.lit(1)).otherwise(F.col("connected_components")).cast("long").alias("connected_components"),
        F.when(small, F.lit(1.0)).otherwise(rnd(F.col("largest_size") / F.col("n"), 4)).alias("largest_component_ratio"))


def connectivity_report(nodes: DataFrame, links: DataFrame, hub: int = 5) -> tuple[DataFrame, DataFrame]:
    """Summary per graph, and the whole id lists behind it as rows.

    Details are (graph_id, kind, key, value): isolated and predicate-like node ids, hubs with
    their degree and components with their size; rows instead of arrays, so a large graph
    never has to fit into one record.
    """
    deg = degrees(links)
    iso = isolated_nodes(nodes, links)
    pred = nodes.filter(predicate_like_id(F.col("id")))
    hubs = deg.filter(F.col("degree") >= hub)
    comps = connected_components(nodes, materialize(adjacency(valid_links(nodes, links))))
    sizes = materialize(comps.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("size")))
    row = lambda df, kind, key, value: df.select("graph_id", F.lit(kind).alias("kind"), F.col(key).alias("key"), value.cast("long").alias("value"))
    none = F.lit(None)
    details = row(iso, "isolated", "id", none).unionByName(row(pred, "predicate", "id", none)).unionByName(
        row(hubs, "hub", "id", F.col("degree"))).unionByName(row(sizes, "component", "component", F.col("size")))

    count = lambda df, name: df.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name))
    out = count(nodes, "total_nodes")
    for extra in (count(links, "total_links"), count(iso, "isolated_count"), count(pred, "predicate_nodes"), count(hubs, "hub_count"), count(sizes, "components"),
                  deg.groupBy("graph_id").agg(F.avg("degree").alias("average_degree"), F.max("degree").alias("max_degree")),
                  sizes.groupBy("graph_id").agg(F.max("size").alias("largest_component"))):
        out = out.join(extra, "graph_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    summary = out.select("graph_id", "total_nodes", *[zero(c) for c in ("total_links", "isolated_count", "predicate_nodes", "hub_count", "max_degree")],
                         rnd(F.coalesce("average_degree", F.lit(0.0)), 4).alias("average_degree"), "components", "largest_component")
    return summary, details


def assign_isolated(isolated: DataFrame, groups: DataFrame, limit: int = 20) -> DataFrame:
    """The first isolated nodes, each to the group that is smallest at that moment.

    Filling the smallest group one by one equals taking the slots (group, size + j) in order
    of (size + j, group), so both sides are numbered and joined. ``groups``: graph_id, group, size.
    """
    nodes = top_k(isolated, ["graph_id"], [F.col("id")], limit, "slot").select("graph_id", "id", "slot")
    near = top_k(groups, ["graph_id"], [F.col("size"), F.col("group")], limit)
    slots = near.select("graph_id", "group", F.explode(F.sequence(F.col("size"), F.col("size") + limit - 1)).alias("level"))
    slots = top_k(slots, ["graph_id"], [F.col("level"), F.col("group")], limit, "slot")
    return nodes.join(slots.select("graph_id", "group", "slot"), ["graph_id", "slot"]).select("graph_id", "id", "group")
