"""Relational graph operators: endpoints, degrees, node and link tables, profiles.

Triples: graph_id, seq, subject_id, subject_label, predicate, object_id, object_label, origin.
Nodes: graph_id, id, label, ...   Links: graph_id, seq, source, target, label, origin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.functions.lexicons import ENTITY_HINTS, PREDICATE_PREFIXES_ID, PREDICATE_PREFIXES_LABEL
from threadgraph.functions.text import clean_label
from threadgraph.operators.common import first_by, grouped, rnd, top_k
from threadgraph.session import materialize

# fixed values
GROUP_PRIORITY = {"user": 5, "gnn": 4, "llm": 3, "connection": 2, "domain": 1, "other": 0}
LAYERS = ["business", "system", "data", "technology"]


def starts_with_any(col: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [col.startswith(p) for p in prefixes])


def predicate_like_id(col: Column) -> Column:
    return F.coalesce(starts_with_any(col, PREDICATE_PREFIXES_ID), F.lit(False))


def predicate_like_label(col: Column) -> Column:
    return F.coalesce(starts_with_any(col, PREDICATE_PREFIXES_LABEL), F.lit(False))


# --- endpoints and sets -------------------------------------------------------------------

def triple_endpoints(triples: DataFrame) -> DataFrame:
    """Two rows per triple (subject first), one scan of the input."""
    side = lambda p, n: F.struct(
        F.lit(n).alias("side"), F.col(f"{p}_id").alias("id"), F.col(f"{p}_label").alias("label"))
    rest = [c for c in triples.columns if not c.startswith(("subject", "object"))]
    ends = triples.select(*rest, F.explode(F.array(side("subject", 0), side("object", 1))).alias("e"))
    return ends.select(*rest, "e.side", "e.id", "e.label")


def link_endpoints(links: DataFrame) -> DataFrame:
    return links.select("graph_id", F.explode(F.array("source", "target")).alias("id"))


def entity_set(triples: DataFrame) -> DataFrame:
    """Distinct labels over subjects and objects."""
    return triple_endpoints(triples).select("graph_id", "label").distinct()


def entity_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return entity_set(left).intersect(entity_set(right))


def isolated_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return nodes.join(link_endpoints(links), ["graph_id", "id"], "left_anti")


def combine_records(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Union of record sets in the given rank order; missing columns become null."""
    tagged = [df.withColumn("source_rank", F.lit(rank)) for rank, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_results(text_hits: DataFrame, topic_hits: DataFrame) -> DataFrame:
    """Text hits, then topic hits, ranked 1..n per query."""
    both = text_hits.withColumn("source_ord", F.lit(0)).unionByName(topic_hits.withColumn("source_ord", F.lit(1)))
    counts = both.groupBy("query_id", "source_ord").agg(F.max("rank").alias("_n"))
    first = counts.filter("source_ord = 0").select("query_id", F.col("_n").alias("_off"))
    out = both.join(first, "query_id", "left")
    offset = F.when(F.col("source_ord") == 1, F.coalesce(F.col("_off"), F.lit(0))).otherwise(0)
    return out.withColumn("rank", (F.col("rank") + offset).cast("long")).drop("_off", "source_ord")


# --- degrees ------------------------------------------------------------------------------

def degrees(links: DataFrame) -> DataFrame:
    """Both ends count; self-loops count twice and parallel links count each."""
    return link_endpoints(links).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("degree"))


def digraph_degrees(links: DataFrame) -> DataFrame:
    """In- and out-degree on distinct directed pairs."""
    pairs = links.select("graph_id", "source", "target").distinct()
    ends = pairs.select("graph_id", F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("graph_id", F.col("e.id").alias("id")).agg(
        F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def simple_edges(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Undirected distinct pairs a <= b, self-loops kept; both ends must be nodes when given."""
    out = links.select("graph_id", "source", "target")
    if nodes is not None:
        out = valid_links(nodes, out)
    return out.select("graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Symmetric adjacency (node, nbr) of undirected pairs without self-loops."""
    return edges.filter("a <> b").select("graph_id", F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")))).alias("e")).select("graph_id", "e.node", "e.nbr")


# --- joins between nodes and links ---------------------------------------------------------

def links_to_triples(links: DataFrame, nodes: DataFrame, how: str = "left") -> DataFrame:
    """Attach both endpoint labels; ``left`` keeps unresolved ends with an empty label."""
    lab = nodes.select("graph_id", "id", "label")
    out = links.join(lab.select("graph_id", F.col("id").alias("source"), F.col("label").alias("_s")), ["source", "graph_id"], how)
    out = out.join(lab.select("graph_id", F.col("id").alias("target"), F.col("label").alias("_o")), ["target", "graph_id"], how)
    return out.select(
        "graph_id", "seq", F.col("source").alias("subject_id"), F.coalesce("_s", F.lit("")).alias("subject_label"),
        F.col("label").alias("predicate"), F.col("target").alias("object_id"),
        F.coalesce("_o", F.lit("")).alias("object_label"), "origin")


def valid_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    # the end comes first in the join key: rows are sorted by it, and a graph's rows share their graph_id
    ids = nodes.select("graph_id", "id")
    out = links.join(ids.withColumnRenamed("id", "source"), ["source", "graph_id"], "left_semi")
    return out.join(ids.withColumnRenamed("id", "target"), ["target", "graph_id"], "left_semi").select(*links.columns)


def orphan_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with at least one end that is not a node."""
    ids = nodes.select("graph_id", "id").withColumn("_hit", F.lit(True))
    out = links.join(ids.select("graph_id", F.col("id").alias("source"), F.col("_hit").alias("_hs")), ["graph_id", "source"], "left")
    out = out.join(ids.select("graph_id", F.col("id").alias("target"), F.col("_hit").alias("_ht")), ["graph_id", "target"], "left")
    return out.filter(F.col("_hs").isNull() | F.col("_ht").isNull()).select(*links.columns)


def induce(nodes: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes in the id set and links with both ends in it."""
    keep = nodes.join(ids.select("graph_id", "id"), ["graph_id", "id"], "left_semi").select(*nodes.columns)
    return keep, valid_links(ids, links)


def incident_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with either end in the id set, each once."""
    ids = ids.select("graph_id", "id")
    by_source = links.join(ids.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_semi").select(*links.columns)
    rest = links.join(ids.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_anti").select(*links.columns)
    by_target = rest.join(ids.withColumnRenamed("id", "target"), ["graph_id", "target"], "left_semi").select(*links.columns)
    return by_source.unionByName(by_target)


def exact_entity_match(nodes: DataFrame, user_triples: DataFrame) -> DataFrame:
    wanted = triple_endpoints(user_triples).select("graph_id", clean_label(F.col("label")).alias("_k")).distinct()
    return nodes.withColumn("_k", clean_label(F.col("label"))).join(wanted, ["graph_id", "_k"], "left_semi").select(*nodes.columns)


# --- materialise and split -----------------------------------------------------------------

def materialize_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id (first record wins) and links whose two nodes exist at that record.

    Nodes are written once, as every use of a lazy node table would aggregate all records again. A record whose two
    labels are names founds its nodes unless they exist, so its link needs no join: links of such records
    are read from ``triples``, which callers write first. Only records with a predicate-like label or without ``seq`` are joined
    with the nodes; where there are some, the links are written too.
    """
    ok = triples.filter((F.col("subject_id") != "") & (F.col("object_id") != ""))
    ends = triple_endpoints(ok).filter(~predicate_like_label(F.col("label")))
    ends = ends.withColumn("label", F.when(F.coalesce(F.col("label"), F.lit("")) == "",
                                           F.concat(F.lit("Entity_"), F.substring("id", -8, 8))).otherwise(F.col("label")))
    cols = ["label", "origin"] + (["domain_type"] if "domain_type" in triples.columns else [])
    nodes = grouped(ends, "graph_id", "id").agg(
        F.min_by(F.struct(*cols, "seq"), F.struct("seq", "side")).alias("n"))
    dom = F.coalesce(F.col("n.domain_type"), F.lit("other")) if "domain_type" in cols else F.lit("other")
    nodes = nodes.select("graph_id", "id", F.col("n.label").alias("label"), F.col("n.origin").alias("group"),
                         F.col("n.origin").alias("origin_label"), dom.alias("domain_type"), F.col("n.seq").alias("first_seq"))
    nodes = materialize(nodes)
    named = ~predicate_like_label(F.col("subject_label")) & ~predicate_like_label(F.col("object_label")) & F.col("seq").isNotNull()
    cols = ["graph_id", "seq", F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("predicate").alias("label"), "origin"]
    links, rest = ok.filter(named & F.col("graph_id").isNotNull()).select(*cols), ok.filter(~named).select(*cols)
    # a node with a record without seq has no first record, so that none of its links comes after it
    undated = nodes.filter(F.col("first_seq").isNull()).select("graph_id", "id")
    joined = not undated.isEmpty()
    for end in ("source", "target") if joined else ():
        links = links.join(undated.withColumnRenamed("id", end), [end, "graph_id"], "left_anti")
    if not rest.isEmpty():
        for end in ("source", "target"):
            seen = nodes.select("graph_id", F.col("id").alias(end), F.col("first_seq").alias("_f"))
            rest = rest.join(seen, [end, "graph_id"]).filter("_f <= seq").drop("_f")
        links, joined = links.unionByName(rest), True
    links = links.select("graph_id", "seq", "source", "target", "label", "origin")
    return nodes, materialize(links) if joined else links


def split_by_origin(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One ``subgraph`` per origin plus ``traversal`` (connection and gnn) and ``combined``."""
    own_nodes = nodes.filter(F.col("group") == F.col("origin_label")).withColumn("subgraph", F.col("group"))
    ids = own_nodes.select("graph_id", "id", "subgraph")
    own_links = links.withColumn("subgraph", F.col("origin"))
    for end in ("source", "target"):
        own_links = own_links.join(ids.withColumnRenamed("id", end), [end, "graph_id", "subgraph"], "left_semi").select(*own_links.columns)
    own_links = materialize(own_links)
    walk = lambda df: df.filter(F.col("subgraph").isin("connection", "gnn")).withColumn("subgraph", F.lit("traversal"))
    walk_nodes = walk(own_nodes).filter(~predicate_like_label(F.col("label")))
    walk_links = valid_links(walk_nodes, walk(own_links))
    tag = lambda df: df.withColumn("subgraph", F.lit("combined_subgraph"))
    return (own_nodes.unionByName(walk_nodes).unionByName(tag(nodes)),
            own_links.unionByName(walk_links).unionByName(tag(links)))


def subgraph_inventory(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Counts and first node / link per subgraph.

    The set of the one graph_id of a group makes the aggregates object aggregates: these keep the strings of a few
    groups in a hash map, while a minimum of strings alone would first sort all rows.
    """
    own = F.element_at(F.collect_set("graph_id"), 1)
    least = lambda c: F.when(own.isNotNull(), F.min(c))
    n = grouped(nodes, "graph_id", "subgraph").agg(F.count(F.lit(1)).alias("node_count"), least("id").alias("first_node")).drop("_h")
    l = grouped(links, "graph_id", "subgraph").agg(
        F.count(F.lit(1)).alias("link_count"), least(F.struct("seq", "source", "target")).alias("_l")).drop("_h")
    out = n.join(l, ["graph_id", "subgraph"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("graph_id", "subgraph", zero("node_count"), zero("link_count"),
                      (F.coalesce("node_count", F.lit(0)) + F.coalesce("link_count", F.lit(0)) > 0).alias("has_data"),
                      "first_node", F.col("_l.source").alias("first_link_source"))


def consolidate(nodes: DataFrame, links: DataFrame, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
    """Merge nodes by label and links by (source, target, label); keep the best connected nodes.

    ``nodes`` needs ``first_seq`` for the "first record" fields. Labels shared by very many
    nodes merge by aggregation; the original ids stay in ``node_members`` rows, not in an array.
    """
    named = nodes.filter(F.coalesce(F.col("label"), F.lit("")) != "").withColumn("key", consolidated_id(F.col("label")))
    prio = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GROUP_PRIORITY.items() for x in kv]), F.col("group")), F.lit(0))
    dom = F.coalesce(F.col("domain_type"), F.lit("other"))
    specific = dom.isin(*LAYERS)
    merged = grouped(named, "graph_id", "label").agg(
        F.count(F.lit(1)).alias("count"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("origin_label", "group", F.lit("other")))), ",").alias("origins"),
        F.max_by("group", F.struct(prio, F.col("group"))).alias("group"),
        F.min_by(dom, F.struct("first_seq", "id")).alias("_d0"),
        F.min_by(F.when(specific, dom), F.when(specific, F.struct("first_seq", "id"))).alias("_d1"))
    merged = merged.select("graph_id", consolidated_id(F.col("label")).alias("id"), "label", "count", "origins", "group",
                           F.when(F.col("_d0") == "other", F.coalesce("_d1", F.lit("other"))).otherwise(F.col("_d0")).alias("domain_type"))
    ids = named.select("graph_id", "id", "key")
    l = links
    for end in ("source", "target"):
        l = l.join(ids.select("graph_id", F.col("id").alias(end), F.col("key").alias(f"_{end}")), [end, "graph_id"])
    l = l.filter("_source <> _target").select(
        "graph_id", F.col("_source").alias("source"), F.col("_target").alias("target"), F.coalesce("label", F.lit("unknown")).alias("label"), "origin")
    l = grouped(l, "graph_id", "source", "target", "label").agg(
        F.count(F.lit(1)).alias("count"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("origin", F.lit("other")))), ",").alias("origins"))
    # degrees and the kept links both read the merged links
    l = materialize(l.drop("_h").withColumn("weight", F.least(F.lit(5), "count").cast("long")))
    conn = degrees(l)
    ranked = merged.join(conn, ["id", "graph_id"], "left").select(*merged.columns, "degree").withColumn("importance", F.coalesce("degree", F.lit(0)).cast("long")).drop("degree")
    kept = materialize(top_k(ranked, ["graph_id"], [F.col("importance").desc(), F.col("id")], max_nodes))
    return kept, valid_links(kept, l)


def consolidated_id(label: Column) -> Column:
    return F.concat(F.lit("consolidated_"), F.regexp_replace(label, r"\s+", "_"))


def dedup_nodes(nodes: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    return first_by(nodes, ["graph_id", key], [order], last=keep == "last")


def dedup_unordered_pairs(triples: DataFrame) -> DataFrame:
    """First triple per {subject, object}, whatever the direction or predicate."""
    t = triples.withColumn("_a", F.least("subject_label", "object_label")).withColumn("_b", F.greatest("subject_label", "object_label"))
    return first_by(t, ["graph_id", "_a", "_b"], ["seq"]).select(*triples.columns)


# --- profiles ------------------------------------------------------------------------------

def jaccard(user: DataFrame, domain: DataFrame) -> DataFrame:
    """Shared labels, union size and their ratio per graph."""
    tag = lambda df, u, d: entity_set(df).withColumn("u", F.lit(u)).withColumn("d", F.lit(d))
    both = tag(user, 1, 0).unionByName(tag(domain, 0, 1)).groupBy("graph_id", "label").agg(F.max("u").alias("u"), F.max("d").alias("d"))
    out = both.groupBy("graph_id").agg(F.sum(F.col("u") * F.col("d")).alias("matches"), F.count(F.lit(1)).alias("union_size"))
    return out.withColumn("similarity", rnd(F.col("matches") / F.greatest(F.col("union_size"), F.lit(1))))


def graph_profile(triples: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Top entities, top predicates and totals per graph (isolated entities are empty by construction)."""
    ends = triple_endpoints(triples)
    ent = ends.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("frequency"))
    pred = triples.groupBy("graph_id", "predicate").agg(F.count(F.lit(1)).alias("frequency"))
    order = lambda c: [F.col("frequency").desc(), F.col(c)]
    # totals derive from the two aggregates, so no distinct count over raw rows
    totals = pred.groupBy("graph_id").agg(F.sum("frequency").alias("total_triples")).join(
        ent.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total_entities")), "graph_id")
    totals = totals.withColumn("isolated", F.lit(0).cast("long"))
    return (top_k(ent, ["graph_id"], order("label"), k), top_k(pred, ["graph_id"], order("predicate"), k), totals)


def default_triple(user_entities: DataFrame) -> DataFrame:
    """The stand-in triple of an empty graph: first two user entities, else Entity1 / Entity2."""
    firsts = top_k(user_entities, ["graph_id"], [F.col("seq")], 2, "rn").groupBy("graph_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("label"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.col("label"))).alias("b"))
    return firsts.select("graph_id", F.coalesce("a", F.lit("Entity1")).alias("subject_label"), F.lit("relatedTo").alias("predicate"),
                         F.coalesce("b", F.lit("Entity2")).alias("object_label"))


def structural_metrics(nodes: DataFrame, links: DataFrame) -> DataFrame:
    edges = simple_edges(links, nodes)
    deg = edges.select("graph_id", F.explode(F.array("a", "b")).alias("id")).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("d"))
    per = nodes.select("graph_id", "id").distinct().join(deg, ["graph_id", "id"], "left").withColumn("d", F.coalesce("d", F.lit(0)).cast("double"))
    out = per.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("node_count"), rnd(F.sum("d") / F.count(F.lit(1)), 2).alias("average_degree"),
        F.when(F.count(F.lit(1)) > 1, rnd(F.var_samp("d"), 2)).otherwise(0.0).alias("degree_variance"),
        F.max("d").cast("long").alias("max_degree"), F.min("d").cast("long").alias("min_degree"))
    m = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return out.join(m, "graph_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)).cast("long"))


def node_triangles(edges: DataFrame) -> DataFrame:
    """Triangles per node. Each pair points from the lower to the higher degree end, so no
    node emits more than about sqrt(2m) out-links and hubs produce no wedges."""
    e = edges.filter("a <> b")
    deg = both_ways(e).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("d"))
    for end in ("a", "b"):
        e = e.join(deg.select("graph_id", F.col("node").alias(end), F.col("d").alias(f"d{end}")), ["graph_id", end])
    up = (F.struct("da", "a") < F.struct("db", "b"))
    o = e.select("graph_id", F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = o.join(o.select("graph_id", F.col("x").alias("y"), F.col("y").alias("z")), ["graph_id", "y"])
    tri = wedge.join(o.select("graph_id", "x", F.col("y").alias("z")), ["graph_id", "x", "z"], "left_semi")
    return tri.select("graph_id", F.explode(F.array("x", "y", "z")).alias("node")).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("triangles"))


def clustering_and_density(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Density 2m/(n(n-1)) and mean local clustering (0 below degree 2), rounded to 4."""
    edges = simple_edges(links, nodes)
    deg = both_ways(edges).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("d"))
    tri = node_triangles(edges)
    local = F.when(F.col("d") >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    per = deg.join(tri, ["graph_id", "node"], "left").groupBy("graph_id").agg(F.sum(local).alias("c"))
    n = nodes.select("graph_id", "id").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    out = n.join(m, "graph_id", "left").join(per, "graph_id", "left")
    m0 = F.coalesce("m", F.lit(0))
    return out.select(
        "graph_id", F.col("n").alias("node_count"), m0.cast("long").alias("edge_count"),
        F.when(F.col("n") > 1, rnd(2.0 * m0 / (F.col("n") * (F.col("n") - 1)), 4)).otherwise(0.0).alias("graph_density"),
        rnd(F.coalesce("c", F.lit(0.0)) / F.col("n"), 4).alias("clustering_coefficient"))


def graph_description(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Counts, relation types (first five), first three nodes and the two size remarks."""
    n = nodes.select("graph_id", "id", "group").distinct()
    firsts = top_k(n.select("graph_id", "id").distinct(), ["graph_id"], [F.col("id")], 3).groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("first_nodes"))
    nn = n.select("graph_id", "id").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("node_count"))
    groups = n.select("graph_id", "group").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("group_count"))
    l = links.select("graph_id", "source", "target", "label").distinct().groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("c"))
    lc = l.groupBy("graph_id").agg(F.sum("c").alias("link_count"), F.count(F.lit(1)).alias("relation_types"))
    rel = top_k(l, ["graph_id"], [F.col("label")], 5).groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("relations"))
    out = nn.join(groups, "graph_id").join(lc, "graph_id", "left").join(rel, "graph_id", "left").join(firsts, "graph_id")
    return out.select(
        "graph_id", "node_count", F.coalesce("link_count", F.lit(0)).cast("long").alias("link_count"), "group_count",
        F.concat(F.coalesce("relations", F.lit("")), F.when(F.col("relation_types") > 5, ", and others").otherwise("")).alias("relations"),
        (F.col("node_count") > 10).alias("complex"),
        (F.coalesce("link_count", F.lit(0)) > F.col("node_count")).alias("high_interconnectivity"), "first_nodes")


def record_profile(triples: DataFrame, hints=ENTITY_HINTS) -> DataFrame:
    """Record, entity and origin counts, first ten entities and entities with a solution hint."""
    ent = triple_endpoints(triples).filter(F.coalesce(F.col("label"), F.lit("")) != "").select("graph_id", "label").distinct()
    hit = reduce(lambda a, b: a | b, [F.lower("label").contains(h) for h in hints])
    e = ent.groupBy("graph_id").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.when(hit, 1).otherwise(0)).alias("solution_entities"))
    firsts = top_k(ent, ["graph_id"], [F.col("label")], 10).groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), "|").alias("first_entities"))
    r = triples.groupBy("graph_id", "origin").agg(F.count(F.lit(1)).alias("c")).groupBy("graph_id").agg(
        F.sum("c").alias("records"), F.array_join(F.array_sort(F.collect_list("origin")), ",").alias("origins"))
    return r.join(e, "graph_id").join(firsts, "graph_id")


def graph_text(links: DataFrame, max_chars: int = 50000) -> DataFrame:
    """One "source label target" line per link in order, cut at ``max_chars`` with a marker.

    Only lines that start before the cut can show up, so the line list is reduced to that
    many lines per graph by a running length over (bucket, line) before it is joined.
    """
    line = links.select("graph_id", "seq", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("source", "label", "target")]).alias("line"))
    # every line adds at least its own length plus a newline; k lines always fill the text
    k = max_chars // 3 + 1
    first = top_k(line, ["graph_id"], [F.col("seq")], k)
    body = first.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("t"))
    total = line.groupBy("graph_id").agg((F.sum(F.length("line") + 1) - 1).alias("full_length"))
    out = body.join(total, "graph_id")
    text = F.when(F.col("full_length") > max_chars, F.concat(F.substring("t", 1, max_chars), F.lit("... (truncated)"))).otherwise(F.col("t"))
    return out.select("graph_id", text.alias("graph_text"), F.col("full_length").cast("long").alias("full_length"))


def meaningful_entities(nodes: DataFrame, n: int, banned=("cutting edge", "edge ai")) -> DataFrame:
    """First ``n`` labels longer than three characters, comma joined."""
    label = F.trim("label")
    ok = (F.length(label) > 3) & ~predicate_like_label(label)
    for b in banned:
        ok = ok & ~F.lower(label).contains(b)
    top = top_k(nodes.filter(ok), ["graph_id"], [F.col("first_seq"), F.col("id")], n, "rn")
    return top.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", label.alias("l")))), lambda x: x["l"]), ", ").alias("entities"))
