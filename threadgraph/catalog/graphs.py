"""Graph tables, joins, sets, degrees, consolidation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgraph import fixtures as fx
from threadgraph.catalog import query
from threadgraph.catalog.views import RND, with_views
from threadgraph.operators import connectivity as cn
from threadgraph.operators import graph as g
from threadgraph.operators.common import rnd, top_k
from threadgraph.session import materialize


def _graph(spark, sf):
    return g.materialize_graph(materialize(fx.triples(spark, sf)))


def _order_graph(spark, sf):
    links = materialize(_links(fx.order_triples(spark, sf)))
    return g.link_endpoints(links).distinct(), links


def _dealt_order_graph(spark, sf):
    """Nodes and links of the orders, not written: they stay dealt by graph, and only orders and lines move."""
    links = _links(fx.order_triples(spark, sf))
    return g.link_endpoints(links).distinct(), links


def _links(t):
    return t.select("graph_id", "seq", F.col("subject_id").alias("source"), F.col("object_id").alias("target"),
                    F.col("predicate").alias("label"), "origin")


BALL = """WITH RECURSIVE adj AS (SELECT graph_id, source AS node, target AS nbr FROM links UNION SELECT graph_id, target, source FROM links),
 h1 AS (SELECT DISTINCT a.graph_id, a.nbr AS id FROM adj a JOIN seeds s ON a.node=s.id AND a.graph_id=s.graph_id),
 h2 AS (SELECT DISTINCT a.graph_id, a.nbr AS id FROM adj a JOIN h1 ON a.node=h1.id AND a.graph_id=h1.graph_id),
 ball AS (SELECT graph_id, id, min(hop) AS hop FROM (SELECT graph_id, id, 0 AS hop FROM seeds UNION ALL SELECT graph_id, id, 1 FROM h1 UNION ALL SELECT graph_id, id, 2 FROM h2) GROUP BY ALL)
"""
BALL = BALL.replace("WITH RECURSIVE ", "WITH ")

CONSOLIDATED = """
 cn AS (SELECT graph_id, 'consolidated_'||regexp_replace(label, '\\s+', '_', 'g') AS id, label, count(*) AS count,
   array_to_string(list_sort(list_distinct(list(origin_label))), ',') AS origins,
   arg_max("group", ((CASE "group" WHEN 'user' THEN 5 WHEN 'gnn' THEN 4 WHEN 'llm' THEN 3 WHEN 'connection' THEN 2 WHEN 'domain' THEN 1 ELSE 0 END), "group")) AS "group",
   arg_min(domain_type, (first_seq, id)) AS domain_type FROM nn GROUP BY graph_id, label),
 key AS (SELECT graph_id, id, 'consolidated_'||regexp_replace(label, '\\s+', '_', 'g') AS key FROM nn),
 cl AS (SELECT l.graph_id, a.key AS source, b.key AS target, l.label, count(*) AS count,
   array_to_string(list_sort(list_distinct(list(origin))), ',') AS origins, least(5, count(*))::BIGINT AS weight
   FROM ll l JOIN key a ON a.id=l.source AND a.graph_id=l.graph_id JOIN key b ON b.id=l.target AND b.graph_id=l.graph_id WHERE a.key<>b.key GROUP BY 1,2,3,4),
 imp AS (SELECT graph_id, id, count(*) AS importance FROM (SELECT graph_id, source AS id FROM cl UNION ALL SELECT graph_id, target FROM cl) GROUP BY ALL),
 ranked AS (SELECT cn.*, coalesce(importance,0)::BIGINT AS importance, row_number() OVER (PARTITION BY graph_id ORDER BY coalesce(importance,0) DESC, id) AS rn FROM cn LEFT JOIN imp USING (graph_id, id)),
 kn AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= 40),
 kl AS (SELECT cl.* FROM cl WHERE source IN (SELECT id FROM kn) AND target IN (SELECT id FROM kn))"""


@query("flagship_thread_graph", with_views(BALL + """,
 nn AS (SELECT n.* FROM nodes n JOIN ball b USING (graph_id, id)),
 ll AS (SELECT l.* FROM links l WHERE source IN (SELECT id FROM ball) AND target IN (SELECT id FROM ball)),""" + CONSOLIDATED + f""",
 ents AS (SELECT origin, label FROM ends JOIN ball ON ends.id=ball.id),
 u AS (SELECT DISTINCT label FROM (SELECT e.label FROM ends e JOIN ll ON e.seq=ll.seq WHERE e.origin='user')),
 d AS (SELECT DISTINCT label FROM (SELECT e.label FROM ends e JOIN ll ON e.seq=ll.seq WHERE e.origin='domain')),
 sim AS (SELECT {RND("count(*) FILTER (u.label IS NOT NULL AND d.label IS NOT NULL) / greatest(count(*), 1)")} AS similarity FROM u FULL JOIN d USING (label))
 SELECT "group" AS origin, count(*) AS nodes, sum(count)::BIGINT AS merged_nodes,
   (SELECT count(*) FROM kl WHERE contains(','||kl.origins||',', ','||kn."group"||',')) AS links, (SELECT similarity FROM sim) AS similarity FROM kn GROUP BY kn."group" """))
def flagship(spark, sf):
    t = materialize(fx.triples(spark, sf))
    adj = cn.adjacency(_links(t))
    ball = materialize(cn.khop(adj, fx.seeds(spark, sf), 2))
    kept = g.valid_links(ball.select("graph_id", "id"), t.withColumnsRenamed({"subject_id": "source", "object_id": "target"}))
    kept = materialize(kept.withColumnsRenamed({"source": "subject_id", "target": "object_id"}).select(*t.columns))
    nodes, links = g.materialize_graph(t)
    nodes, _ = g.induce(nodes, links, ball)
    kn, kl = g.consolidate(nodes, _links(kept))
    kl = kl.select("graph_id", F.explode(F.split("origins", ",")).alias("group")).groupBy("graph_id", "group").agg(F.count(F.lit(1)).alias("links"))
    per = kn.groupBy("graph_id", "group").agg(F.count(F.lit(1)).alias("nodes"), F.sum("count").alias("merged_nodes"))
    sim = g.jaccard(kept.filter("origin = 'user'"), kept.filter("origin = 'domain'")).select("graph_id", "similarity")
    out = per.join(kl, ["graph_id", "group"], "left").join(sim, "graph_id")
    return out.select(F.col("group").alias("origin"), "nodes", "merged_nodes", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "similarity")


# --- scans and joins -----------------------------------------------------------------------

@query("s8_scan_graph", """WITH raw AS (SELECT 'c'||c_custkey AS id, NULL AS "localName", c_name AS name, NULL AS label, NULL AS title, ['Customer'] AS labels FROM customer
  UNION ALL SELECT 'n'||n_nationkey, '', '', NULL, n_name, ['Nation'] FROM nation
  UNION ALL SELECT 'r'||r_regionkey, NULL, NULL, NULL, NULL, CAST([] AS VARCHAR[]) FROM region),
 e AS (SELECT 'c'||c_custkey AS source, 'n'||c_nationkey AS target FROM customer UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey FROM nation),
 lab AS (SELECT *, coalesce(nullif("localName",''), nullif(name,''), nullif(label,''), nullif(title,'')) AS l FROM raw),
 u AS (SELECT id, coalesce(l, id) AS label, coalesce(labels[1], 'Node') AS type, 0 AS side FROM lab WHERE id IN (SELECT source FROM e)
  UNION ALL SELECT id, coalesce(l, ''), coalesce(labels[1], 'Node'), 1 FROM lab WHERE id IN (SELECT target FROM e))
 SELECT id, arg_min(label, side) AS label, arg_min(type, side) AS type FROM u GROUP BY id""")
def scan_graph_q(spark, sf):
    from threadgraph.sources.graph_scan import scan_graph

    null = lambda n: F.lit(None).cast("string").alias(n)
    cust = fx.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), null("localName"), F.col("c_name").alias("name"), null("label"), null("title"), F.array(F.lit("Customer")).alias("labels"))
    nat = fx.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("").alias("localName"), F.lit("").alias("name"), null("label"), F.col("n_name").alias("title"), F.array(F.lit("Nation")).alias("labels"))
    reg = fx.table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), null("localName"), null("name"), null("label"), null("title"), F.array().cast("array<string>").alias("labels"))
    e1 = fx.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    e2 = fx.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    edges = e1.unionByName(e2).withColumn("label", F.lit("is_part_of"))
    nodes, _ = scan_graph(cust.unionByName(nat).unionByName(reg), edges)
    return nodes.select("id", "label", "type")


@query("s9_pattern_query", """SELECT c.c_custkey AS root, 'o'||o.o_orderkey AS middle, n.rel AS relation, n.other AS other FROM customer c JOIN orders o ON o.o_custkey=c.c_custkey
  LEFT JOIN (SELECT DISTINCT l_orderkey AS k, 'contains' AS rel, 'p'||l_partkey AS other FROM lineitem) n ON n.k=o.o_orderkey WHERE c.c_mktsegment='FURNITURE'""")
def pattern_q(spark, sf):
    from threadgraph.sources.graph_scan import pattern_query

    t = fx.triples(spark, sf)
    rows = pattern_query(_links(t), fx.seeds(spark, sf), "places", [("contains", "out")])
    return rows.select(F.substring("root", 2, 20).cast("long").alias("root"), "middle", "relation", "other")


@query("s10_property_match", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment='BUILDING' ORDER BY c_custkey LIMIT 10")
def property_match_q(spark, sf):
    from threadgraph.sources.graph_scan import property_match

    cust = fx.table(spark, sf, "customer")
    return property_match(cust, "c_mktsegment", "BUILDING", ["c_custkey"], 10).select("c_custkey", "c_name")


@query("s13_graph_text", with_views("""SELECT graph_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200)||'... (truncated)' ELSE t END AS graph_text, length(t)::BIGINT AS full_length FROM
  (SELECT graph_id, string_agg(source||' '||label||' '||target, chr(10) ORDER BY seq) AS t FROM olinks GROUP BY graph_id)"""))
def graph_text_q(spark, sf):
    # not written first: the links stay dealt by graph, and only orders and lines move
    return g.graph_text(_links(fx.order_triples(spark, sf)), 200)


@query("j1_links_to_triples", with_views("SELECT graph_id, seq, subject_id, subject_label, predicate, object_id, object_label, origin FROM triples"))
def links_to_triples_q(spark, sf):
    nodes, links = _graph(spark, sf)
    return g.links_to_triples(links, nodes)


@query("j2_induce_incident", with_views("""SELECT seq, source IN (SELECT id FROM seeds) AND target IN (SELECT 'n'||n_nationkey FROM nation) AS inside FROM links
  WHERE source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds)"""))
def induce_q(spark, sf):
    _, links = _graph(spark, sf)
    seeds = fx.seeds(spark, sf)
    nations = fx.table(spark, sf, "nation").select(F.lit("all").alias("graph_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    inside = g.valid_links(seeds.select("graph_id", "id").unionByName(nations), links).filter(F.col("source").startswith("c")).select("seq", F.lit(True).alias("_in"))
    return g.incident_links(links, seeds).join(inside, "seq", "left").select("seq", F.coalesce("_in", F.lit(False)).alias("inside"))


@query("j3_exact_entity_match", with_views("SELECT id, label FROM nodes WHERE trim(label) IN (SELECT trim(label) FROM ends WHERE origin='user')"))
def exact_match_q(spark, sf):
    nodes, _ = _graph(spark, sf)
    return g.exact_entity_match(nodes, fx.triples(spark, sf).filter("origin = 'user'")).select("id", "label")


@query("p12_orphan_links", with_views("SELECT seq, source, target FROM links WHERE source IN (SELECT id FROM seeds) AND target NOT IN (SELECT id FROM seeds) OR source NOT IN (SELECT id FROM seeds)"))
def orphan_q(spark, sf):
    _, links = _graph(spark, sf)
    return g.orphan_links(fx.seeds(spark, sf), links).select("seq", "source", "target")


@query("p12_valid_links", with_views("SELECT seq FROM links WHERE source IN (SELECT id FROM nodes WHERE \"group\"='domain') AND target IN (SELECT id FROM nodes WHERE \"group\"='domain')"))
def valid_q(spark, sf):
    nodes, links = _graph(spark, sf)
    return g.valid_links(nodes.filter(F.col("group") == "domain"), links).select("seq")


# --- sets ----------------------------------------------------------------------------------

@query("u1_combine_records", with_views("SELECT CASE origin WHEN 'user' THEN 0 WHEN 'domain' THEN 1 ELSE 3 END AS source_rank, predicate, count(*) AS n FROM triples GROUP BY ALL"))
def combine_q(spark, sf):
    t = fx.triples(spark, sf)
    parts = [(0, t.filter("origin = 'user'").drop("domain_type")), (1, t.filter("origin = 'domain'")), (3, t.filter("origin = 'connection'"))]
    return g.combine_records(parts).groupBy("source_rank", "predicate").agg(F.count(F.lit(1)).alias("n"))


@query("u2_entity_set", with_views("SELECT DISTINCT graph_id, label FROM ends"))
def entity_set_q(spark, sf):
    return g.entity_set(fx.triples(spark, sf))


@query("u3_isolated_nodes", with_views("SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM links WHERE label='places' UNION SELECT target FROM links WHERE label='places')"))
def isolated_q(spark, sf):
    nodes, links = _graph(spark, sf)
    return g.isolated_nodes(nodes, links.filter("label = 'places'")).select("id")


@query("u4_entity_intersection", with_views("SELECT graph_id, label FROM ends WHERE origin='user' INTERSECT SELECT graph_id, label FROM ends WHERE origin='domain'"))
def intersection_q(spark, sf):
    t = fx.triples(spark, sf)
    return g.entity_intersection(t.filter("origin = 'user'"), t.filter("origin = 'domain'"))


# --- aggregations --------------------------------------------------------------------------

@query("a1_degrees", with_views("SELECT graph_id, id, count(*) AS degree FROM ends GROUP BY ALL"))
def degrees_q(spark, sf):
    return g.degrees(_links(fx.triples(spark, sf)))


@query("a1_digraph_degrees", with_views("""SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM (SELECT DISTINCT source, target FROM links)
  UNION ALL SELECT target, 0, 1 FROM (SELECT DISTINCT source, target FROM links)) GROUP BY id"""))
def digraph_q(spark, sf):
    return g.digraph_degrees(_links(fx.triples(spark, sf))).select("id", "out_degree", "in_degree")


@query("a2_materialize_nodes", with_views("SELECT graph_id, id, label, \"group\", origin_label, domain_type, first_seq FROM nodes"))
def materialize_nodes_q(spark, sf):
    return _graph(spark, sf)[0]


@query("a2_materialize_links", with_views("SELECT label, origin, count(*) AS n, min(seq) AS first_seq FROM links GROUP BY ALL"))
def materialize_links_q(spark, sf):
    return _graph(spark, sf)[1].groupBy("label", "origin").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


SPLIT = """WITH own AS (SELECT id, "group" AS subgraph, label FROM nodes WHERE "group"=origin_label),
 ln AS (SELECT l.seq, l.source, l.target, l.origin AS subgraph FROM links l JOIN own a ON a.id=l.source AND a.subgraph=l.origin JOIN own b ON b.id=l.target AND b.subgraph=l.origin),
 sn AS (SELECT id, subgraph FROM own UNION ALL SELECT id, 'traversal' FROM own WHERE subgraph IN ('connection','gnn') UNION ALL SELECT id, 'combined_subgraph' FROM nodes),
 sl AS (SELECT seq, source, target, subgraph FROM ln UNION ALL SELECT seq, source, target, 'traversal' FROM ln WHERE subgraph IN ('connection','gnn') UNION ALL SELECT seq, source, target, 'combined_subgraph' FROM links),
 inv AS (SELECT subgraph, coalesce(nc,0)::BIGINT AS node_count, coalesce(lc,0)::BIGINT AS link_count, coalesce(nc,0)+coalesce(lc,0)>0 AS has_data, first_node, first_link_source FROM
  (SELECT subgraph, count(*) AS nc, min(id) AS first_node FROM sn GROUP BY 1) FULL JOIN
  (SELECT subgraph, count(*) AS lc, arg_min(source, (seq, source, target)) AS first_link_source FROM sl GROUP BY 1) USING (subgraph)) """


@query("a3_split_by_origin", with_views(SPLIT + "SELECT subgraph, node_count, link_count FROM inv"))
def split_q(spark, sf):
    inv = g.subgraph_inventory(*g.split_by_origin(*_graph(spark, sf)))
    return inv.select("subgraph", "node_count", "link_count")


@query("a34_subgraph_inventory", with_views(SPLIT + "SELECT * FROM inv"))
def inventory_q(spark, sf):
    return g.subgraph_inventory(*g.split_by_origin(*_graph(spark, sf))).drop("graph_id")


WHOLE = "WITH nn AS (SELECT * FROM nodes), ll AS (SELECT * FROM links)," + CONSOLIDATED


@query("a4_consolidate_nodes", with_views(WHOLE + ' SELECT id, label, count, origins, "group", domain_type, importance FROM kn'))
def consolidate_nodes_q(spark, sf):
    return g.consolidate(*_graph(spark, sf))[0].drop("graph_id")


@query("a4_consolidate_links", with_views(WHOLE + " SELECT source, target, label, count, origins, weight FROM kl"))
def consolidate_links_q(spark, sf):
    return g.consolidate(*_graph(spark, sf))[1].drop("graph_id")


@query("a5_jaccard", with_views(f"""SELECT count(*) FILTER (u AND d) AS matches, count(*) AS union_size, {RND('count(*) FILTER (u AND d) / greatest(count(*),1)')} AS similarity FROM
  (SELECT label, bool_or(origin='user') AS u, bool_or(origin='domain') AS d FROM ends WHERE origin IN ('user','domain') GROUP BY label)"""))
def jaccard_q(spark, sf):
    t = fx.triples(spark, sf)
    return g.jaccard(t.filter("origin = 'user'"), t.filter("origin = 'domain'")).drop("graph_id")


@query("a6_graph_profile", with_views("""SELECT * FROM (SELECT 'entity' AS kind, label AS name, count(*) AS frequency FROM ends GROUP BY label ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'predicate', predicate, count(*) FROM triples GROUP BY predicate ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL SELECT 'total', 'triples', count(*) FROM triples UNION ALL SELECT 'total', 'entities', count(DISTINCT label) FROM ends UNION ALL SELECT 'total', 'isolated', 0"""))
def profile_q(spark, sf):
    ent, pred, tot = g.graph_profile(fx.triples(spark, sf))
    rows = ent.select(F.lit("entity").alias("kind"), F.col("label").alias("name"), "frequency")
    rows = rows.unionByName(pred.select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name"), "frequency"))
    wide = tot.select(F.lit("total").alias("kind"), F.col("total_triples").alias("triples"), F.col("total_entities").alias("entities"), "isolated")
    return rows.unionByName(wide.unpivot(["kind"], ["triples", "entities", "isolated"], "name", "frequency"))


USER_GRAPH = """WITH sl AS (SELECT path_id AS graph_id, subject AS source, object AS target FROM steps),
 sn AS (SELECT DISTINCT graph_id, id FROM (SELECT graph_id, source AS id FROM sl UNION ALL SELECT graph_id, target FROM sl)),
 se AS (SELECT DISTINCT graph_id, least(source,target) AS a, greatest(source,target) AS b FROM sl),
 sa AS (SELECT graph_id, a AS node, b AS nbr FROM se WHERE a<>b UNION ALL SELECT graph_id, b, a FROM se WHERE a<>b) """


def user_graph(spark, sf):
    """One small transition graph per user and week."""
    s = materialize(fx.path_steps(spark, sf))
    links = s.select(F.col("path_id").alias("graph_id"), F.col("pos").alias("seq"), F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"))
    nodes = links.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes, links


@query("a7_structural_metrics", with_views(USER_GRAPH + f""", deg AS (SELECT graph_id, id, count(*) AS d FROM (SELECT graph_id, a AS id FROM se UNION ALL SELECT graph_id, b FROM se) GROUP BY ALL),
 p AS (SELECT sn.graph_id, coalesce(d,0)::DOUBLE AS d FROM sn LEFT JOIN deg USING (graph_id, id))
 SELECT graph_id, count(*) AS node_count, {RND('sum(d)/count(*)', 2)} AS average_degree, CASE WHEN count(*)>1 THEN {RND('var_samp(d)', 2)} ELSE 0.0 END AS degree_variance,
  max(d)::BIGINT AS max_degree, min(d)::BIGINT AS min_degree, (SELECT count(*) FROM se WHERE se.graph_id=p.graph_id) AS edge_count FROM p GROUP BY graph_id"""))
def structural_q(spark, sf):
    return g.structural_metrics(*user_graph(spark, sf))


@query("a8_density_clustering", with_views(USER_GRAPH + f""", deg AS (SELECT graph_id, node, count(*) AS d FROM sa GROUP BY ALL),
 tri AS (SELECT x.graph_id, x.node, count(*)/2 AS t FROM sa x JOIN sa y ON y.graph_id=x.graph_id AND y.node=x.nbr JOIN sa z ON z.graph_id=x.graph_id AND z.node=y.nbr AND z.nbr=x.node GROUP BY ALL),
 c AS (SELECT graph_id, sum(CASE WHEN d>=2 THEN 2.0*coalesce(t,0)/(d*(d-1)) ELSE 0 END) AS c FROM deg LEFT JOIN tri USING (graph_id,node) GROUP BY 1),
 n AS (SELECT graph_id, count(*) AS n FROM sn GROUP BY 1), m AS (SELECT graph_id, count(*) AS m FROM se GROUP BY 1)
 SELECT graph_id, n AS node_count, m AS edge_count, CASE WHEN n>1 THEN {RND('2.0*m/(n*(n-1))', 4)} ELSE 0.0 END AS graph_density, {RND('coalesce(c,0)/n', 4)} AS clustering_coefficient
 FROM n JOIN m USING (graph_id) LEFT JOIN c USING (graph_id)"""))
def clustering_q(spark, sf):
    return g.clustering_and_density(*user_graph(spark, sf))


@query("a10_graph_description", with_views("""WITH n AS (SELECT DISTINCT graph_id, id FROM oends), l AS (SELECT DISTINCT graph_id, source, target, label FROM olinks)
 SELECT graph_id, nc AS node_count, lc AS link_count, 1::BIGINT AS group_count, rel AS relations, nc>10 AS complex, lc>nc AS high_interconnectivity, first_nodes FROM
 (SELECT graph_id, count(*) AS nc, array_to_string(list_sort(list(id))[1:3], ', ') AS first_nodes FROM n GROUP BY 1) JOIN
 (SELECT graph_id, count(*) AS lc, array_to_string(list_sort(list_distinct(list(label)))[1:5], ', ')||CASE WHEN count(DISTINCT label)>5 THEN ', and others' ELSE '' END AS rel FROM l GROUP BY 1) USING (graph_id)"""))
def description_q(spark, sf):
    # read dealt by graph again: counts and first rows of a graph are then made in one place
    links = _order_graph(spark, sf)[1].repartition("graph_id")
    nodes = g.link_endpoints(links).distinct()
    return g.graph_description(nodes.withColumn("group", F.lit("order")), links)


@query("a30_dedup_last_by_id", with_views("SELECT graph_id, id, arg_max(origin, (seq, side)) AS origin, max(seq) AS seq FROM ends GROUP BY ALL"))
def dedup_last_q(spark, sf):
    e = g.triple_endpoints(fx.triples(spark, sf)).withColumn("ord", F.struct("seq", "side"))
    return g.dedup_nodes(e, "id", "ord", "last").select("graph_id", "id", "origin", "seq")


@query("a30_dedup_first_by_label", with_views("SELECT graph_id, label, arg_min(id, (seq, side)) AS id FROM ends GROUP BY ALL"))
def dedup_first_q(spark, sf):
    e = g.triple_endpoints(fx.triples(spark, sf)).withColumn("ord", F.struct("seq", "side"))
    return g.dedup_nodes(e, "label", "ord").select("graph_id", "label", "id")


@query("a32_record_profile", with_views("""SELECT (SELECT count(*) FROM triples) AS records, (SELECT array_to_string(list_sort(list_distinct(list(origin))), ',') FROM triples) AS origins,
 count(*) AS entities, count(*) FILTER (regexp_matches(lower(label), 'solution|implement|system|technology|api|framework')) AS solution_entities,
 array_to_string(list_sort(list(label))[1:10], '|') AS first_entities FROM (SELECT DISTINCT label FROM ends)"""))
def record_profile_q(spark, sf):
    return g.record_profile(fx.triples(spark, sf)).drop("graph_id")


@query("p10_predicate_like", with_views("SELECT id, starts_with(x,'ns0__') OR starts_with(x,'ns2__') OR starts_with(x,'rdfs__') OR starts_with(x,'owl__') OR starts_with(x,'rdf__') AS by_id, starts_with(x,'ns0__') OR starts_with(x,'rdfs__') OR starts_with(x,'owl__') AS by_label FROM (SELECT id, CASE \"group\" WHEN 'user' THEN 'ns2__' WHEN 'domain' THEN 'owl__' ELSE '' END||label AS x FROM nodes)"))
def predicate_like_q(spark, sf):
    nodes, _ = _graph(spark, sf)
    x = F.concat(F.when(F.col("group") == "user", "ns2__").when(F.col("group") == "domain", "owl__").otherwise(""), "label")
    return nodes.select("id", g.predicate_like_id(x).alias("by_id"), g.predicate_like_label(x).alias("by_label"))


@query("p11_meaningful_entities", with_views("""SELECT graph_id, array_to_string(list(trim(label) ORDER BY first_seq, id), ', ') AS entities FROM
  (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY first_seq, id) AS rn FROM nodes WHERE length(trim(label))>3) WHERE rn<=30 GROUP BY graph_id"""))
def meaningful_q(spark, sf):
    return g.meaningful_entities(_graph(spark, sf)[0], 30)


@query("p15_ids_to_labels", with_views("SELECT seq, coalesce(p.p_name, 'p'||x) AS object_label FROM (SELECT seq, substr(object_id,2)::BIGINT + 1000 AS x FROM triples WHERE predicate='contains') LEFT JOIN part p ON p.p_partkey=x"))
def ids_to_labels_q(spark, sf):
    from threadgraph.operators.joins import ids_to_labels

    t = fx.triples(spark, sf).filter("predicate = 'contains'").select("graph_id", "seq", F.concat(F.lit("p"), (F.substring("object_id", 2, 20).cast("long") + 1000).cast("string")).alias("object"))
    labels = fx.table(spark, sf, "part").select(F.lit("all").alias("graph_id"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    return ids_to_labels(t, labels, ["object"]).select("seq", F.col("object").alias("object_label"))


# --- windows -------------------------------------------------------------------------------

@query("w4_dedup_unordered_pairs", with_views("SELECT graph_id, least(subject_label,object_label) AS a, greatest(subject_label,object_label) AS b, min(seq) AS seq FROM triples GROUP BY ALL"))
def unordered_q(spark, sf):
    t = g.dedup_unordered_pairs(fx.triples(spark, sf))
    return t.select("graph_id", F.least("subject_label", "object_label").alias("a"), F.greatest("subject_label", "object_label").alias("b"), "seq")


@query("w5_dedup_path", with_views("SELECT path_id, subject, object, min(pos) AS pos FROM steps GROUP BY ALL"))
def dedup_path_q(spark, sf):
    from threadgraph.operators.common import first_by

    return first_by(fx.path_steps(spark, sf), ["path_id", "subject", "object"], ["pos"]).select("path_id", "subject", "object", "pos")


@query("w10_prioritize", with_views("SELECT graph_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY CASE WHEN contains(lower(object_label),'ai') OR contains(lower(object_label),'data') OR contains(lower(object_label),'system') OR contains(lower(object_label),'model') THEN 0 ELSE 1 END, seq) AS rn FROM triples) WHERE rn<=20"))
def prioritize_q(spark, sf):
    from threadgraph.operators.similarity import prioritize

    return prioritize(fx.triples(spark, sf), 20, terms=["ai", "data", "system", "model"]).select("graph_id", "seq")


@query("g5_weighted_links", with_views(f"""WITH l AS MATERIALIZED (SELECT graph_id, source, target FROM olinks), deg AS (SELECT graph_id, id, count(*) AS d FROM (SELECT graph_id, unnest([source, target]) AS id FROM l) GROUP BY ALL)
 SELECT e.graph_id, e.a, e.b, {RND("CASE WHEN x.d>5 OR y.d>5 THEN 1.0/(sqrt((x.d*y.d)::DOUBLE)+0.1) ELSE 1.0 END")} AS weight FROM
 (SELECT DISTINCT graph_id, least(source,target) AS a, greatest(source,target) AS b FROM l) e JOIN deg x ON x.graph_id=e.graph_id AND x.id=e.a JOIN deg y ON y.graph_id=e.graph_id AND y.id=e.b"""))
def weighted_links_q(spark, sf):
    nodes, links = _dealt_order_graph(spark, sf)
    return cn.weighted_links(nodes, links).withColumn("weight", rnd(F.col("weight")))


@query("g1_khop", with_views(BALL + "SELECT id, hop::INTEGER AS hop FROM ball"))
def khop_q(spark, sf):
    return cn.khop(cn.adjacency(_links(fx.triples(spark, sf))), fx.seeds(spark, sf), 2).select("id", "hop")


@query("w11_assign_isolated", """WITH sizes AS (SELECT c_nationkey AS grp, count(*) AS size FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT') GROUP BY 1),
 iso AS (SELECT 'c'||c_custkey AS id, row_number() OVER (ORDER BY 'c'||c_custkey) AS slot FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT')),
 slots AS (SELECT grp, row_number() OVER (ORDER BY size+j, grp) AS slot FROM sizes, range(20) r(j))
 SELECT id, grp::BIGINT AS "group" FROM iso JOIN slots USING (slot) WHERE slot<=20""")
def assign_isolated_q(spark, sf):
    urgent = fx.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    cust = fx.table(spark, sf, "customer")
    iso = cust.join(urgent, "c_custkey", "left_anti").select(F.lit("all").alias("graph_id"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    groups = cust.join(urgent, "c_custkey", "left_semi").groupBy(F.lit("all").alias("graph_id"), F.col("c_nationkey").cast("long").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    return cn.assign_isolated(iso, groups, 20).select("id", "group")


@query("u5_merge_results", """WITH a AS (SELECT o_custkey AS query_id, 'o'||o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank<=3),
 b AS (SELECT o_custkey AS query_id, 't'||o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders QUALIFY rank<=2)
 SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY s, rank) AS rank FROM (SELECT 0 AS s, * FROM a UNION ALL SELECT 1, * FROM b)""")
def merge_results_q(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("query_id", F.col("o_custkey"))
    doc = lambda p: F.concat(F.lit(p), "o_orderkey").alias("doc")
    a = top_k(o, ["query_id"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, "rank").select("query_id", doc("o"), "rank")
    b = top_k(o, ["query_id"], [F.col("o_orderkey")], 2, "rank").select("query_id", doc("t"), "rank")
    return g.merge_results(a, b).select("query_id", "doc", "rank")
