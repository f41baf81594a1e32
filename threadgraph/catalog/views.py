"""SQL twins of the fixture views, for the check side."""

from __future__ import annotations

import re

from threadgraph.fixtures import EVENT_LAYER, EVENT_PREDICATE

PAD = lambda c: f"lpad({c}::VARCHAR, 13, '0')"
RND = lambda x, d=6: f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"

_layer = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LAYER.items()) + " END"
_pred = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(EVENT_PREDICATE)) + " END"

VIEWS = {
    "triples": f"""
SELECT 'all' AS graph_id, * FROM (
 SELECT '1'||{PAD('o_orderkey')} AS seq, 'c'||o_custkey AS subject_id, c_name AS subject_label, 'places' AS predicate,
        'o'||o_orderkey AS object_id, 'Order '||o_orderkey AS object_label, 'user' AS origin, 'business' AS domain_type
 FROM orders JOIN customer ON o_custkey=c_custkey
 UNION ALL SELECT '2'||{PAD('l_orderkey')}||{PAD('l_partkey')}, 'o'||l_orderkey, 'Order '||l_orderkey, 'contains',
        'p'||l_partkey, p_name, 'domain', 'system'
 FROM (SELECT DISTINCT l_orderkey,l_partkey FROM lineitem) JOIN part ON l_partkey=p_partkey
 UNION ALL SELECT '3'||{PAD('l_partkey')}||{PAD('l_suppkey')}, 'p'||l_partkey, p_name, 'uses', 's'||l_suppkey, s_name, 'domain', 'data'
 FROM (SELECT DISTINCT l_partkey,l_suppkey FROM lineitem) JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey
 UNION ALL SELECT '4'||{PAD('s_suppkey')}, 's'||s_suppkey, s_name, 'is_part_of', 'n'||n_nationkey, n_name, 'domain', 'technology'
 FROM supplier JOIN nation ON s_nationkey=n_nationkey
 UNION ALL SELECT '5'||{PAD('c_custkey')}, 'c'||c_custkey, c_name, 'is_part_of', 'n'||n_nationkey, n_name, 'connection', 'business'
 FROM customer JOIN nation ON c_nationkey=n_nationkey
 UNION ALL SELECT '6'||{PAD('n_nationkey')}, 'n'||n_nationkey, n_name, 'belongs_to', 'r'||r_regionkey, r_name, 'domain', 'technology'
 FROM nation JOIN region ON n_regionkey=r_regionkey)""",
    "ol": "SELECT DISTINCT l_orderkey, l_partkey, p_name, l_suppkey, s_name, n_nationkey, n_name, r_regionkey, r_name FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
    "order_triples": f"""
SELECT 'o'||k AS graph_id, * EXCLUDE (k) FROM (
 SELECT o_orderkey AS k, '1'||{PAD('o_orderkey')} AS seq, 'c'||o_custkey AS subject_id, c_name AS subject_label, 'places' AS predicate,
        'o'||o_orderkey AS object_id, 'Order '||o_orderkey AS object_label, 'user' AS origin, 'business' AS domain_type
 FROM orders JOIN customer ON o_custkey=c_custkey
 UNION ALL SELECT DISTINCT l_orderkey, '2'||{PAD('l_orderkey')}||{PAD('l_partkey')}, 'o'||l_orderkey, 'Order '||l_orderkey, 'contains', 'p'||l_partkey, p_name, 'domain', 'system' FROM ol
 UNION ALL SELECT DISTINCT l_orderkey, '3'||{PAD('l_orderkey')}||{PAD('l_partkey')}||{PAD('l_suppkey')}, 'p'||l_partkey, p_name, 'uses', 's'||l_suppkey, s_name, 'domain', 'data' FROM ol
 UNION ALL SELECT DISTINCT l_orderkey, '4'||{PAD('l_orderkey')}||{PAD('l_suppkey')}, 's'||l_suppkey, s_name, 'is_part_of', 'n'||n_nationkey, n_name, 'domain', 'technology' FROM ol
 UNION ALL SELECT o_orderkey, '5'||{PAD('o_orderkey')}, 'c'||c_custkey, c_name, 'is_part_of', 'n'||n_nationkey, n_name, 'connection', 'business'
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
 UNION ALL SELECT DISTINCT l_orderkey, '6'||{PAD('l_orderkey')}||{PAD('n_nationkey')}, 'n'||n_nationkey, n_name, 'belongs_to', 'r'||r_regionkey, r_name, 'domain', 'technology' FROM ol)""",
    "seeds": "SELECT 'all' AS graph_id, 'c'||c_custkey AS id, c_name AS label FROM customer WHERE c_mktsegment='FURNITURE'",
    "ends": "SELECT graph_id, seq, predicate, origin, domain_type, 0 AS side, subject_id AS id, subject_label AS label FROM triples UNION ALL SELECT graph_id, seq, predicate, origin, domain_type, 1, object_id, object_label FROM triples",
    "nodes": """SELECT graph_id, id, arg_min(label, (seq, side)) AS label, arg_min(origin, (seq, side)) AS "group",
      arg_min(origin, (seq, side)) AS origin_label, arg_min(domain_type, (seq, side)) AS domain_type, min(seq) AS first_seq FROM ends GROUP BY ALL""",
    "links": "SELECT graph_id, seq, subject_id AS source, object_id AS target, predicate AS label, origin FROM triples",
    "oends": "SELECT graph_id, subject_id AS id, subject_label AS label FROM order_triples UNION ALL SELECT graph_id, object_id, object_label FROM order_triples",
    "olinks": "SELECT graph_id, seq, subject_id AS source, object_id AS target, predicate AS label, origin FROM order_triples",
    "onodes": "SELECT DISTINCT graph_id, id FROM oends",
    "oadj": "SELECT DISTINCT graph_id, source AS node, target AS nbr FROM olinks UNION SELECT graph_id, target, source FROM olinks",
    "vecs": "SELECT 'all' AS graph_id, 'v'||vec_id AS id, vec_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label, CASE label % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'system' WHEN 2 THEN 'data' ELSE 'technology' END AS layer FROM embeddings",
    "vlinks": "SELECT 'all' AS graph_id, 'v'||vec_id AS source, 'v'||((vec_id*7+1) % (SELECT count(*) FROM embeddings)) AS target FROM embeddings UNION ALL SELECT 'all', 'v'||vec_id, 'v'||((vec_id*13+5) % (SELECT count(*) FROM embeddings)) FROM embeddings",
    "ev": """SELECT 'u'||user_id||'_'||strftime(date_trunc('week', ts), '%Y%m%d') AS path_id, ts, event_id, event_type FROM events""",
    "steps": f"""SELECT path_id, pos, subject, predicate, object, {_layer('subject')} AS subject_layer, {_layer('object')} AS object_layer FROM (
      SELECT path_id, (row_number() OVER w - 1)::BIGINT AS pos, lag(event_type) OVER w AS subject, {_pred} AS predicate, event_type AS object
      FROM ev WINDOW w AS (PARTITION BY path_id ORDER BY ts, event_id)) WHERE subject IS NOT NULL""",
    "pairs": """SELECT u.conv_id||'_'||a.turn AS prompt_id, u.text AS prompt, a.text AS response FROM conversations u JOIN conversations a
      ON a.conv_id=u.conv_id AND a.turn=u.turn+1 WHERE u.role='user' AND a.role='assistant'""",
    "eval_wide": """SELECT l_orderkey::VARCHAR AS eval_id, c_mktsegment AS domain, CASE l_returnflag WHEN 'A' THEN 'gnn' WHEN 'N' THEN 'mcts' WHEN 'R' THEN 'rmodel' END AS model,
      avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity)/50 AS quantity, avg(l_extendedprice)/100000 AS price, count(DISTINCT l_partkey)::DOUBLE AS node_count
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey GROUP BY ALL""",
    "eval_long": "SELECT * FROM (UNPIVOT eval_wide ON discount, tax, quantity, price, node_count INTO NAME metric VALUE value)",
}


def with_views(body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the views it names, in dependency order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "''", text)) and name not in need:
                if text is VIEWS[name]:
                    continue
                if name in seen:
                    continue
                seen.add(name)
                visit(VIEWS[name])
                need.append(name)

    seen: set[str] = set()
    visit(body)
    if not need:
        return body
    body = body.strip()
    rec = "RECURSIVE " if recursive or body[:14].upper().startswith("WITH RECURSIVE") else ""
    if body[:4].upper() == "WITH":
        rest = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", body)
        return "WITH " + rec + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + ", " + rest
    return "WITH " + rec + ", ".join(f"{n} AS ({VIEWS[n]})" for n in need) + " " + body
