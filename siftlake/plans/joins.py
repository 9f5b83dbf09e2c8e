"""Join packs: TPC-H shapes adapted to the tables at hand, correlations, enrichment, star and nested queries."""

def cents(x: str) -> str:
    """A money sum as whole cents: rows are rounded before they are added, so order does not matter."""
    return f"CAST(sum(CAST(round({x} * 100) AS BIGINT)) AS BIGINT)"


REVENUE = "l_extendedprice * (1 - l_discount)"

PACK = {
    "tpch_q3": f"""SELECT o.o_orderkey, {cents(REVENUE)} AS revenue, o.o_orderpriority
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l.l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY o.o_orderkey, o.o_orderpriority ORDER BY revenue DESC, o.o_orderkey LIMIT 10""",
    "tpch_q5": f"""SELECT n.n_name, {cents(REVENUE)} AS revenue
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = c.c_nationkey
WHERE r.r_name = 'ASIA' AND o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o.o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
GROUP BY n.n_name""",
    "tpch_q9": f"""SELECT n.n_name AS nation, CAST(year(o.o_orderdate) AS BIGINT) AS o_year, {cents(REVENUE + ' - 0.6 * p_retailprice * l_quantity')} AS profit
FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN nation n ON n.n_nationkey = s.s_nationkey
WHERE p.p_name LIKE '%1%' GROUP BY n.n_name, CAST(year(o.o_orderdate) AS BIGINT)""",
    "tpch_q18": """SELECT c.c_name, c.c_custkey, o.o_orderkey, CAST(sum(l.l_quantity) AS BIGINT) AS quantity
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
GROUP BY c.c_name, c.c_custkey, o.o_orderkey ORDER BY quantity DESC, o.o_orderkey LIMIT 100""",
    "tpch_q21": """SELECT s.s_name, count(*) AS numwait
FROM supplier s JOIN lineitem l1 ON s.s_suppkey = l1.l_suppkey JOIN orders o ON o.o_orderkey = l1.l_orderkey
WHERE o.o_orderstatus = 'F' AND l1.l_returnflag = 'R'
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s.s_name ORDER BY numwait DESC, s.s_name LIMIT 100""",
    "join_dim_enrichment": "SELECT n.n_name AS site, c.c_mktsegment AS dept, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, c.c_mktsegment",
    "join_two_streams": "WITH {soc}, e AS (SELECT src_ip, count(*) AS errors FROM soc WHERE activity = 'error' GROUP BY src_ip HAVING count(*) >= 5), v AS (SELECT src_ip, count(*) AS views FROM soc WHERE activity = 'view' GROUP BY src_ip HAVING count(*) >= 5) SELECT e.src_ip, errors, views FROM e JOIN v ON e.src_ip = v.src_ip",
    "join_ioc_semi": "SELECT l_shipdate, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY l_shipdate",
    "join_tax_flat": "WITH flat AS (SELECT l_quantity, l_partkey % 10 AS k FROM lineitem) SELECT k, CAST(sum(l_quantity) AS BIGINT) AS q FROM flat GROUP BY k",
    "join_tax_joined": "SELECT p.p_partkey % 10 AS k, CAST(sum(l.l_quantity) AS BIGINT) AS q FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey % 10",
    "join_left_coalesce": "WITH {soc}, a AS (SELECT user_id, max(bytes_out) AS v FROM soc WHERE dst_port = 22 GROUP BY user_id), b AS (SELECT user_id, max(bytes_out) AS v FROM soc WHERE dst_port = 53 GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM soc) SELECT u.user_id, coalesce(a.v, b.v, -1) AS picked FROM u LEFT JOIN a ON u.user_id = a.user_id LEFT JOIN b ON u.user_id = b.user_id",
    "join_left_degenerate": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000 AND o.o_orderstatus = 'P'",
    "join_shared_keys": "WITH {soc}, keys AS (SELECT DISTINCT activity AS source, user_id, time {div} 60000 AS key_value FROM soc) SELECT a.user_id AS u, b.user_id AS v, a.key_value FROM keys a JOIN keys b ON a.key_value = b.key_value AND a.source < b.source",
    "join_alias_resolution": "WITH {soc}, dns AS (SELECT DISTINCT src_ip, concat('host', CAST(user_id AS STRING)) AS hostname FROM soc) SELECT s.uid, d.hostname FROM soc s JOIN dns d ON s.src_ip = d.src_ip WHERE s.dst_port = 3389 UNION SELECT s.uid, d.hostname FROM soc s JOIN dns d ON concat('host', CAST(s.user_id AS STRING)) = d.hostname WHERE s.dst_port = 3389",
    "join_gold_coverage": "WITH {soc}, gold AS (SELECT uid, bytes_out FROM soc), emitted AS (SELECT uid, CASE WHEN uid % 9 = 0 THEN bytes_out + 1 ELSE bytes_out END AS bytes_out FROM soc WHERE activity <> 'view') SELECT count(*) AS gold, count(e.uid) AS covered, count(*) FILTER (WHERE g.bytes_out = e.bytes_out) AS equal FROM gold g LEFT JOIN emitted e ON g.uid = e.uid",
    "graph_star_coverage": "SELECT r.r_name, count(DISTINCT n.n_nationkey) AS nations, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT o.o_orderkey) AS orders FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name",
    "sql_process_tree": "WITH RECURSIVE tree AS (SELECT event_id AS pid, 0 AS depth FROM events WHERE event_id = 1 UNION ALL SELECT e.event_id, t.depth + 1 FROM tree t JOIN events e ON e.event_id {div} 4 = t.pid AND e.event_id <> t.pid WHERE t.depth < 10) SELECT pid, depth FROM tree",
    "merge_cross_tool": "WITH {soc}, obs AS (SELECT user_id AS asset, activity AS source, dst_port AS attribute, bytes_out AS v, (time {div} 86400000) AS day, 1 + uid % 4 AS authority, uid FROM soc), scored AS (SELECT *, power(0.5, CAST(19753 - day AS DOUBLE) / 7) + 0.1 * authority AS score FROM obs), best AS (SELECT asset, attribute, source, v, row_number() OVER (PARTITION BY asset, attribute ORDER BY score DESC, source, uid) AS r FROM scored) SELECT asset, attribute, source, v FROM best WHERE r = 1",
    "merge_authority_only": "WITH {soc}, obs AS (SELECT user_id AS asset, dst_port AS attribute, activity AS source, bytes_out AS v, 1 + uid % 4 AS authority, uid FROM soc) SELECT asset, attribute, source, v FROM (SELECT *, row_number() OVER (PARTITION BY asset, attribute ORDER BY authority DESC, source, uid) AS r FROM obs) t WHERE r = 1",
    "score_prf": "WITH {soc}, truth AS (SELECT uid FROM soc WHERE bytes_out > 8000), found AS (SELECT uid FROM soc WHERE bytes_out > 9000 OR uid % 50 = 0) SELECT (SELECT count(*) FROM truth) AS truth_n, (SELECT count(*) FROM found) AS found_n, count(*) AS tp FROM truth JOIN found ON truth.uid = found.uid",
    "null_battery": """SELECT count(*) FILTER (WHERE s <> 'evil') AS neq, count(*) FILTER (WHERE s IN ('allow1', 'allow2')) AS isin,
  count(*) FILTER (WHERE s NOT IN ('allow1', 'allow2')) AS notin, count(*) FILTER (WHERE s NOT IN ('allow1', NULL)) AS notin_null,
  count(s) AS counted, count(*) FILTER (WHERE s IS NULL) AS nulls, count(*) FILTER (WHERE s = '') AS empty,
  count(*) FILTER (WHERE s <> 'evil' OR s IS NULL) AS neq_or_null, count(*) FILTER (WHERE i = 5) AS five, count(*) FILTER (WHERE i <> 5) AS not_five,
  count(*) FILTER (WHERE coalesce(i, 0) = 0) AS zero
FROM (SELECT CASE event_type WHEN 'view' THEN 'allow1' WHEN 'click' THEN 'allow2' WHEN 'error' THEN 'evil' WHEN 'signup' THEN '' END AS s,
  CASE WHEN value < 2 THEN 5 WHEN value < 8 THEN 7 END AS i FROM events) t""",
}
