"""Further packs in one text for both dialects: sources, joins, panels, hunts, scored batteries."""

PACK = {
    # Inline rows, patterns, escapes
    "source_values": "WITH {soc} SELECT v.hostname, s.dst_port, count(*) AS n FROM (VALUES ('web', '10.1.1.1'), ('db', '10.2.2.2'), ('none', '0.0.0.0')) AS v(hostname, ip) JOIN soc s ON s.src_ip = v.ip GROUP BY v.hostname, s.dst_port",
    "filter_ilike_escape": "SELECT count(*) FILTER (WHERE p_type ILIKE '%A%') AS any_case, count(*) FILTER (WHERE p_name LIKE '%!%%' ESCAPE '!') AS percent, count(*) FILTER (WHERE p_brand LIKE 'Brand#_!_%' ESCAPE '!') AS underscore FROM part",
    # Joins
    "join_lateral": "SELECT c.c_custkey, t.most, t.n FROM customer c, LATERAL (SELECT max(o.o_totalprice) AS most, count(*) AS n FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') t",
    "join_cross_source": "WITH {store}, logs AS (SELECT 'auth' AS source, user_uid, time FROM auth WHERE outcome = 'FAILURE' UNION ALL SELECT 'api', actor_user_uid, time FROM api WHERE mfa_present = false) SELECT user_uid, count(*) AS n, count(DISTINCT source) AS sources, min(time) AS first_time FROM logs GROUP BY user_uid HAVING count(DISTINCT source) = 2",
    # Panels: all three, kept as partial sums of batches and merged
    "panel_time_series": "WITH {soc}, parts AS (SELECT time {div} 300000 AS bucket, count(*) AS n, sum(bytes_out) AS bytes FROM soc WHERE uid % 3 < 2 GROUP BY time {div} 300000 UNION ALL SELECT time {div} 300000, count(*), sum(bytes_out) FROM soc WHERE uid % 3 = 2 GROUP BY time {div} 300000) SELECT bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY bucket",
    "panel_failed_users": "WITH {soc}, parts AS (SELECT user_id, count(*) AS n FROM soc WHERE status_id = 2 AND uid % 3 < 2 GROUP BY user_id UNION ALL SELECT user_id, count(*) FROM soc WHERE status_id = 2 AND uid % 3 = 2 GROUP BY user_id) SELECT user_id, CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY user_id ORDER BY n DESC, user_id LIMIT 50",
    # Hunts
    "hunt_order_score": """WITH {soc}, m AS (SELECT user_id, min(CASE WHEN activity = 'signup' THEN time END) AS t0, min(CASE WHEN activity = 'view' THEN time END) AS t1,
  min(CASE WHEN activity = 'click' THEN time END) AS t2, min(CASE WHEN activity = 'error' THEN time END) AS t3, min(CASE WHEN activity = 'purchase' THEN time END) AS t4 FROM soc GROUP BY user_id),
p AS (SELECT user_id, a.rank_a, b.rank_b, a.t AS ta, b.t AS tb FROM (
    SELECT user_id, 0 AS rank_a, t0 AS t FROM m UNION ALL SELECT user_id, 1, t1 FROM m UNION ALL SELECT user_id, 2, t2 FROM m UNION ALL SELECT user_id, 3, t3 FROM m UNION ALL SELECT user_id, 4, t4 FROM m) a
  JOIN (SELECT user_id, 0 AS rank_b, t0 AS t FROM m UNION ALL SELECT user_id, 1, t1 FROM m UNION ALL SELECT user_id, 2, t2 FROM m UNION ALL SELECT user_id, 3, t3 FROM m UNION ALL SELECT user_id, 4, t4 FROM m) b USING (user_id)
  WHERE a.rank_a < b.rank_b),
s AS (SELECT user_id, count(*) FILTER (WHERE ta <= tb) AS concordant, count(*) FILTER (WHERE ta > tb) AS discordant FROM p GROUP BY user_id),
c AS (SELECT user_id, CASE WHEN t0 IS NULL THEN 0 ELSE 1 END + CASE WHEN t1 IS NULL THEN 0 ELSE 1 END + CASE WHEN t2 IS NULL THEN 0 ELSE 1 END + CASE WHEN t3 IS NULL THEN 0 ELSE 1 END + CASE WHEN t4 IS NULL THEN 0 ELSE 1 END AS found FROM m)
SELECT s.user_id, c.found, concordant, discordant, round(CASE WHEN c.found = 0 THEN 0.0 WHEN concordant + discordant = 0 THEN 1.0 ELSE (CAST(concordant - discordant AS DOUBLE) / (concordant + discordant) + 1) / 2 END * c.found / 5, 6) AS score
FROM s JOIN c USING (user_id)""",
    "hunt_no_mfa_precision": "WITH {store}, kept AS (SELECT event_uid, mfa_present AS truth, CASE WHEN event_uid % 11 = 0 THEN NULL ELSE mfa_present END AS strict, CASE WHEN event_uid % 11 = 0 THEN false ELSE mfa_present END AS filled FROM api WHERE api_operation = 'AttachUserPolicy') SELECT count(*) FILTER (WHERE strict = false) AS strict_hits, count(*) FILTER (WHERE filled = false) AS filled_hits, round(CAST(count(*) FILTER (WHERE strict = false AND truth = false) AS DOUBLE) / count(*) FILTER (WHERE strict = false), 6) AS strict_precision, round(CAST(count(*) FILTER (WHERE filled = false AND truth = false) AS DOUBLE) / count(*) FILTER (WHERE filled = false), 6) AS filled_precision FROM kept",
    "hunt_order_check": "WITH {soc}, c AS (SELECT user_id, time {div} 86400000 AS day, min(CASE WHEN activity = 'signup' THEN time END) AS a, min(CASE WHEN activity = 'click' THEN time END) AS b, min(CASE WHEN activity = 'purchase' THEN time END) AS c, max(time) - min(time) AS spread FROM soc GROUP BY user_id, time {div} 86400000) SELECT user_id, day, spread, a < b AND b < c AS in_order FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND spread <= 86400000",
    "merge_residual_gap": """WITH {soc}, obs AS (SELECT user_id AS asset, dst_port AS attribute, activity AS source, CASE WHEN bytes_out % 10 < 3 THEN NULL ELSE bytes_out % 4 END AS v, bytes_out % 10 AS h, (time {div} 86400000) AS day, 1 + uid % 4 AS authority, uid FROM soc WHERE uid % 2 = 0),
cells AS (SELECT DISTINCT user_id AS asset, dst_port AS attribute FROM soc),
single AS (SELECT source, count(*) AS covered FROM (SELECT DISTINCT source, asset, attribute FROM obs WHERE v IS NOT NULL) t GROUP BY source),
best AS (SELECT asset, attribute, v FROM (SELECT *, row_number() OVER (PARTITION BY asset, attribute ORDER BY power(0.5, CAST(19753 - day AS DOUBLE) / 7) + 0.1 * authority DESC, source, uid) AS r FROM obs WHERE v IS NOT NULL) t WHERE r = 1)
SELECT (SELECT count(*) FROM cells) AS cells, (SELECT max(covered) FROM single) AS best_single, count(b.v) AS merged, count(*) - count(b.v) AS residual, count(b.v) - (SELECT max(covered) FROM single) AS gained FROM cells c LEFT JOIN best b ON b.asset = c.asset AND b.attribute = c.attribute""",
    "compliance_by_year": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, min(o_orderkey) AS first_key, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CAST(year(o_orderdate) AS BIGINT)",
    "compliance_lineage": "WITH {soc}, seed AS (SELECT uid, user_id, time FROM soc WHERE uid = 1000), linked AS (SELECT s.uid, s.time, s.activity FROM soc s JOIN seed x ON s.user_id = x.user_id WHERE s.time BETWEEN x.time - 86400000 AND x.time + 86400000) SELECT uid, time, activity FROM linked",
    "rls_predicate_equals_view": "WITH {soc}, secured AS (SELECT * FROM soc WHERE tenant_id < 10), a AS (SELECT src_ip, sum(bytes_out) AS b FROM secured GROUP BY src_ip), p AS (SELECT src_ip, sum(bytes_out) AS b FROM soc WHERE tenant_id < 10 GROUP BY src_ip) SELECT count(*) AS n, count(*) FILTER (WHERE a.b = p.b) AS same FROM a FULL JOIN p ON a.src_ip = p.src_ip",
    # Nested records: all seven questions
    "nested_pack": """WITH {soc}, n AS (SELECT uid, {nested} FROM soc)
SELECT 'all' AS question, count(*) AS n FROM n UNION ALL SELECT 'struct_string', count(*) FROM n WHERE src_endpoint.ip = '10.1.1.1' UNION ALL SELECT 'struct_int', count(*) FROM n WHERE dst_endpoint.port = 3389
UNION ALL SELECT 'second_field', count(*) FROM n WHERE src_endpoint.port = 30000 UNION ALL SELECT 'list_length', count(*) FROM n WHERE {size}(observables) = 3
UNION ALL SELECT 'any_21', count(*) FROM n WHERE {any21} UNION ALL SELECT 'any_2', count(*) FROM n WHERE {any2}""",
    # Predicate classes by probe values against what the generator put there
    "predicate_matrix": """WITH {soc}, named AS (SELECT CASE user_id % 8 WHEN 0 THEN 'alice' WHEN 1 THEN 'Alice' WHEN 2 THEN '' WHEN 3 THEN 'al%ice' WHEN 4 THEN 'a_b' WHEN 5 THEN 'é' WHEN 6 THEN 'alice ' END AS name, user_id % 8 AS kind FROM soc),
probes AS (SELECT 'alice' AS v, 0 AS k UNION ALL SELECT 'Alice', 1 UNION ALL SELECT '', 2 UNION ALL SELECT 'al%ice', 3 UNION ALL SELECT 'a_b', 4 UNION ALL SELECT 'é', 5 UNION ALL SELECT 'alice ', 6 UNION ALL SELECT 'absent', 99)
SELECT p.v, count(*) FILTER (WHERE n.kind = p.k) AS truth, count(*) FILTER (WHERE n.name = p.v) AS eq, count(*) FILTER (WHERE n.name IN (p.v)) AS isin, count(*) FILTER (WHERE n.name LIKE p.v) AS lk FROM probes p LEFT JOIN named n ON true GROUP BY p.v""",
    # Both batteries over the full and the coarse store, one score each
    "battery": """WITH {store},
net5 AS (SELECT {half_even} AS time, src_ip, dst_port, CAST(count(*) AS BIGINT) AS flows, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM soc WHERE activity IN ('view', 'click') GROUP BY {half_even}, src_ip, dst_port),
proc_n AS (SELECT event_uid, time + 60000 AS time, device_hostname, image_name, left(cmd_line, 20) AS cmd_line FROM process),
api_n AS (SELECT event_uid, time + 60000 AS time, actor_user_uid, api_operation, CASE WHEN event_uid % 11 = 0 THEN false ELSE mfa_present END AS mfa_present FROM api),
dns_n AS (SELECT event_uid, src_hostname, query_hostname FROM dns WHERE query_hostname IN (SELECT query_hostname FROM dns GROUP BY query_hostname HAVING count(*) >= 3)),
cand AS (SELECT src_ip, dst_ip, dst_port FROM network GROUP BY src_ip, dst_ip, dst_port HAVING count(*) >= 2 AND avg(bytes_out + bytes_in) < 2000),
counts AS (
  SELECT 'R1' AS id, (SELECT count(*) FROM auth) AS truth, (SELECT count(*) FROM auth) AS f, (SELECT count(*) FROM auth) AS n
  UNION ALL SELECT 'R2', 5, 5, (SELECT count(*) FROM (SELECT dst_port FROM network GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 5) a JOIN (SELECT dst_port FROM net5 GROUP BY dst_port ORDER BY sum(flows) DESC, dst_port LIMIT 5) b ON a.dst_port = b.dst_port)
  UNION ALL SELECT 'R3', (SELECT count(*) FROM auth WHERE outcome = 'FAILURE'), (SELECT count(*) FROM auth WHERE outcome = 'FAILURE'), (SELECT count(*) FROM auth WHERE outcome = 'FAILURE')
  UNION ALL SELECT 'R4', (SELECT sum(bytes_out) FROM network), (SELECT sum(bytes_out) FROM network), (SELECT sum(bytes_out) FROM net5)
  UNION ALL SELECT 'R5', 3, 3, (SELECT count(DISTINCT image_name) FROM proc_n)
  UNION ALL SELECT 'R6', (SELECT count(*) FROM api), (SELECT count(*) FROM api), (SELECT count(*) FROM api_n)
  UNION ALL SELECT 'A1', (SELECT count(*) FROM network n JOIN cand c ON n.src_ip = c.src_ip AND n.dst_ip = c.dst_ip AND n.dst_port = c.dst_port), (SELECT count(*) FROM network n JOIN cand c ON n.src_ip = c.src_ip AND n.dst_ip = c.dst_ip AND n.dst_port = c.dst_port), 0
  UNION ALL SELECT 'A2', (SELECT count(*) FROM process WHERE cmd_line LIKE '%-EncodedCommand %'), (SELECT count(*) FROM process WHERE cmd_line LIKE '%-EncodedCommand %'), (SELECT count(*) FROM proc_n WHERE cmd_line LIKE '%-EncodedCommand %')
  UNION ALL SELECT 'A4', (SELECT count(*) FROM session WHERE start_time <= 1705320000000 AND end_time >= 1705320000000), (SELECT count(*) FROM session WHERE start_time <= 1705320000000 AND end_time >= 1705320000000), 0
  UNION ALL SELECT 'A5', (SELECT count(DISTINCT user_uid) FROM session WHERE host IN ('WS1', 'WS2')), (SELECT count(DISTINCT user_uid) FROM session WHERE host IN ('WS1', 'WS2')), (SELECT count(DISTINCT host) FROM session WHERE host = 'WS1')
  UNION ALL SELECT 'A6', (SELECT count(*) FROM api WHERE api_operation = 'AttachUserPolicy' AND mfa_present = false), (SELECT count(*) FROM api WHERE api_operation = 'AttachUserPolicy' AND mfa_present = false), (SELECT count(*) FROM api_n WHERE api_operation = 'AttachUserPolicy' AND mfa_present = false)
  UNION ALL SELECT 'A7', (SELECT max(time) - min(time) FROM process WHERE device_hostname = 'WS1'), (SELECT max(time) - min(time) FROM process WHERE device_hostname = 'WS1'), (SELECT max(time) - min(time) - 60000 FROM proc_n WHERE device_hostname = 'WS1')
  UNION ALL SELECT 'A8', (SELECT count(DISTINCT query_hostname) FROM dns WHERE src_hostname = 'WS1'), (SELECT count(DISTINCT query_hostname) FROM dns WHERE src_hostname = 'WS1'), (SELECT count(DISTINCT query_hostname) FROM dns_n WHERE src_hostname = 'WS1')
  UNION ALL SELECT 'A9', (SELECT count(DISTINCT canonical_asset) FROM asset WHERE hostname IN ('WS1', 'WS2')), (SELECT count(DISTINCT canonical_asset) FROM asset WHERE hostname IN ('WS1', 'WS2')), (SELECT count(*) FROM (SELECT hostname AS x FROM asset WHERE hostname IN ('WS1', 'WS2') UNION SELECT ip FROM asset WHERE hostname IN ('WS1', 'WS2')) t)
  UNION ALL SELECT 'A10', (SELECT count(*) FROM soc WHERE time BETWEEN 1705276800000 AND 1705363200000), (SELECT count(*) FROM soc WHERE time BETWEEN 1705276800000 AND 1705363200000), (SELECT count(*) FROM soc WHERE time BETWEEN 1705276800000 AND 1705363200000 AND time + (uid % 13) * 600000 BETWEEN 1705276800000 AND 1705363200000)),
order_score AS (SELECT 'A3' AS id, round(avg(f), 6) AS f, round(avg(n), 6) AS n FROM (
  SELECT CASE WHEN a < b THEN CAST(1 AS DOUBLE) ELSE 0 END AS f, CASE WHEN a {div} 300000 < b {div} 300000 THEN CAST(1 AS DOUBLE) ELSE 0 END AS n FROM (
    SELECT user_id, min(CASE WHEN activity = 'error' THEN time END) AS a, min(CASE WHEN activity = 'purchase' THEN time END) AS b FROM soc GROUP BY user_id) t WHERE a IS NOT NULL AND b IS NOT NULL) s)
SELECT id, round(CASE WHEN truth = 0 THEN CASE WHEN f = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1.0 - abs(CAST(f - truth AS DOUBLE)) / truth) END, 6) AS full_score,
  round(CASE WHEN truth = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1.0 - abs(CAST(n - truth AS DOUBLE)) / truth) END, 6) AS coarse_score FROM counts
UNION ALL SELECT id, CAST(f AS DOUBLE), CAST(n AS DOUBLE) FROM order_score""",
}
