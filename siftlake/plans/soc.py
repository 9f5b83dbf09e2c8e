"""Scan, aggregate, window and top-k packs over the event log."""

PACK = {
    # Security-operations analytics
    "soc_scan_rollup": "WITH {soc} SELECT activity, class_uid, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc GROUP BY activity, class_uid",
    "soc_top_talkers": "WITH {soc} SELECT user_id, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc GROUP BY user_id ORDER BY bytes DESC, user_id LIMIT 20",
    "soc_selective_window": "WITH {soc} SELECT count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc WHERE time >= 1704931200000 AND time < 1705017600000 AND dst_port = 443",
    "soc_time_buckets": "WITH {soc} SELECT time {div} 300000 AS bucket, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc GROUP BY time {div} 300000",
    "soc_failed_burst": "WITH {soc} SELECT user_id, count(*) AS failures FROM soc WHERE status_id = 2 GROUP BY user_id HAVING count(*) >= 10",
    # Connection-log flagship
    "flagship_count_all": "SELECT count(*) AS n FROM events",
    "flagship_top_sources_by_bytes": "WITH {soc} SELECT src_ip, CAST(sum(coalesce(bytes_out, 0) + coalesce(k, 0)) AS BIGINT) AS total_bytes FROM soc GROUP BY src_ip ORDER BY total_bytes DESC, src_ip LIMIT 10",
    "flagship_protocol_distribution": "WITH {soc} SELECT proto, count(*) AS n FROM soc GROUP BY proto ORDER BY n DESC, proto",
    "flagship_long_connections": "WITH {soc} SELECT uid, src_ip, dst_ip, bytes_out FROM soc ORDER BY bytes_out DESC, uid LIMIT 10",
    "flagship_port_scan": "WITH {soc} SELECT src_ip, count(DISTINCT dst_ip) AS hosts, count(DISTINCT dst_port) AS ports FROM soc GROUP BY src_ip HAVING count(DISTINCT dst_ip) > 20 AND count(DISTINCT dst_port) >= 5",
    # Large scans
    "scan_filtered": "WITH {soc} SELECT count(*) AS n FROM soc WHERE dst_port = 443 AND bytes_out > 1000",
    "scan_topn_src": "WITH {soc} SELECT src_ip, count(*) AS n FROM soc GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 20",
    "scan_byte_rollup": "WITH {soc} SELECT dst_port, CAST(sum(bytes_out) AS BIGINT) AS bytes, min(bytes_out) AS least, max(bytes_out) AS most FROM soc GROUP BY dst_port",
    "scan_subnet_rollup": "WITH {soc} SELECT CAST(split_part(src_ip, '.', 2) AS INT) AS net, CAST(split_part(src_ip, '.', 3) AS INT) AS subnet, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc GROUP BY CAST(split_part(src_ip, '.', 2) AS INT), CAST(split_part(src_ip, '.', 3) AS INT)",
    # Filters and predicates
    "filter_range": "WITH {soc} SELECT count(*) AS n FROM soc WHERE bytes_out BETWEEN 1000 AND 5000 AND dst_port <> 22 AND time >= 1704067200000",
    "filter_point_lookup": "WITH {soc}, rare AS (SELECT src_ip FROM soc GROUP BY src_ip ORDER BY count(*), src_ip LIMIT 1) SELECT uid, time, src_ip, bytes_out FROM soc WHERE src_ip IN (SELECT src_ip FROM rare)",
    "filter_in_list": "WITH {soc} SELECT dst_port, count(*) AS n FROM soc WHERE dst_port IN (22, 3389) GROUP BY dst_port",
    "filter_null_disjunction": "WITH {soc} SELECT count(*) AS n FROM (SELECT CASE WHEN uid % 7 = 0 THEN NULL WHEN uid % 2 = 0 THEN 'true' ELSE 'false' END AS mfa FROM soc) t WHERE mfa <> 'true' OR mfa IS NULL",
    "filter_like": "SELECT count(*) AS n FROM part WHERE p_name LIKE '%1%' AND p_type LIKE '%' AND lower(p_brand) LIKE 'brand%'",
    "filter_point_in_time": "WITH {soc}, session AS (SELECT user_id, time {div} 3600000 AS hour, min(time) AS start_time, max(time) AS end_time FROM soc GROUP BY user_id, time {div} 3600000) SELECT user_id, start_time, end_time FROM session WHERE start_time <= 1705000000000 AND end_time >= 1704990000000",
    "filtered_aggregates": "WITH {soc} SELECT user_id, count(*) FILTER (WHERE status_id = 2) AS failures, count(*) FILTER (WHERE dst_port = 22) AS ssh, count(k) AS with_k FROM soc GROUP BY user_id",
    "distinct_pairs": "WITH {soc} SELECT DISTINCT src_ip, dst_port FROM soc",
    "case_lookup": "WITH {soc} SELECT CASE activity WHEN 'error' THEN 30 WHEN 'purchase' THEN 90 ELSE 365 END AS half_life, count(*) AS n FROM soc GROUP BY CASE activity WHEN 'error' THEN 30 WHEN 'purchase' THEN 90 ELSE 365 END",
    "limit_offset": "WITH {soc} SELECT uid, src_ip FROM soc ORDER BY bytes_out DESC, uid LIMIT 1 OFFSET 10",
    # Aggregates
    "agg_basic": "WITH {soc} SELECT activity, count(*) AS n, min(bytes_out) AS least, max(bytes_out) AS most, CAST(sum(bytes_out) AS BIGINT) AS total, CAST(round(avg(bytes_out)) AS BIGINT) AS mean FROM soc GROUP BY activity",
    "agg_variation": "WITH {soc} SELECT user_id, round(stddev_pop(bytes_out) / avg(bytes_out), 4) AS cv, round(stddev_samp(bytes_out), 2) AS sd FROM soc GROUP BY user_id HAVING count(*) > 1",
    "agg_span_and_mean": "WITH {soc} SELECT src_ip, dst_ip, count(*) AS n, max(time) - min(time) AS span FROM soc GROUP BY src_ip, dst_ip HAVING count(*) >= 2 AND max(time) - min(time) BETWEEN 1000 AND 1728000000 AND avg(bytes_out) < 20000",
    "agg_of_aggregates": "WITH {soc}, b AS (SELECT src_ip, time {div} 300000 AS bucket, count(*) AS n, sum(bytes_out) AS bytes FROM soc GROUP BY src_ip, time {div} 300000) SELECT src_ip, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS buckets FROM b GROUP BY src_ip",
    "agg_median_mode": "WITH {soc}, ranked AS (SELECT dst_port, user_id, row_number() OVER (PARTITION BY dst_port ORDER BY count(*) DESC, user_id) AS r FROM soc GROUP BY dst_port, user_id) SELECT s.dst_port, CAST(median(s.bytes_out) * 2 AS BIGINT) AS twice_median, max(m.user_id) AS mode_user FROM soc s JOIN ranked m ON m.dst_port = s.dst_port AND m.r = 1 GROUP BY s.dst_port",
    "agg_bool_or": "WITH {soc} SELECT user_id, bool_or(status_id = 2) AS failed, bool_and(bytes_out > 0) AS all_sent FROM soc GROUP BY user_id",
    # Windows
    "window_gap_lag": "WITH {soc} SELECT uid, src_ip, time - lag(time) OVER (PARTITION BY src_ip ORDER BY time, uid) AS gap FROM soc",
    "window_best_per_group": "WITH {soc} SELECT src_ip, uid, bytes_out FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY bytes_out DESC, uid) AS r FROM soc) t WHERE r = 1",
    "window_over_aggregate": "WITH {soc} SELECT src_ip, dst_port, n FROM (SELECT src_ip, dst_port, n, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, dst_port) AS r FROM (SELECT src_ip, dst_port, count(*) AS n FROM soc GROUP BY src_ip, dst_port) a) t WHERE r = 1",
    "window_sliding_count": "WITH {soc} SELECT uid, count(*) OVER (PARTITION BY src_ip ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM soc",
    # Sets
    "set_union_typed_nulls": "WITH {soc} SELECT time, class_uid, src_ip, CAST(NULL AS BIGINT) AS bytes, activity FROM soc WHERE class_uid = 3002 UNION ALL SELECT time, class_uid, CAST(NULL AS STRING), bytes_out, CAST(NULL AS STRING) FROM soc WHERE class_uid = 4001",
    "set_intersect": "WITH {soc} SELECT user_id FROM soc WHERE status_id = 2 INTERSECT SELECT user_id FROM soc WHERE dst_port = 22",
    "set_except": "WITH {soc} SELECT user_id FROM soc EXCEPT SELECT user_id FROM soc WHERE status_id = 2 AND dst_port = 22",
    # Row-level security tiers, the secured view inside every query
    "rls_count": "WITH {soc}, secured AS (SELECT * FROM soc WHERE tenant_id < 10) SELECT count(*) AS n FROM secured",
    "rls_top_talkers": "WITH {soc}, secured AS (SELECT * FROM soc WHERE tenant_id < 10) SELECT src_ip, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM secured GROUP BY src_ip ORDER BY bytes DESC, src_ip LIMIT 10",
    "rls_by_activity": "WITH {soc}, secured AS (SELECT * FROM soc WHERE tenant_id < 50) SELECT activity, count(*) AS n FROM secured GROUP BY activity",
    "rls_needle": "WITH {soc}, secured AS (SELECT * FROM soc WHERE tenant_id < 1) SELECT uid, time, src_ip FROM secured ORDER BY time, uid LIMIT 1",
    # Pruning predicates
    "prune_ip_time": "WITH {soc} SELECT count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc WHERE src_ip = '10.1.1.1' AND time BETWEEN 1704067200000 AND 1705500000000",
    "prune_port_ip": "WITH {soc} SELECT count(*) AS n FROM soc WHERE dst_port IN (443, 3389) AND src_ip IN ('10.1.1.1', '10.2.2.2', '10.3.3.3')",
    "prune_endpoint_port": "WITH {soc} SELECT count(*) AS n FROM soc WHERE dst_ip = '172.16.0.0' AND dst_port = 22",
    "prune_time": "WITH {soc} SELECT count(*) AS n FROM soc WHERE time BETWEEN 1704153600000 AND 1704240000000",
    # Materialized panels: partial aggregates of batches, merged
    "mv_class_rollup": "WITH {soc}, parts AS (SELECT class_uid, activity, count(*) AS n, sum(bytes_out) AS bytes FROM soc WHERE uid % 4 < 3 GROUP BY class_uid, activity UNION ALL SELECT class_uid, activity, count(*), sum(bytes_out) FROM soc WHERE uid % 4 = 3 GROUP BY class_uid, activity) SELECT class_uid, activity, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM parts GROUP BY class_uid, activity",
    "mv_failed_auth_by_user": "WITH {soc} SELECT user_id, count(*) AS failures FROM soc WHERE class_uid = 3002 AND status_id = 2 GROUP BY user_id",
    # Detection composites
    "hunt_beacon": "WITH {soc}, gaps AS (SELECT src_ip, dst_port, time - lag(time) OVER (PARTITION BY src_ip, dst_port ORDER BY time, uid) AS gap FROM soc) SELECT src_ip, dst_port, count(gap) AS n, round(stddev_pop(gap) / avg(gap), 4) AS cv FROM gaps WHERE gap IS NOT NULL GROUP BY src_ip, dst_port HAVING count(gap) >= 5 AND avg(gap) > 0 AND stddev_pop(gap) / avg(gap) < 0.8",
    "hunt_beacon_events": "WITH {soc}, c AS (SELECT src_ip, dst_ip, dst_port FROM soc GROUP BY src_ip, dst_ip, dst_port HAVING count(*) >= 2 AND max(time) - min(time) < 864000000) SELECT s.uid FROM soc s JOIN c USING (src_ip, dst_ip, dst_port)",
    "hunt_coarse_beacon": "WITH {soc}, b AS (SELECT src_ip, time {div} 3600000 AS bucket, count(*) AS cnt FROM soc GROUP BY src_ip, time {div} 3600000) SELECT src_ip, count(*) AS buckets, CAST(sum(cnt) AS BIGINT) AS n FROM b GROUP BY src_ip HAVING count(*) >= 10 AND max(cnt) <= 3",
    "hunt_first_seen": "WITH {soc} SELECT dst_ip, dst_port, min(uid) AS uid FROM soc GROUP BY dst_ip, dst_port HAVING count(*) = 1",
    "hunt_rare_values": "WITH {soc} SELECT uid FROM soc WHERE dst_ip IN (SELECT dst_ip FROM soc GROUP BY dst_ip HAVING count(*) >= 30)",
    "hunt_kill_chain": "WITH {soc}, m AS (SELECT user_id, min(CASE WHEN activity = 'signup' THEN time END) AS t1, min(CASE WHEN activity = 'error' THEN time END) AS t2, min(CASE WHEN activity = 'purchase' THEN time END) AS t3 FROM soc GROUP BY user_id) SELECT user_id, t1, t2, t3, CASE WHEN t1 < t2 THEN 1 ELSE 0 END + CASE WHEN t1 < t3 THEN 1 ELSE 0 END + CASE WHEN t2 < t3 THEN 1 ELSE 0 END AS concordant, t3 - t2 AS dwell FROM m WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL",
    "hunt_no_mfa": "WITH {soc}, api AS (SELECT uid, user_id, CASE WHEN uid % 11 = 0 THEN NULL ELSE uid % 3 = 0 END AS mfa_value FROM soc WHERE class_uid = 3002) SELECT uid, user_id, mfa_value IS NOT NULL AS mfa_present FROM api WHERE mfa_value IS NULL",
    "hunt_identity_closure": "WITH {soc} SELECT DISTINCT user_id, concat('S-1-5-', CAST(user_id AS STRING)) AS sid, concat('user', CAST(user_id AS STRING), '@corp') AS upn, split_part(concat('user', CAST(user_id AS STRING), '@corp'), '@', 1) AS local_part FROM soc WHERE status_id = 2",
    "hunt_floating_chain": "WITH {soc} SELECT user_id, time {div} 86400000 AS day, max(time) - min(time) AS spread, count(DISTINCT activity) AS sources FROM soc GROUP BY user_id, time {div} 86400000 HAVING max(time) - min(time) <= 3600000 AND count(*) > 1",
    "compliance_retention": "WITH {soc} SELECT (time {div} 86400000) {div} 7 AS week, count(*) AS n, min(time) AS oldest FROM soc GROUP BY (time {div} 86400000) {div} 7",
    "compliance_timeline": "WITH {soc} SELECT uid, time, activity FROM soc WHERE user_id IN (SELECT user_id FROM soc WHERE status_id = 2 GROUP BY user_id HAVING count(*) >= 20) AND activity IN ('error', 'signup')",
    "marimo_hunt": "WITH {soc} SELECT count(*) FILTER (WHERE k IS NULL) AS absent, count(*) FILTER (WHERE k IS NOT NULL AND k < 50) AS low FROM soc",
    # Coarse store: the bucket rounds half to even, command text is cut, rare values are dropped
    "store_coarse_network": "WITH {soc} SELECT {half_even} AS time, src_ip, dst_port, CAST(count(*) AS BIGINT) AS flow_count, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM soc WHERE class_uid = 4001 GROUP BY {half_even}, src_ip, dst_port",
    "store_fidelity_auth": "WITH {soc} SELECT concat('auth-', CAST(uid AS STRING)) AS event_uid, 3002 AS class_uid, time, time + (uid % 13) * 60000 AS logged_time, user_id, src_ip, status_id = 1 AS is_success, dst_port IN (22, 3389) AS is_remote FROM soc WHERE class_uid = 3002",
    "store_late_events": "WITH {soc} SELECT uid, (uid % 13) * 60000 AS late_by FROM soc WHERE (uid % 13) * 60000 > 600000",
    # Scalar functions
    "fn_strings": "SELECT p_partkey, left(p_name, 4) AS head, split_part(p_brand, '#', 2) AS tail, lpad(CAST(p_size AS STRING), 4, '0') AS padded, concat(p_type, '|', p_brand) AS joined, repeat('x', 3) AS xs FROM part",
    "fn_hash": "SELECT p_partkey, md5(concat(p_name, p_brand)) AS m FROM part",
    "fn_numbers": "WITH {soc} SELECT uid, abs(bytes_out - 5000) AS d, least(bytes_out, 100) AS lo, greatest(bytes_out, 100) AS hi, bytes_out {div} 300 AS q, bytes_out % 7 AS r, round(power(0.5, CAST(uid % 90 AS DOUBLE) / 30), 6) AS decay FROM soc",
    "fn_ipv4": "WITH {soc}, n AS (SELECT uid, CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS ip FROM soc) SELECT uid, ip, ip - ip % 256 AS subnet FROM n",
    "fn_json": "WITH {soc} SELECT uid, k FROM soc WHERE k > 90",
    "fn_year": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY CAST(year(o_orderdate) AS BIGINT)",
    "fn_regex": "SELECT p_partkey, regexp_extract(p_brand, '[0-9]+', 0) AS digits, p_type LIKE '%a%' AS has_a FROM part",
    "fn_casts": "SELECT p_partkey, CAST(p_size AS STRING) AS s, TRY_CAST(p_name AS BIGINT) AS i, CAST(NULL AS INT) AS none FROM part",
    "fn_days": "WITH {soc} SELECT uid, round(time / 86400000.0, 6) AS day FROM soc",
    "agg_sorted_sets": "WITH {soc} SELECT user_id, {sorted_ports} AS ports, bool_or(status_id = 2) AS failed FROM soc GROUP BY user_id",
    "agg_ordered_digest": "WITH {soc}, lines AS (SELECT tenant_id, concat(CAST(uid AS STRING), ':', activity) AS line FROM soc) SELECT tenant_id, md5({ordered_lines}) AS digest FROM lines GROUP BY tenant_id",
}
