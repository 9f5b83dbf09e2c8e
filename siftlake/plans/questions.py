"""Analysts' questions to the event store in seven tiers, as the SQL that answers them."""

_DAY = "1705276800000"  # 2024-01-15

_ONE = {
    # Simple filters
    "f01_failed_logons": "count(*) AS answer FROM auth WHERE outcome = 'FAILURE'",
    "f02_remote_logons": "count(*) AS answer FROM auth WHERE is_remote",
    "f03_operations": "DISTINCT api_operation AS answer FROM api",
    "f04_processes_of_host": "count(*) AS answer FROM process WHERE device_hostname = 'WS1'",
    "f05_connections": "count(*) AS answer FROM network",
    # Aggregates
    "g01_bytes": "CAST(sum(bytes_out) AS BIGINT) AS answer FROM network",
    "g02_ports": "count(DISTINCT dst_port) AS answer FROM network",
    "g03_mean_duration": "round(avg(duration), 4) AS answer FROM network",
    "g04_sources": "count(DISTINCT src_ip) AS answer FROM network",
    "g05_users": "count(DISTINCT user_uid) AS answer FROM auth",
    # Groups
    "b01_top_ports": "dst_port AS answer FROM network GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 5",
    "b02_usual_outcome": "outcome AS answer FROM auth GROUP BY outcome ORDER BY count(*) DESC, outcome LIMIT 1",
    "b03_top_images": "image_name AS answer FROM process GROUP BY image_name ORDER BY count(*) DESC, image_name LIMIT 10",
    "b04_top_service": "service AS answer FROM api GROUP BY service ORDER BY count(*) DESC, service LIMIT 1",
    "b05_targets_of_host": "count(DISTINCT dst_ip) AS answer FROM network WHERE src_hostname = 'WS1'",
    # Windows of time
    "t01_logons_of_day": f"count(*) AS answer FROM auth WHERE time >= {_DAY} AND time < {_DAY} + 86400000",
    "t02_calls_of_seventy_minutes": f"count(*) AS answer FROM api WHERE time BETWEEN {_DAY} AND {_DAY} + 4200000",
    "t03_connections_of_host_in_week": f"count(*) AS answer FROM network WHERE src_hostname = 'WS1' AND time BETWEEN {_DAY} AND {_DAY} + 604800000",
    "t04_span": "max(time) - min(time) AS answer FROM network",
    # Several conditions
    "m01_small_https": "count(*) AS answer FROM network WHERE dst_port = 443 AND bytes_out < 1000",
    "m02_failed_remote": "count(*) AS answer FROM auth WHERE outcome = 'FAILURE' AND is_remote",
    "m03_roles_with_mfa": "count(*) AS answer FROM api WHERE api_operation = 'AssumeRole' AND mfa_present = true",
    "m04_powershell_of_host": "count(*) AS answer FROM process WHERE device_hostname = 'WS1' AND cmd_line LIKE '%powershell%'",
    "m05_one_edge": "count(*) AS answer FROM network WHERE src_ip = '10.1.1.1' AND dst_ip = '172.16.4.4' AND dst_port = 3389",
    # Across tables
    "j01_assets": "count(DISTINCT canonical_asset) AS answer FROM asset WHERE hostname = 'WS1' OR ip IN ('10.1.1.1', '10.2.2.2')",
    "j02_logons_of_users_on_host": "count(*) AS answer FROM auth WHERE user_uid IN (SELECT user_uid FROM session WHERE host = 'WS1')",
    "j03_processes_on_assets": "count(*) AS answer FROM process p JOIN asset s ON p.device_hostname = s.hostname",
    "j04_targets": "DISTINCT dst_ip AS answer FROM network WHERE src_hostname = 'WS1'",
    # The intrusion
    "a02_encoded_command": "cmd_line AS answer FROM process WHERE device_hostname = 'WS1' AND cmd_line LIKE '%-EncodedCommand%'",
    "a04_active_sessions": f"event_uid AS answer FROM session WHERE start_time <= {_DAY} + 43200000 AND end_time >= {_DAY} + 43200000",
    "a06_policy_without_mfa": "event_uid AS answer FROM api WHERE api_operation = 'AttachUserPolicy' AND mfa_present = false",
    "a08_first_seen_domain": "query_hostname AS answer FROM dns WHERE src_hostname = 'WS1' GROUP BY query_hostname HAVING count(*) = 1",
}

PACK = {f"question_{k}": "WITH {store} SELECT " + v for k, v in _ONE.items()}
PACK["question_a01_beacon"] = """WITH {store}, cand AS (SELECT src_ip, dst_ip, dst_port FROM network GROUP BY src_ip, dst_ip, dst_port
  HAVING count(*) >= 2 AND max(time) - min(time) BETWEEN 3000000 AND 450000000 AND avg(bytes_out + bytes_in) < 2000)
SELECT n.event_uid AS answer FROM network n JOIN cand c ON n.src_ip = c.src_ip AND n.dst_ip = c.dst_ip AND n.dst_port = c.dst_port"""

#: The scheduled load of the interference run and its interactive probe; the port is bound for each probe.
LOAD = {
    "load_enrichment": "WITH {store}, tiers AS (SELECT ip, min(canonical_asset) AS tier FROM asset GROUP BY ip) SELECT t.tier, count(*) AS conns, CAST(sum(n.bytes_out) AS BIGINT) AS bytes FROM network n JOIN tiers t ON n.src_ip = t.ip GROUP BY t.tier",
    "load_indicators": "WITH {store} SELECT count(*) AS hits, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM network WHERE dst_ip IN (SELECT dst_ip FROM soc GROUP BY dst_ip HAVING count(*) >= 30)",
    "load_port_scan": "WITH {store} SELECT src_ip, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS hosts FROM network GROUP BY src_ip HAVING count(DISTINCT dst_port) >= 5 ORDER BY ports DESC, hosts DESC, src_ip LIMIT 10",
    "load_long_duration": "WITH {store} SELECT event_uid, src_ip, dst_ip, duration FROM network WHERE duration > 60 ORDER BY duration DESC, event_uid LIMIT 10",
    "load_scan_aggregate": "WITH {store} SELECT dst_port, count(*) AS n FROM network GROUP BY dst_port",
    "load_rollup": "WITH {store} SELECT time {div} 300000 AS bucket, count(*) AS conns, CAST(sum(bytes_out) AS BIGINT) AS sent, CAST(sum(bytes_in) AS BIGINT) AS received FROM network GROUP BY time {div} 300000",
    "load_probe": "WITH {soc} SELECT count(*) AS conns, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc WHERE dst_port = 443 AND proto = 'tcp'",
}
