"""One text for both dialects: what differs stands in braces."""

from __future__ import annotations

from collections.abc import Callable

from siftlake.sources.tables import run_sql

SPARK = {
    "ms": "unix_micros(CAST(ts AS TIMESTAMP)) div 1000",
    "div": "div",
    "j": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    # The coarse store's bucket rounds half to even; a plain cast would cut.
    "half_even": "CAST(bround(time / 300000.0) AS BIGINT) * 300000",
    "sorted_ports": "array_join(array_sort(collect_set(dst_port)), ',')",
    "ordered_lines": "listagg(line, '|') WITHIN GROUP (ORDER BY line)",
    "nested": "named_struct('ip', src_ip, 'port', CAST(20000 + uid % 20 * 1000 AS INT)) AS src_endpoint, named_struct('ip', dst_ip, 'port', dst_port) AS dst_endpoint, CASE WHEN uid % 4 = 0 THEN array(named_struct('type_id', 2, 'value', src_ip), named_struct('type_id', 21, 'value', activity), named_struct('type_id', 4, 'value', proto)) ELSE array(named_struct('type_id', 2, 'value', src_ip)) END AS observables",
    "size": "size", "any21": "exists(observables, x -> x.type_id = 21)", "any2": "exists(observables, x -> x.type_id = 2)",
}
DUCK = {
    "ms": "epoch_us(ts) // 1000",
    "div": "//",
    "j": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
    "half_even": "CAST(CAST(time AS DOUBLE) / 300000 AS BIGINT) * 300000",
    "sorted_ports": "array_to_string(list_sort(list(DISTINCT dst_port)), ',')",
    "ordered_lines": "string_agg(line, '|' ORDER BY line)",
    "nested": "{'ip': src_ip, 'port': CAST(20000 + uid % 20 * 1000 AS INT)} AS src_endpoint, {'ip': dst_ip, 'port': dst_port} AS dst_endpoint, CASE WHEN uid % 4 = 0 THEN [{'type_id': 2, 'value': src_ip}, {'type_id': 21, 'value': activity}, {'type_id': 4, 'value': proto}] ELSE [{'type_id': 2, 'value': src_ip}] END AS observables",
    "size": "len", "any21": "len(list_filter(observables, lambda x: x.type_id = 21)) > 0", "any2": "len(list_filter(observables, lambda x: x.type_id = 2)) > 0",
}

#: The event table as the security operators see it: a flat network and authentication log.
SOC = """soc AS (
  SELECT event_id AS uid, ({ms}) AS time, ({ms}) {div} 1000 AS sec, CASE WHEN event_type = 'error' THEN 3002 ELSE 4001 END AS class_uid,
    event_type AS activity, user_id, concat('10.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 16 AS STRING), '.', CAST(user_id AS STRING)) AS src_ip,
    concat('172.16.', CAST(event_id % 8 AS STRING), '.', CAST(event_id % 50 AS STRING)) AS dst_ip,
    CAST(CASE event_id % 5 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 ELSE 3389 END AS INT) AS dst_port,
    CASE event_id % 3 WHEN 0 THEN 'udp' ELSE 'tcp' END AS proto, CAST(floor(value * 100) AS BIGINT) AS bytes_out, {j} AS k,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status_id, CAST(event_id % 100 AS INT) AS tenant_id
  FROM events
)"""

#: The seven tables of the event store, as analysts' questions name them.
STORE = """{soc},
auth AS (SELECT uid AS event_uid, time, user_id AS user_uid, CASE WHEN status_id = 2 THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome, dst_port = 3389 AS is_remote
  FROM soc WHERE activity IN ('error', 'signup')),
session AS (SELECT min(uid) AS event_uid, user_id AS user_uid, concat('WS', CAST(user_id AS STRING)) AS host, min(time) AS start_time, max(time) AS end_time
  FROM soc GROUP BY user_id, time {div} 86400000),
network AS (SELECT uid AS event_uid, time, concat('WS', CAST(user_id AS STRING)) AS src_hostname, src_ip, dst_ip, dst_port, bytes_out, coalesce(k, 0) AS bytes_in, bytes_out % 600 AS duration
  FROM soc WHERE activity IN ('view', 'click')),
dns AS (SELECT uid AS event_uid, time, concat('WS', CAST(user_id AS STRING)) AS src_hostname, concat('h', CAST(bytes_out % 997 AS STRING), '.example') AS query_hostname FROM soc WHERE proto = 'udp'),
process AS (SELECT uid AS event_uid, time, concat('WS', CAST(user_id AS STRING)) AS device_hostname, CASE WHEN k < 30 THEN 'powershell.exe' WHEN k < 60 THEN 'cmd.exe' ELSE 'svchost.exe' END AS image_name,
  concat(CASE WHEN k < 30 THEN 'powershell.exe' WHEN k < 60 THEN 'cmd.exe' ELSE 'svchost.exe' END, CASE WHEN k < 25 THEN ' -EncodedCommand ' ELSE ' /c ' END, CAST(bytes_out AS STRING)) AS cmd_line FROM soc WHERE activity = 'click'),
api AS (SELECT uid AS event_uid, time, user_id AS actor_user_uid, CASE WHEN k < 40 THEN 'AssumeRole' WHEN k < 80 THEN 'GetObject' ELSE 'AttachUserPolicy' END AS api_operation,
  CASE WHEN k < 40 THEN 'sts' WHEN k < 80 THEN 's3' ELSE 'iam' END AS service, bytes_out % 2 = 0 AS mfa_present FROM soc WHERE activity = 'purchase'),
asset AS (SELECT DISTINCT concat('asset-', CAST(user_id % 1000 AS STRING)) AS canonical_asset, concat('WS', CAST(user_id AS STRING)) AS hostname, src_ip AS ip FROM soc)"""


def both(text: str) -> tuple[str, str]:
    """(Spark SQL, oracle SQL) of a text."""
    text = text.replace("{store}", STORE).replace("{soc}", SOC)

    def filled(d):
        out = text
        for k, v in d.items():
            out = out.replace("{" + k + "}", v)
        return out

    return filled(SPARK), filled(DUCK)


def register_sql(queries: dict[str, Callable], oracle: dict[str, str], pack: dict[str, str]) -> None:
    for name, text in pack.items():
        spark_text, duck_text = both(text)
        queries[name] = (lambda t: lambda spark, sf_dir: run_sql(spark, sf_dir, t))(spark_text)
        oracle[name] = duck_text
