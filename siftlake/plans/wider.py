"""Further queries of operators that are more than one SQL text, with oracle SQL."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.operators import components, graph, layout, mapping, panels, safety, scoring, sigma
from siftlake.operators.components import persisted
from siftlake.sources import formats
from siftlake.sources.logtable import Conflict, LogTable
from siftlake.sources.scratch import scratch
from siftlake.sources.tables import NAMES, run_sql, scan
from siftlake.streaming import streams

from .composites import _event_files, concept_graph, duck, soc
from .dialects import both
from .questions import LOAD

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = duck(oracle)
        return f

    return add


def store(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return run_sql(spark, sf_dir, both(f"WITH {{store}} SELECT * FROM {table}")[0])


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- sources and sinks


@query("SELECT range AS i, (range * range) % 97 AS k FROM range(5, 20005)")
def source_range(spark, sf_dir):
    return spark.range(5, 20005).select(F.col("id").alias("i"), (F.col("id") * F.col("id") % 97).alias("k"))


@query("WITH {soc}, d AS (SELECT * FROM (VALUES (22, 'ssh'), (53, 'dns'), (443, 'https')) t(port, service)) SELECT d.service, count(*) AS n FROM soc s JOIN d ON s.dst_port = d.port GROUP BY d.service")
def source_arrow_table(spark, sf_dir):
    """An Arrow table of the caller's as a relation."""
    import pyarrow as pa

    services = spark.createDataFrame(pa.table({"port": pa.array([22, 53, 443], pa.int32()), "service": ["ssh", "dns", "https"]}))
    rows = soc(spark, sf_dir)
    return rows.join(services, rows.dst_port == services.port).groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {soc} SELECT dst_port, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc WHERE uid % 3 <> 0 GROUP BY dst_port")
def native_table(spark, sf_dir):
    """A bucketed, sorted table of the catalog: created from a query, emptied, filled again by insert; read by its name."""
    import uuid

    name, rows = f"native_{uuid.uuid4().hex}", soc(spark, sf_dir).select("uid", "dst_port", "bytes_out")
    try:
        rows.limit(10).write.format("parquet").bucketBy(4, "dst_port").sortBy("dst_port").option("path", scratch(spark, "native")).saveAsTable(name)
        rows.filter("uid % 3 = 1").write.insertInto(name, overwrite=True)
        rows.filter("uid % 3 = 2").write.insertInto(name)
        out = persisted(spark.table(name).groupBy("dst_port").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


@query("SELECT 'o_orderkey' AS column_name, 'INT64' AS type, count(*) AS n, 'ZSTD' AS codec FROM orders UNION ALL SELECT 'o_orderstatus', 'BYTE_ARRAY', count(*), 'ZSTD' FROM orders")
def format_footers(spark, sf_dir):
    path = scratch(spark, "footers")
    formats.write_parquet(scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, files=4)
    return formats.footers(spark, path).groupBy(F.col("column").alias("column_name"), "type", "codec").agg(F.sum("rows").alias("n"))


@query("""SELECT column_name, CAST(low AS STRING) AS low, CAST(high AS STRING) AS high, n FROM (
SELECT 'o_orderkey' AS column_name, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), count(*) FROM orders) t""")
def format_row_group_bounds(spark, sf_dir):
    path = scratch(spark, "bounds")
    formats.write_parquet(scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, sort=["o_orderkey"], files=6)
    stats = layout.row_groups(spark, path, ["o_orderkey", "o_custkey"])
    return stats.groupBy(F.col("column").alias("column_name")).agg(
        F.min(F.col("low").cast("long")).cast("string").alias("low"), F.max(F.col("high").cast("long")).cast("string").alias("high"), F.sum("rows").alias("n"),
    )


@query("""SELECT 'range' AS op, count(*) AS n FROM orders WHERE o_orderkey BETWEEN 100 AND 300 UNION ALL SELECT 'eq', count(*) FROM orders WHERE o_orderkey = 77
UNION ALL SELECT 'in', count(*) FROM orders WHERE o_orderkey IN (5, 5000, 12345) UNION ALL SELECT 'text', count(*) FROM orders WHERE o_orderpriority BETWEEN '2' AND '3'""")
def prune_loses_nothing(spark, sf_dir):
    """Matches within the row groups that footers keep, for predicates of three kinds and two types: all there are."""
    path = scratch(spark, "prune")
    formats.write_parquet(scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), path, sort=["o_orderkey"], files=8)
    stats, held = layout.row_groups(spark, path, ["o_orderkey", "o_orderpriority"]), spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    asks = [("range", "range", "o_orderkey", [100, 300], "long", "o_orderkey BETWEEN 100 AND 300"), ("eq", "eq", "o_orderkey", [77], "long", "o_orderkey = 77"),
            ("in", "in", "o_orderkey", [5, 5000, 12345], "long", "o_orderkey IN (5, 5000, 12345)"), ("text", "range", "o_orderpriority", ["2", "3"], "string", "o_orderpriority BETWEEN '2' AND '3'")]
    parts = []
    for name, op, column, values, kind, where in asks:
        kept = stats.filter(F.col("column") == column).filter(layout.may_match(F.col("low"), F.col("high"), op, values, kind)).select("file").distinct()
        parts.append(held.filter(where).join(kept, "file", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n"))
    return united(parts)


@query("""SELECT e.encoding, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(length(o_orderstatus)) AS BIGINT) AS chars, true AS asked
FROM orders, (VALUES ('PLAIN'), ('DICTIONARY'), ('DELTA')) e(encoding) GROUP BY e.encoding""")
def format_encodings(spark, sf_dir):
    """Files whose writer was told the encodings, read by Spark: every reader has to see the same rows."""
    rows, parts = scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), []
    wanted = {"PLAIN": {"o_orderkey": "PLAIN", "o_orderstatus": "PLAIN"}, "DICTIONARY": {"o_orderkey": "RLE_DICTIONARY", "o_orderstatus": "RLE_DICTIONARY"},
              "DELTA": {"o_orderkey": "DELTA_BINARY_PACKED", "o_orderstatus": "DELTA_LENGTH_BYTE_ARRAY"}}
    for name, encodings in wanted.items():
        path = scratch(spark, "encoded")
        formats.write_encoded(rows.repartition(3), path, encodings).write.format("noop").mode("overwrite").save()
        has = formats.footers(spark, path).agg(F.bool_and(F.array_contains("encodings", encodings["o_orderkey"]) | (F.col("column") != "o_orderkey")).alias("asked"))
        back = spark.read.schema(rows.schema).parquet(path)
        parts.append(back.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum(F.length("o_orderstatus")).alias("chars")).crossJoin(has).withColumn("encoding", F.lit(name)))  # one row each
    return united(parts)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def format_verified_pages(spark, sf_dir):
    path, rows = scratch(spark, "checked"), scan(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    formats.write_parquet(rows, path, checksums=True)
    return formats.read_verified(spark, path, rows.schema)


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, true AS same FROM customer")
def format_stable_bytes(spark, sf_dir):
    """Two ordered copies of differently dealt rows: the files are the same bytes."""
    rows = scan(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    a, b = scratch(spark, "ordered"), scratch(spark, "ordered")
    formats.ordered_copy(rows.repartition(5), a)
    formats.ordered_copy(rows.orderBy(F.desc("c_acctbal")).repartition(2), b)
    same = formats.same_bytes(spark, a, b)
    return spark.read.parquet(a).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys")).withColumn("same", F.lit(same))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 9")
def format_orc(spark, sf_dir):
    """The other columnar format: written, then read with the filter pushed down."""
    path = scratch(spark, "orc")
    scan(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.option("compression", "zstd").orc(path)
    return spark.read.schema("p_partkey long, p_name string, p_size int").orc(path).filter("p_size BETWEEN 5 AND 9").select("p_partkey", "p_name", F.col("p_size"))


@query("SELECT n_nationkey, n_name, true AS same FROM nation")
def transport_arrow(spark, sf_dir):
    """A bounded result (a row per nation) by Arrow and row by row: the same values; the Arrow table is a relation again."""
    rows = scan(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    table = rows.toArrow()
    same = table.to_pylist() == [r.asDict() for r in rows.collect()]
    return spark.createDataFrame(table).withColumn("same", F.lit(same))


@query("""SELECT t AS table_name, c AS column_name, k AS type FROM (VALUES ('nation', 'n_nationkey', 'bigint'), ('nation', 'n_name', 'string'), ('nation', 'n_regionkey', 'bigint'),
('region', 'r_regionkey', 'bigint'), ('region', 'r_name', 'string')) v(t, c, k)""")
def schema_catalog(spark, sf_dir):
    """What tables have, as rows and (schema_text) as text for a reader; taken from schemas, no data is read."""
    fields = [(t, f.name, f.dataType.simpleString()) for t in ("nation", "region") for f in scan(spark, sf_dir, t).schema if not f.name.endswith("comment")]
    names = spark.createDataFrame(fields, "table_name string, column_name string, type string")
    return names.withColumn("type", F.when(F.col("type") == "int", "bigint").otherwise(F.col("type")))  # whole numbers are one kind


def schema_text(spark: SparkSession, sf_dir: str) -> str:
    """A line per table: name(column type, ...)."""
    return "\n".join(f"{t}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in scan(spark, sf_dir, t).schema)})" for t in NAMES)


# -- filters, functions


@query("WITH {soc} SELECT dst_port, count(*) AS n FROM soc WHERE dst_port = 443 AND activity LIKE '%ur%' AND bytes_out >= 1000 GROUP BY dst_port")
def filter_bound_parameters(spark, sf_dir):
    text = both("WITH {soc} SELECT dst_port, count(*) AS n FROM soc WHERE dst_port = :port AND contains(activity, :part) AND bytes_out >= :least GROUP BY dst_port")[0]
    return run_sql(spark, sf_dir, text, {"port": 443, "part": "ur", "least": 1000})


@query("SELECT n_name, n_regionkey FROM nation ORDER BY n_name LIMIT 20")
def safe_question(spark, sf_dir):
    scan(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return safety.safe_sql(spark, "SELECT n_name, n_regionkey FROM nation ORDER BY n_name")


@query("""WITH {soc} SELECT uid, [80, 443, 53, 22][1 + uid % 4] AS port, epoch_us(epoch_ms(time) + INTERVAL 90 MINUTE) AS later_us, sha256(activity) AS sha, 1 + (uid % 4) AS at FROM soc""")
def fn_lists_and_times(spark, sf_dir):
    rows = soc(spark, sf_dir)
    at = (F.lit(1) + F.col("uid") % 4).cast("int")
    return rows.select(
        "uid", F.element_at(F.array(*[F.lit(p) for p in (80, 443, 53, 22)]), at).alias("port"),
        F.unix_micros(F.timestamp_millis("time") + F.expr("INTERVAL 90 MINUTES")).alias("later_us"), F.sha2("activity", 256).alias("sha"), at.cast("long").alias("at"),
    )


@query("WITH {soc} SELECT uid, CASE WHEN uid % 6 = 5 THEN NULL WHEN uid % 6 IN (0, 4) THEN time - time % 1000 ELSE time END AS parsed FROM soc")
def fn_parse_times(spark, sf_dir):
    """Texts of six kinds: plain, with a fraction, ISO with Z, ISO with an offset, without zone, and none at all."""
    rows = soc(spark, sf_dir)
    at = F.timestamp_millis("time")
    kinds = [
        F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")),
        F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00")), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("not a time"),
    ]
    text = F.element_at(F.array(*kinds), (F.col("uid") % 6 + 1).cast("int"))
    return rows.select("uid", text.alias("text")).select("uid", F.unix_millis(parsed_time(F.col("text"))).alias("parsed"))


def parsed_time(text):
    """A time from a text with or without fraction, "T", "Z" or offset; texts that are none give null, without a zone they are UTC."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in (
        "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
    )])


@query("SELECT p_partkey, p_name AS back, length(p_name) * 2 AS bytes, upper(string_agg(hex(c) || '00', '' ORDER BY i)) AS utf16 FROM (SELECT p_partkey, p_name, i, substr(p_name, i, 1) AS c FROM part, generate_series(1, 64) g(i) WHERE i <= length(p_name)) t GROUP BY p_partkey, p_name")
def fn_utf16_base64(spark, sf_dir):
    """Names as the base64 of UTF-16LE, as encoded commands are, and back."""
    encoded = F.base64(F.encode("p_name", "UTF-16LE"))
    rows = scan(spark, sf_dir, "part").select("p_partkey", encoded.alias("b"))
    raw = F.unbase64("b")
    return rows.select("p_partkey", F.decode(raw, "UTF-16LE").alias("back"), F.octet_length(raw).cast("long").alias("bytes"), F.hex(raw).alias("utf16"))


@query("SELECT count(*) AS n, count(*) AS same_bits, count(DISTINCT o_totalprice) AS kinds FROM orders")
def fn_float_bits(spark, sf_dir):
    """Doubles survive a file bit by bit: their patterns as longs, before and after."""
    rows, path = scan(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v")), scratch(spark, "floats")
    rows.write.parquet(path)
    back = float_bits(spark.read.schema(rows.schema).parquet(path), "v", "after")
    both_ = float_bits(rows, "v", "before").select("o_orderkey", "before").join(back.select("o_orderkey", "after"), "o_orderkey")
    return both_.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") == F.col("after")).alias("same_bits"), F.count_distinct("after").alias("kinds"))


def float_bits(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the bit pattern of a double column as a long; Arrow batches are viewed, not converted."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(column))
            bits = pa.array(col.to_numpy(zero_copy_only=False).view("int64"), mask=col.is_null().to_numpy(zero_copy_only=False)) if len(col) else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, bits], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, g.i AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) * g.i AS v FROM events, generate_series(1, 3) g(i)")
def variant_projection(spark, sf_dir):
    """A JSON column parsed once to a variant, projected under fan-out: each copy reads fields, none parses again."""
    rows = scan(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    wide = rows.select("event_id", "v", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    k = F.try_variant_get("v", "$.k", "bigint")
    return wide.select("event_id", k.alias("k"), F.col("i").cast("long").alias("i"), (k * F.col("i")).alias("v"))


# -- aggregates and windows


@query("WITH {soc} SELECT activity, true AS near_enough FROM soc GROUP BY activity")
def agg_approximate_distinct(spark, sf_dir):
    """Sketches of distinct counts: within 5 % of the exact ones."""
    out = soc(spark, sf_dir).groupBy("activity").agg(F.approx_count_distinct("src_ip", 0.02).alias("about"), F.count_distinct("src_ip").alias("exact"))
    return out.select("activity", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("near_enough"))


@query("WITH {soc}, r AS (SELECT dst_port, activity, row_number() OVER (PARTITION BY dst_port ORDER BY count(*) DESC, activity) AS r FROM soc GROUP BY dst_port, activity) SELECT dst_port, activity AS usual FROM r WHERE r = 1")
def agg_mode(spark, sf_dir):
    """The commonest value by group, the least of several: counts combine before they are ranked."""
    counts = soc(spark, sf_dir).groupBy("dst_port", "activity").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("dst_port").agg(F.min(F.struct((-F.col("n")).alias("n"), "activity")).alias("b"))
    return best.select("dst_port", F.col("b.activity").alias("usual"))


@query("""WITH {soc}, b AS (SELECT dst_port, count(bytes_out) AS n, avg(bytes_out) AS mean, stddev_samp(bytes_out) AS sd, min(bytes_out) AS least, max(bytes_out) AS most FROM soc GROUP BY dst_port)
SELECT dst_port, n, round(mean, 3) AS mean, round(sd / sqrt(n), 4) AS se, round(mean - 1.96 * sd / sqrt(n), 3) AS low, round(mean + 1.96 * sd / sqrt(n), 3) AS high, least, most FROM b""")
def agg_intervals(spark, sf_dir):
    got = scoring.bands(soc(spark, sf_dir), ["dst_port"], "bytes_out")
    return got.select("dst_port", "n", F.round("mean", 3).alias("mean"), F.round("se", 4).alias("se"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "least", "most")


@query("""WITH {soc}, h AS (SELECT tenant_id, CAST(('0x' || substr(md5(concat(CAST(uid AS STRING), '|', src_ip, '|', CAST(bytes_out AS STRING))), 1, 8)) AS BIGINT) AS h FROM soc)
SELECT tenant_id, count(*) AS n, CAST(sum(h % 2147483647) AS BIGINT) AS digest FROM h GROUP BY tenant_id""")
def agg_modular_digest(spark, sf_dir):
    """An order-independent digest that other engines can compute as well: a modular sum of parts of MD5."""
    line = F.concat_ws("|", F.col("uid").cast("string"), "src_ip", F.col("bytes_out").cast("string"))
    h = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    return soc(spark, sf_dir).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum(h % 2147483647).alias("digest"))


# -- joins


@query("WITH {soc} SELECT count(*) AS pairs, count(DISTINCT a.src_ip) AS hosts FROM soc a JOIN soc b ON a.src_ip = b.src_ip AND a.sec {div} 300 = b.sec {div} 300 WHERE a.activity = 'click' AND b.activity = 'purchase'")
def join_large_large(spark, sf_dir):
    """Pairs of two large sides that share a host and five minutes: counted by key on either side, so none is formed."""
    rows = soc(spark, sf_dir).withColumn("bucket", F.expr("sec div 300"))
    per_key = rows.groupBy("src_ip", "bucket").agg(F.count_if(F.col("activity") == "click").alias("a"), F.count_if(F.col("activity") == "purchase").alias("b"))
    met = per_key.filter("a > 0 AND b > 0")
    return met.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("pairs"), F.count_distinct("src_ip").alias("hosts"))


@query("WITH {soc}, alerts AS (SELECT uid, src_ip, time FROM soc WHERE activity = 'error') SELECT a.uid AS alert, n.uid AS flow, n.time - a.time AS lag_ms FROM alerts a JOIN soc n ON n.src_ip = a.src_ip AND n.time BETWEEN a.time AND a.time + 300000 WHERE n.uid <> a.uid")
def join_temporal_range(spark, sf_dir):
    """Flows of a host within five minutes after an alert: the join's key has the five minutes of the flow, an alert
    goes to its own and the next, so a busy host is many keys and no pair is looked at that is further apart."""
    rows = soc(spark, sf_dir).select("uid", "src_ip", "time", "activity").withColumn("bucket", F.expr("time div 300000"))
    alerts = rows.filter("activity = 'error'").select(
        F.col("uid").alias("alert"), "src_ip", F.col("time").alias("alert_time"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket")
    )
    near = alerts.join(rows, ["src_ip", "bucket"]).filter("time BETWEEN alert_time AND alert_time + 300000 AND uid <> alert")
    return near.select("alert", F.col("uid").alias("flow"), (F.col("time") - F.col("alert_time")).alias("lag_ms"))


@query("WITH {soc}, labels AS (SELECT DISTINCT src_ip FROM soc), ids AS (SELECT src_ip, CAST(dense_rank() OVER (ORDER BY src_ip) AS INT) AS id FROM labels) SELECT s.uid, i.id FROM soc s JOIN ids i ON s.src_ip = i.src_ip")
def window_dense_ids(spark, sf_dir):
    """Dense ids in the order of labels: labels are dealt by ranges, ranked within, and shifted by the sizes of the
    ranges before, so no task ranks them all."""
    rows = soc(spark, sf_dir)
    placed = persisted(rows.select("src_ip").distinct().repartitionByRange("src_ip").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("src_ip"))).join(base, "part")
    return rows.join(ranked.select("src_ip", (F.col("base") + F.col("r")).cast("int").alias("id")), "src_ip").select("uid", "id")


@query("""WITH {store}, e AS (SELECT user_uid AS user_id, time {div} 1000 AS sec, 'auth' AS source FROM auth WHERE outcome = 'FAILURE' UNION ALL SELECT actor_user_uid, time {div} 1000, 'api' FROM api WHERE mfa_present = false),
c AS (SELECT a.user_id, a.sec, count(DISTINCT b.source) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.sec BETWEEN a.sec - 86400 AND a.sec GROUP BY a.user_id, a.sec)
SELECT user_id, min(sec) AS at FROM c WHERE n = 2 GROUP BY user_id""")
def correlation_across_sources(spark, sf_dir):
    """Two sources united into one log, then correlated."""
    failed = store(spark, sf_dir, "auth").filter("outcome = 'FAILURE'").select(F.col("user_uid").alias("user_id"), F.expr("time div 1000").alias("time_s"), F.lit("auth").alias("rule"))
    bare = store(spark, sf_dir, "api").filter("mfa_present = false").select(F.col("actor_user_uid").alias("user_id"), F.expr("time div 1000").alias("time_s"), F.lit("api").alias("rule"))
    return sigma.correlate(failed.unionByName(bare), {"type": "temporal", "rules": ["auth", "api"], "group-by": ["user_id"], "timespan": "1d"})


# -- log table


@query("SELECT 'kept' AS what, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'after_overwrite', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'F'")
def logtable_adopted_files(spark, sf_dir):
    """Files that exist already become a version as they are; the table is then overwritten; both versions are read."""
    rows, path = scan(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), scratch(spark, "foreign")
    rows.repartition(4).write.parquet(path)
    table = LogTable(spark, scratch(spark, "adopting"))
    first = table.add_files(spark.read.parquet(path).inputFiles())
    table.overwrite(rows.filter("o_orderstatus = 'F'"))
    total = lambda df, what: df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(what).alias("what"), "n", "keys")
    return total(table.read(first), "kept").unionByName(total(table.read(), "after_overwrite"))


@query("SELECT count(*) AS n, 8 AS files, true AS pruned, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN 100 AND 300) AS found FROM orders")
def logtable_plan_files(spark, sf_dir):
    """The files that a scan for a range has to read: fewer than all, and all matches are in them."""
    table = LogTable(spark, scratch(spark, "planned"))
    table.append(scan(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange(8, "o_orderkey"))
    plan = persisted(table.plan_files("o_orderkey", 100, 300, "long"))
    held = table.read().withColumn("file", F.col("_metadata.file_path")).filter("o_orderkey BETWEEN 100 AND 300")
    name = F.substring_index("file", "/", -1)
    found = held.select(name.alias("file")).join(plan.filter("scanned").select(name.alias("file")), "file", "left_semi").agg(F.count(F.lit(1)).alias("found"))
    out = plan.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).cast("int").alias("files"), (F.count_if("scanned") < F.count(F.lit(1))).alias("pruned"))
    return out.crossJoin(found)  # one row each


@query("SELECT * FROM (VALUES (0, 0, 10), (1, 0, 20), (2, 0, 30), (3, 1, 40), (4, 1, 50), (5, 1, 60)) t(version, files, rows)")
def logtable_inlining(spark, sf_dir):
    """Small appends lie in the log and make no file, until there are more of them than the table may inline."""
    table, out = LogTable(spark, scratch(spark, "inlined"), inline_rows=10, inline_total=30), []
    for k in range(6):
        version = table.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
        out.append((version, len(table.snapshot().files), table.read().count()))
    return spark.createDataFrame(out, "version int, files int, rows int")


@query("SELECT 8 AS writers, 40 AS versions, 400 AS rows, 400 AS distinct_rows, 0 AS errors")
def logtable_concurrent_writers(spark, sf_dir):
    """Eight writers append at once: every commit lands, none is lost or doubled."""
    table, errors, base = LogTable(spark, scratch(spark, "contended"), inline_rows=10, retries=200), [], None

    def write(w: int) -> None:
        for k in range(5):
            try:
                table.append(spark.range(50 * w + 10 * k, 50 * w + 10 * k + 10))
            except Exception as e:  # an error is a result of the run
                errors.append(str(e))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = table.read()
    got = (8, len(table.versions()), rows.count(), rows.distinct().count(), len(errors))
    return spark.createDataFrame([got], "writers int, versions int, rows int, distinct_rows int, errors int")


@query("SELECT * FROM (VALUES ('first_wins', true, 10), ('second_wins', true, 12)) t(commit_order, conflict, rows)")
def logtable_delete_conflict(spark, sf_dir):
    """Two deletes that read the same version and touch the same file: whichever commits later conflicts, and no row comes back."""
    out = []
    asks = {"a": F.col("id") < 10, "b": F.col("id") >= 12}
    for name, order in (("first_wins", "ab"), ("second_wins", "ba")):
        table = LogTable(spark, scratch(spark, "deleted"))
        table.append(spark.range(20).coalesce(1))
        seen, conflict = table.snapshot(), False
        for which in order:
            try:
                table.delete(asks[which], at=seen)
            except Conflict:
                conflict = True
        out.append((name, conflict, table.read().count()))
    return spark.createDataFrame(out, "commit_order string, conflict boolean, rows int")


@query("SELECT * FROM (VALUES (1, 1, true), (10, 10, true), (25, 25, true), (40, 40, true)) t(appends, files, bounded)")
def logtable_metadata_growth(spark, sf_dir):
    """What planning has to look at as appends add up: files grow with them, log entries to replay do not, thanks to checkpoints."""
    table, out = LogTable(spark, scratch(spark, "growing"), checkpoint_every=10), []
    for k in range(1, 41):
        table.append(spark.range(k, k + 1).coalesce(1))
        if k in (1, 10, 25, 40):
            bases = table._names(".base")
            replayed = sum(v > bases[-1] for v in table.versions()) if bases else len(table.versions())
            out.append((k, len(table.snapshot().files), replayed <= 10))
    return spark.createDataFrame(out, "appends int, files int, bounded boolean")


_COMPACTION = {
    "count_all": "SELECT 'all' AS k, count(*) AS n FROM t",
    "protocols": "SELECT proto AS k, count(*) AS n FROM t GROUP BY proto",
    "long": "SELECT * FROM (SELECT CAST(uid AS STRING) AS k, bytes_out AS n FROM t WHERE bytes_out > 60 ORDER BY bytes_out DESC, uid LIMIT 10) x",
    "bytes_by_source": "SELECT * FROM (SELECT src_ip AS k, CAST(sum(coalesce(bytes_out, 0) + coalesce(k, 0)) AS BIGINT) AS n FROM t GROUP BY src_ip ORDER BY n DESC, k LIMIT 10) x",
    "time_range": "SELECT 'range' AS k, count(*) AS n FROM t WHERE time >= 1705276800000 AND time < 1705363200000",
    "port_scan": "SELECT * FROM (SELECT src_ip AS k, count(DISTINCT dst_port) AS n FROM t WHERE proto = 'tcp' GROUP BY src_ip ORDER BY n DESC, k LIMIT 5) x",
}


@query("WITH {soc}, t AS (SELECT * FROM soc) " + " UNION ALL ".join(f"SELECT '{n}' AS question, k, n, true AS same FROM ({q}) q_{n}" for n, q in _COMPACTION.items()))
def compaction_battery(spark, sf_dir):
    """Six questions before and after a table of many small files is compacted and sorted by time: the same answers."""
    rows = soc(spark, sf_dir)
    table = LogTable(spark, scratch(spark, "fragmented"))
    for k in range(4):
        table.append(rows.filter(F.col("uid") % 4 == k).repartition(10))
    before = table.snapshot().version
    table.compact(4, ["time"])
    parts = []
    for name, text in _COMPACTION.items():
        sides = []
        for version in (before, None):
            table.read(version).createOrReplaceTempView("t")
            sides.append(persisted(spark.sql(text)))
        a, b = sides
        differ = a.exceptAll(b).count() + b.exceptAll(a).count()  # at most ten rows a side
        parts.append(b.select(F.lit(name).alias("question"), "k", "n").withColumn("same", F.lit(differ == 0)))
    return united(parts)


# -- streams


@query("SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS visible, true AS coherent FROM (SELECT b.batch, count(*) AS n FROM (SELECT ntile(4) OVER (ORDER BY event_id) - 1 AS batch FROM events) b GROUP BY b.batch) t")
def stream_commit_log(spark, sf_dir):
    """What readers see while a stream commits: after each batch all rows so far, and latencies with their ranks in order."""
    path = scratch(spark, "four-files")
    numbered = scan(spark, sf_dir, "events").select("event_id", (F.ntile(4).over(Window.orderBy("event_id")) - 1).alias("b"))
    for k in range(4):
        numbered.filter(F.col("b") == k).select("event_id").coalesce(1).write.mode("append").parquet(path)
    table = LogTable(spark, scratch(spark, "watched"))
    done = streams.commits(streams.file_stream(spark, path, spark.read.parquet(path).schema), scratch(spark, "ckpt"), table, "events")
    log = spark.createDataFrame([(d["batch"], d["visible"], d["seconds"]) for d in done], "batch long, visible long, seconds double")
    ranks = log.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY seconds)").alias(f"p{k}") for k, p in ((50, 0.5), (95, 0.95), (99, 0.99))])
    return log.crossJoin(ranks).select("batch", "visible", ((F.col("p50") > 0) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99"))).alias("coherent"))  # one row of ranks


@query("""SELECT * FROM (VALUES ('patient', 10, 1), ('patient', 12, 2), ('patient', 70, 2), ('hasty', 10, 1), ('hasty', 12, 1), ('hasty', 70, 2)) t(watermark, minute, n)""")
def stream_late_events(spark, sf_dir):
    """An event that comes an hour late lands in the window of its own time; under a short watermark it is dropped."""
    path, out = scratch(spark, "late"), []
    base = 1_700_000_000 - 1_700_000_000 % 3600
    for at in ([10.0, 12.0], [70.0], [70.5], [12.5]):  # minutes; the last file is late
        rows = spark.createDataFrame([(a,) for a in at], "m double")
        rows.select(F.timestamp_seconds(F.lit(base) + F.col("m") * 60).alias("ts"), F.lit("e").alias("kind")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    for name, late in (("patient", "2 hours"), ("hasty", "1 minute")):
        windows = scratch(spark, "late-windows")
        stream = streams.tumbling(streams.file_stream(spark, path, schema), "ts", ["kind"], "1 minute", late)
        streams.each_batch(stream, scratch(spark, "ckpt"), lambda df, i, to=windows: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(to), mode="update")
        got = spark.read.schema("start timestamp, end timestamp, kind string, n long, batch long").parquet(windows)
        last = got.groupBy("start").agg(F.max_by("n", "batch").alias("n"))
        minute = ((F.unix_seconds("start") - base) / 60).cast("int")
        out.append(last.select(F.lit(name).alias("watermark"), minute.alias("minute"), F.col("n").cast("int").alias("n")))
    return united(out)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark, sf_dir):
    """The first of each kind by user, whatever the batch it comes in, with state that goes when the time is up."""
    path, schema = _event_files(spark, sf_dir)
    out = scratch(spark, "firsts")
    stream = streams.deduplicated(streams.file_stream(spark, path, schema), "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    streams.drain(stream, out, scratch(spark, "ckpt"))
    return spark.read.schema("user_id long, event_type string").parquet(out)


# -- materialised views


@query(" UNION ALL ".join([
    "WITH {store}, tiers AS (SELECT ip, min(canonical_asset) AS tier FROM asset GROUP BY ip) SELECT 'mv_enrichment' AS mv, t.tier AS k, count(*) AS a, CAST(sum(n.bytes_out) AS BIGINT) AS b FROM network n JOIN tiers t ON n.src_ip = t.ip GROUP BY t.tier",
    "SELECT 'mv_indicators', 'all', count(*), CAST(sum(bytes_out) AS BIGINT) FROM network WHERE dst_ip IN (SELECT dst_ip FROM soc GROUP BY dst_ip HAVING count(*) >= 30)",
    "SELECT * FROM (SELECT 'mv_port_scan', src_ip, count(DISTINCT dst_port) AS p, count(DISTINCT dst_ip) AS h FROM network GROUP BY src_ip HAVING count(DISTINCT dst_port) >= 5 ORDER BY p DESC, h DESC, src_ip LIMIT 10) x",
    "SELECT * FROM (SELECT 'mv_long_duration', src_ip, event_uid, duration FROM network WHERE duration > 60 ORDER BY duration DESC, event_uid LIMIT 10) y",
    "SELECT 'mv_scan_aggregate', CAST(dst_port AS STRING), count(*), CAST(0 AS BIGINT) FROM network GROUP BY dst_port",
    "SELECT 'mv_rollup', CAST(time {div} 300000 AS STRING), count(*), CAST(sum(bytes_out) AS BIGINT) FROM network GROUP BY time {div} 300000",
]))
def mv_pack(spark, sf_dir):
    """The six views of the scheduled load, kept as tables, and the load's questions answered from them alone."""
    net, asset = persisted(store(spark, sf_dir, "network")), store(spark, sf_dir, "asset")
    tiers = asset.groupBy("ip").agg(F.min("canonical_asset").alias("tier"))
    known = soc(spark, sf_dir).groupBy("dst_ip").agg(F.count(F.lit(1)).alias("n")).filter("n >= 30").select("dst_ip")
    n = F.count(F.lit(1)).alias("a")
    total = F.sum("bytes_out").cast("long").alias("b")
    views = {
        "mv_enrichment": net.join(tiers, net.src_ip == tiers.ip).groupBy("tier").agg(n, total),
        "mv_indicators": net.join(known, "dst_ip", "left_semi").agg(n, total),
        "mv_port_scan": net.groupBy("src_ip").agg(F.count_distinct("dst_port").alias("ports"), F.count_distinct("dst_ip").alias("hosts")),
        "mv_long_duration": net.filter("duration > 60").select("src_ip", "event_uid", "duration"),
        "mv_scan_aggregate": net.groupBy("dst_port").agg(n),
        "mv_rollup": net.groupBy(F.expr("time div 300000").alias("bucket")).agg(n, total),
    }
    kept = {}
    for name, df in views.items():
        path = scratch(spark, name)
        df.write.parquet(path)
        kept[name] = spark.read.schema(df.schema).parquet(path)
    scans = kept["mv_port_scan"].filter("ports >= 5").orderBy(F.desc("ports"), F.desc("hosts"), "src_ip").limit(10)
    longest = kept["mv_long_duration"].orderBy(F.desc("duration"), "event_uid").limit(10)
    row = lambda df, name, k, a, b: df.select(F.lit(name).alias("mv"), k.cast("string").alias("k"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    return united([
        row(kept["mv_enrichment"], "mv_enrichment", F.col("tier"), F.col("a"), F.col("b")), row(kept["mv_indicators"], "mv_indicators", F.lit("all"), F.col("a"), F.col("b")),
        row(scans, "mv_port_scan", F.col("src_ip"), F.col("ports"), F.col("hosts")), row(longest, "mv_long_duration", F.col("src_ip"), F.col("event_uid"), F.col("duration")),
        row(kept["mv_scan_aggregate"], "mv_scan_aggregate", F.col("dst_port"), F.col("a"), F.lit(0)), row(kept["mv_rollup"], "mv_rollup", F.col("bucket"), F.col("a"), F.col("b")),
    ])


@query("""WITH {soc}, s AS (SELECT k.base, s.user_id, s.bytes_out FROM soc s, (VALUES (2), (5), (10)) k(base) WHERE s.uid % 10 < k.base)
SELECT base, 'rollup' AS panel, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes, true AS same FROM s GROUP BY base UNION ALL SELECT base, 'by_user', count(*), CAST(sum(bytes_out) AS BIGINT), true FROM s GROUP BY base""")
def mv_crossover(spark, sf_dir):
    """Incremental against recomputed panels over bases of growing size: the same rows either way. Which is faster is
    for the bench: crossover() gives the seconds."""
    return crossover(spark, soc(spark, sf_dir), (2, 5, 10)).select("base", "panel", "n", "bytes", "same")


def crossover(spark: SparkSession, rows: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """(base: tenths of the rows, panel, n, bytes, same, incremental_s, recompute_s): a panel of a base, then one more
    tenth arrives and is merged into it, against the panel of all of it anew. A panel of few keys and one of many."""
    import time

    kinds = {"rollup": ["class_uid", "activity"], "by_user": ["user_id"]}
    agg = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes"))
    out = []
    for base in bases:
        for panel, keys in kinds.items():
            held = persisted(agg(rows.filter(F.col("uid") % 10 < base - 1), keys))
            began = time.perf_counter()
            arrived = agg(rows.filter(F.col("uid") % 10 == base - 1), keys)
            merged = persisted(held.unionByName(arrived).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
            middle = time.perf_counter()
            anew = persisted(agg(rows.filter(F.col("uid") % 10 < base), keys))
            end = time.perf_counter()
            same = merged.exceptAll(anew).isEmpty() and anew.exceptAll(merged).isEmpty()
            n, total = merged.agg(F.sum("n"), F.sum("bytes")).first()
            out.append((base, panel, n, total, same, middle - began, end - middle))
    return spark.createDataFrame(out, "base int, panel string, n long, bytes long, same boolean, incremental_s double, recompute_s double")


@query("WITH {soc} SELECT time {div} 300000 AS bucket, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM soc GROUP BY time {div} 300000")
def mv_time_series(spark, sf_dir):
    """The time series as a panel that batches maintain."""
    rows, held = soc(spark, sf_dir), panels.Panels()
    panel = panels.Panel((("bucket", "time div 300000"),), (("n", "count", "1"), ("bytes", "sum", "bytes_out")))
    held.declare(panel)
    for k in range(3):
        held.apply(rows.filter(F.col("uid") % 3 == k))
    return held.answer(panel, rows)[0]


@query("WITH {soc} SELECT user_id, count(*) AS n FROM soc WHERE status_id = 2 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 50")
def mv_failed_users(spark, sf_dir):
    """The ranking of failures from a panel: partial counts of batches, merged, then ranked."""
    rows, held = soc(spark, sf_dir).filter("status_id = 2"), panels.Panels()
    panel = panels.Panel((("user_id", "user_id"),), (("n", "count", "1"),))
    held.declare(panel)
    for k in range(3):
        held.apply(rows.filter(F.col("uid") % 3 == k))
    return held.answer(panel, rows)[0].orderBy(F.desc("n"), "user_id").limit(50)


# -- rules and sweeps

_RULES = {
    "encoded": {"detection": {"s": {"cmd_line|contains": "-EncodedCommand"}, "condition": "s"}},
    "payload": {"detection": {"s": {"cmd_line|endswith": "00"}, "condition": "s"}},
    "shells": {"detection": {"s": {"image_name": ["cmd.exe", "powershell.exe"]}, "condition": "s"}},
    "not_service": {"detection": {"s": {"image_name|endswith": ".exe"}, "f": {"cmd_line|contains": "svchost.exe /c 5"}, "condition": "s and not f"}},
}
_TAGS = {"encoded": ["attack.execution", "attack.t1059.001"], "payload": ["attack.t1027"], "shells": ["attack.T1059", "attack.t1059.003"], "not_service": ["attack.persistence"]}


@query("""WITH {store}, c AS (SELECT image_name, left(cmd_line, 16) AS cmd_line FROM process),
m AS (SELECT 'encoded' AS rule, 'adversary' AS grp, (SELECT count(*) FROM process WHERE cmd_line ILIKE '%-EncodedCommand%') AS n, (SELECT count(*) FROM c WHERE cmd_line ILIKE '%-EncodedCommand%') AS m
 UNION ALL SELECT 'payload', 'adversary', (SELECT count(*) FROM process WHERE cmd_line LIKE '%00'), (SELECT count(*) FROM c WHERE cmd_line LIKE '%00')
 UNION ALL SELECT 'shells', 'adversary', (SELECT count(*) FROM process WHERE image_name IN ('cmd.exe', 'powershell.exe')), (SELECT count(*) FROM c WHERE image_name IN ('cmd.exe', 'powershell.exe'))
 UNION ALL SELECT 'not_service', 'routine', (SELECT count(*) FROM process WHERE image_name LIKE '%.exe' AND NOT cmd_line LIKE '%svchost.exe /c 5%'), (SELECT count(*) FROM c WHERE image_name LIKE '%.exe' AND NOT cmd_line LIKE '%svchost.exe /c 5%'))
SELECT grp, count(*) AS fired, round(avg(greatest(0, 1 - CAST(m AS DOUBLE) / n)), 6) AS mean_loss, count(*) FILTER (WHERE m = 0) AS blind, count(*) FILTER (WHERE m > n) AS over_matched,
  round(avg(1 - CAST(m AS DOUBLE) / n), 6) AS mean_signed FROM m WHERE n > 0 GROUP BY grp""")
def sigma_recall_loss(spark, sf_dir):
    """What a batch of rules loses on a store that cuts command lines, rules of the adversary's techniques apart."""
    full = store(spark, sf_dir, "process")
    coarse = mapping.Coarse((("cmd_line", 16),)).apply(full)
    groups = {r: "adversary" if any("t1059" in t.lower() or "t1027" in t for t in tags) else "routine" for r, tags in _TAGS.items()}
    got = sigma.recall_loss(full, coarse, _RULES, groups)
    return got.withColumn("mean_loss", F.round("mean_loss", 6)).withColumn("mean_signed", F.round("mean_signed", 6))


@query("SELECT * FROM (VALUES ('encoded', 't1059'), ('payload', 't1027'), ('shells', 't1059'), ('not_service', '')) t(rule, techniques)")
def sigma_techniques(spark, sf_dir):
    rules = spark.createDataFrame(list(_TAGS.items()), "rule string, tags array<string>")
    return rules.select("rule", F.array_join(sigma.techniques(F.col("tags")), ",").alias("techniques"))


@query("SELECT * FROM (VALUES ('window', true, true, true, true), ('buckets', true, true, false, true), ('plain', false, false, false, false)) t(text, aggregation, time_window, threshold, distinct_field)")
def correlation_fidelity(spark, sf_dir):
    """Which parts of a correlation compiled texts still have."""
    rule = {"type": "value_count", "group-by": ["user"], "timespan": "1h", "condition": {"gte": 7, "field": "dst.ip"}}
    texts = {
        "window": "SELECT user FROM (SELECT user, count(DISTINCT ip) OVER (PARTITION BY user ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM logs) WHERE n >= 7",
        "buckets": "source=logs | bin span=1h _time | stats dc(ip) AS n BY user | where n > 70",
        "plain": "SELECT * FROM logs WHERE user = 'x'",
    }
    parts = ("aggregation", "time_window", "threshold", "distinct_field")
    rows = [(n, *[scoring.correlation_structure(t, rule).get(p, False) for p in parts]) for n, t in texts.items()]
    return spark.createDataFrame(rows, "text string, " + ", ".join(f"{p} boolean" for p in parts))


@query("""WITH {store}, k AS (SELECT * FROM (VALUES (8), (16), (24), (32)) t(cut)) SELECT k.cut, count(*) FILTER (WHERE p.cmd_line LIKE '%-EncodedCommand%') AS truth,
count(*) FILTER (WHERE left(p.cmd_line, k.cut) LIKE '%-EncodedCommand%') AS found FROM process p, k GROUP BY k.cut""")
def sweep_cut(spark, sf_dir):
    """A ladder of one knob of the coarse store, in one pass: what of a hunt is left at each step."""
    ladder = spark.createDataFrame([(8,), (16,), (24,), (32,)], "cut int")
    rows = store(spark, sf_dir, "process").select("cmd_line").crossJoin(F.broadcast(ladder))  # four steps a row
    hit = lambda c: F.count_if(c.contains("-EncodedCommand"))
    return rows.groupBy("cut").agg(hit(F.col("cmd_line")).alias("truth"), hit(F.left("cmd_line", F.col("cut"))).alias("found"))


@query("""WITH RECURSIVE {soc}, keys AS (SELECT DISTINCT user_id AS node, sec AS key FROM soc),
reach AS (SELECT node, node AS other FROM (SELECT DISTINCT node FROM keys) n UNION SELECT r.node, k2.node FROM reach r JOIN keys k1 ON k1.node = r.other JOIN keys k2 ON k1.key = k2.key),
c AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node), t AS (SELECT cluster, node % 10 AS person, count(*) AS n FROM c GROUP BY cluster, node % 10)
SELECT (SELECT count(*) FROM c) AS nodes, count(DISTINCT cluster) AS clusters, (SELECT CAST(sum(m) AS BIGINT) FROM (SELECT max(n) AS m FROM t GROUP BY cluster) x) AS in_majority,
 (SELECT count(*) FROM (SELECT DISTINCT person, cluster FROM t) y) AS fragments FROM t""")
def entity_purity(spark, sf_dir):
    """Clusters against the people they stand for: nodes in their cluster's majority, and pieces that people fall into."""
    found = components.resolve(soc(spark, sf_dir).select(F.col("user_id").alias("node"), F.col("sec").alias("key")))
    kinds = persisted(found.withColumn("person", F.col("node") % 10).groupBy("cluster", "person").agg(F.count(F.lit(1)).alias("n")))
    per = kinds.groupBy("cluster").agg(F.max("n").alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("people"))
    return per.agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("clusters"), F.sum("m").alias("in_majority"), F.sum("people").alias("fragments"))


# -- graphs


@query("""WITH {store}, ids AS (
 SELECT concat('host:', hostname) AS id, 'host' AS ntype FROM asset UNION SELECT concat('ip:', ip), 'ip' FROM asset UNION SELECT concat('asset:', canonical_asset), 'asset' FROM asset
 UNION SELECT concat('auth:', CAST(event_uid AS STRING)), 'auth' FROM auth UNION SELECT concat('user:', CAST(user_uid AS STRING)), 'user' FROM auth
 UNION SELECT concat('session:', CAST(event_uid AS STRING)), 'session' FROM session UNION SELECT concat('user:', CAST(user_uid AS STRING)), 'user' FROM session UNION SELECT concat('host:', host), 'host' FROM session
 UNION SELECT concat('network:', CAST(event_uid AS STRING)), 'network' FROM network UNION SELECT concat('host:', src_hostname), 'host' FROM network UNION SELECT concat('ip:', dst_ip), 'ip' FROM network
 UNION SELECT concat('dns:', CAST(event_uid AS STRING)), 'dns' FROM dns UNION SELECT concat('host:', src_hostname), 'host' FROM dns UNION SELECT concat('domain:', query_hostname), 'domain' FROM dns
 UNION SELECT concat('process:', CAST(event_uid AS STRING)), 'process' FROM process UNION SELECT concat('host:', device_hostname), 'host' FROM process
 UNION SELECT concat('api:', CAST(event_uid AS STRING)), 'api' FROM api UNION SELECT concat('user:', CAST(actor_user_uid AS STRING)), 'user' FROM api UNION SELECT concat('service:', service), 'service' FROM api
 UNION SELECT concat('role:', CAST(actor_user_uid AS STRING)), 'role' FROM api WHERE api_operation = 'AssumeRole'),
e AS (
 SELECT DISTINCT 'sameAs' AS rel, hostname AS a, ip AS b FROM asset UNION ALL SELECT DISTINCT 'sameAs', hostname, canonical_asset FROM asset
 UNION ALL SELECT 'authenticated', CAST(user_uid AS STRING), CAST(event_uid AS STRING) FROM auth UNION ALL SELECT 'opened', CAST(user_uid AS STRING), CAST(event_uid AS STRING) FROM session UNION ALL SELECT 'on_host', CAST(event_uid AS STRING), host FROM session
 UNION ALL SELECT 'connected', src_hostname, CAST(event_uid AS STRING) FROM network UNION ALL SELECT 'to', CAST(event_uid AS STRING), dst_ip FROM network
 UNION ALL SELECT 'queried', src_hostname, CAST(event_uid AS STRING) FROM dns UNION ALL SELECT 'resolves', CAST(event_uid AS STRING), query_hostname FROM dns
 UNION ALL SELECT 'ran', device_hostname, CAST(event_uid AS STRING) FROM process UNION ALL SELECT 'called', CAST(actor_user_uid AS STRING), CAST(event_uid AS STRING) FROM api
 UNION ALL SELECT 'on_service', CAST(event_uid AS STRING), service FROM api UNION ALL SELECT DISTINCT 'assumed', CAST(actor_user_uid AS STRING), CAST(actor_user_uid AS STRING) FROM api WHERE api_operation = 'AssumeRole')
SELECT 'node' AS what, ntype AS kind, count(*) AS n FROM ids GROUP BY ntype UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel""")
def graph_of_events(spark, sf_dir):
    """The graph of the seven tables, counted by kind."""
    nodes, edges = event_graph(spark, sf_dir)
    count = F.count(F.lit(1)).alias("n")
    return nodes.groupBy(F.col("ntype").alias("kind")).agg(count).select(F.lit("node").alias("what"), "kind", "n").unionByName(
        edges.groupBy(F.col("rel").alias("kind")).agg(count).select(F.lit("edge").alias("what"), "kind", "n"))


def event_graph(spark, sf_dir):
    return graph.event_graph({t: persisted(store(spark, sf_dir, t)) for t in ("auth", "session", "network", "dns", "process", "api", "asset")})


@query("""WITH {store}, a AS (SELECT 'network' AS kind, event_uid AS uid, dst_ip AS near FROM network WHERE src_hostname = 'WS1') SELECT concat('ip:', near) AS id, 'to' AS rel FROM a GROUP BY near""")
def graph_two_hops(spark, sf_dir):
    """What a host's connections lead to, over the graph of events: two hops along named edges."""
    _, edges = event_graph(spark, sf_dir)
    first = graph.neighbours(edges.withColumn("trust", F.lit(1.0)), "host:WS1", "out", "connected").select(F.col("id").alias("src"))
    return edges.filter("rel = 'to'").join(first, "src", "left_semi").select(F.col("dst").alias("id"), "rel").distinct()


@query("SELECT 1 AS rank, concat('n:', CAST(n_nationkey AS STRING)) AS id, n_name AS label FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 3, concat('n:', CAST(n_nationkey AS STRING)), n_name FROM nation WHERE contains(lower(n_name), 'ation_1')")
def graph_find(spark, sf_dir):
    """An id without its prefix, and a part of labels: of each search the best kind of match."""
    nodes = concept_graph(spark, sf_dir)[0]
    return graph.find(nodes.filter("ntype = 'nation'"), "7").unionByName(graph.find(nodes, "ation_1")).select("rank", "id", "label")


@query("SELECT 'order' AS what, true AS same UNION ALL SELECT 'content', false")
def graph_fingerprints(spark, sf_dir):
    """A graph's fingerprint does not depend on order or partitions, and does on a single edge."""
    nodes, edges = concept_graph(spark, sf_dir)
    one = graph.fingerprint(nodes, edges)
    dealt = graph.fingerprint(nodes.orderBy(F.desc("id")).repartition(3), edges.repartition(5))
    less = graph.fingerprint(nodes, edges.filter("NOT (src = 'n:1' AND rel = 'subClassOf')"))
    return spark.createDataFrame([("order", one == dealt), ("content", one == less)], "what string, same boolean")


@query("""SELECT 'nation' AS ntype, count(DISTINCT c_nationkey) AS covered, CAST(0.6 AS DOUBLE) AS best FROM customer WHERE c_mktsegment = 'BUILDING'""")
def graph_coverage(spark, sf_dir):
    return graph.coverage(*concept_graph(spark, sf_dir), "s:BUILDING").withColumn("best", F.round("best", 3))


@query("SELECT concat('n:', CAST(c_nationkey AS STRING)) AS src, concat('s:', c_mktsegment) AS dst FROM customer GROUP BY c_nationkey, c_mktsegment")
def graph_one_control(spark, sf_dir):
    """Edges with a segment at exactly one end, turned so that it is dst."""
    edges = concept_graph(spark, sf_dir)[1]
    mixed = edges.filter("rel = 'subClassOf'").unionByName(edges.filter("rel = 'buysIn'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))
    return graph.one_control(mixed, lambda c: c.startswith("s:")).select("src", "dst").distinct()


@query("""WITH l AS (SELECT DISTINCT p_brand AS a, concat('t', CAST(p_size AS STRING), '.', CAST(p_partkey % 3 AS STRING)) AS via FROM part), r AS (SELECT DISTINCT concat('c', CAST(p_partkey % 7 AS STRING)) AS b, concat('t', CAST(p_size AS STRING)) AS via FROM part WHERE p_partkey % 2 = 0)
SELECT DISTINCT l.a, r.b FROM l JOIN r ON split_part(l.via, '.', 1) = split_part(r.via, '.', 1)""")
def graph_reach(spark, sf_dir):
    """What reaches what by way of a technique, equal or equal without its part after the dot."""
    part = scan(spark, sf_dir, "part")
    left = part.select(F.col("p_brand").alias("a"), F.concat(F.lit("t"), "p_size", F.lit("."), F.col("p_partkey") % 3).alias("via"))
    right = part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("c"), F.col("p_partkey") % 7).alias("b"), F.concat(F.lit("t"), "p_size").alias("via"))
    return graph.reach(left, right, "via")


@query("SELECT 'nodes:region' AS name, count(*) AS got, CAST(5 AS BIGINT) AS expected, true AS hard, count(*) = 5 AS ok FROM region UNION ALL SELECT 'edges:subClassOf', count(*), 25, true, count(*) = 25 FROM nation UNION ALL SELECT 'dangling', 0, 0, false, true UNION ALL SELECT 'nodes:absent', 0, 3, false, false")
def graph_reconcile(spark, sf_dir):
    nodes, edges = concept_graph(spark, sf_dir)
    return graph.reconcile(nodes, edges, {"nodes:region": (5, True), "edges:subClassOf": (25, True), "dangling": (0, False), "nodes:absent": (3, False)})


_ALIASES = "SELECT concat('a', CAST(i AS STRING)) AS src, concat('a', CAST(i + 1 AS STRING)) AS dst, 'sameAs' AS rel FROM range({}) t(i)"


@query("""WITH near AS (SELECT concat('n:', CAST(n_nationkey AS STRING)) AS id, row_number() OVER (ORDER BY concat('n:', CAST(n_nationkey AS STRING))) AS r FROM nation WHERE n_regionkey = 1)
SELECT 'r:1' AS id UNION ALL SELECT id FROM near WHERE r <= 3 UNION ALL SELECT 'a0' UNION ALL SELECT concat('a', CAST(i AS STRING)) FROM range(1, 51) t(i)""")
def graph_retrieve(spark, sf_dir):
    """Seeds, a share of the budget of each one's neighbours, and aliases along a chain of fifty."""
    edges = concept_graph(spark, sf_dir)[1].select("src", "dst", "rel")
    i = F.col("id").cast("string")
    chain = spark.range(50).select(F.concat(F.lit("a"), i).alias("src"), F.concat(F.lit("a"), (F.col("id") + 1).cast("string")).alias("dst"), F.lit("sameAs").alias("rel"))
    return graph.retrieve(edges.unionByName(chain), ["r:1", "a0"], 6)


@query("""WITH n AS (SELECT concat('r:', CAST(r_regionkey AS STRING)) AS id, r_name AS label, 0 AS k FROM region WHERE r_regionkey = 1 UNION ALL SELECT concat('n:', CAST(n_nationkey AS STRING)), n_name, 1 FROM nation WHERE n_regionkey = 1),
s AS (SELECT *, row_number() OVER (ORDER BY k, id) AS place FROM n)
SELECT 1 AS part, place, concat(id, ' = ', label) AS line FROM s WHERE place <= 4
UNION ALL SELECT 2, row_number() OVER (ORDER BY id), concat(id, ' [subClassOf] r:1') FROM s WHERE place BETWEEN 2 AND 4 QUALIFY row_number() OVER (ORDER BY id) <= 2""")
def graph_serialise(spark, sf_dir):
    nodes, edges = concept_graph(spark, sf_dir)
    kept = graph.neighbours(edges, "r:1").select("id").union(spark.createDataFrame([("r:1",)], "id string"))
    return graph.serialise(nodes, edges, kept, ["r:1"], 4, 2)


# -- normalisation


_SOURCES = {
    "network": ([mapping.Field("time", "time"), mapping.Field("src_ip", "src_endpoint.ip"), mapping.Field("src_hostname", "src_endpoint.hostname"), mapping.Field("dst_ip", "dst_endpoint.ip"),
                 mapping.Field("dst_port", "dst_endpoint.port", "coerced", "int"), mapping.Field("bytes_out", "traffic.bytes_out"), mapping.Field("bytes_in", "traffic.bytes_in")], 4001),
    "api": ([mapping.Field("time", "time"), mapping.Field("CAST(actor_user_uid AS STRING)", "actor.user_uid"), mapping.Field("service", "api.service"), mapping.Field("api_operation", "api.operation"),
             mapping.Field("mfa_present", "actor.mfa")], 6003),
    "process": ([mapping.Field("time", "time"), mapping.Field("device_hostname", "device.hostname"), mapping.Field("image_name", "process.name"), mapping.Field("cmd_line", "process.cmd_line"),
                 mapping.Field("length(cmd_line)", "unmapped.length", "unmapped")], 1007),
    "auth": ([mapping.Field("time", "time"), mapping.Field("CAST(user_uid AS STRING)", "actor.user_uid"), mapping.Field("outcome", "status"), mapping.Field("is_remote", "is_remote")], 3002),
}


def records(spark, sf_dir, source: str) -> DataFrame:
    """A source's rows as nested records with their uid."""
    fields, uid = _SOURCES[source]
    return mapping.normalise(store(spark, sf_dir, source), [mapping.Field("event_uid", "uid"), *fields], {"class_uid": uid})


@query("""WITH {store} SELECT 'network' AS source, 4001 AS class_uid, event_uid AS uid, time, src_ip AS a, CAST(dst_port AS STRING) AS b FROM network
UNION ALL SELECT 'api', 6003, event_uid, time, CAST(actor_user_uid AS STRING), api_operation FROM api UNION ALL SELECT 'process', 1007, event_uid, time, device_hostname, cmd_line FROM process
UNION ALL SELECT 'auth', 3002, event_uid, time, CAST(user_uid AS STRING), outcome FROM auth""")
def normalise_four_sources(spark, sf_dir):
    """Four sources as records of four classes; two fields of each are read back by their paths."""
    paths = {"network": ("src_endpoint.ip", "dst_endpoint.port"), "api": ("actor.user_uid", "api.operation"), "process": ("device.hostname", "process.cmd_line"), "auth": ("actor.user_uid", "status")}
    return united([
        records(spark, sf_dir, s).select(F.lit(s).alias("source"), "class_uid", "uid", "time", F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for s, (a, b) in paths.items()
    ])


@query("SELECT * FROM (VALUES ('typed', 5, 0.833333), ('coerced', 1, 0.166667), ('unmapped', 0, 0.0)) t(status, n, share) UNION ALL SELECT 'breaking', 1, 0.0")
def mapping_coverage(spark, sf_dir):
    """Shares of typed, coerced and unmapped fields of a mapping, and how many that detections need are not typed."""
    fields = _SOURCES["network"][0][:4] + [mapping.Field("dst_port", "dst_endpoint.port", "coerced", "int", detection=True), mapping.Field("bytes_out", "traffic.bytes_out")]
    got = mapping.coverage(fields)
    rows = [(s, sum(f.status == s for f in fields), round(got[s], 6)) for s in ("typed", "coerced", "unmapped")] + [("breaking", len(got["breaking"]), 0.0)]
    return spark.createDataFrame(rows, "status string, n int, share double")


@query("""SELECT * FROM (VALUES ('srcIpAddress', 'src_endpoint.ip'), ('DestinationPort', 'dst_endpoint.port'), ('source_port', 'src_endpoint.port'), ('CommandLine', 'process.cmd_line'),
('userName', 'actor.user.name'), ('flavour', 'unmapped')) t(field, path)""")
def mapping_suggest(spark, sf_dir):
    """Paths for field names of unseen sources, by rules on their words."""
    valid = {"src_endpoint.ip", "dst_endpoint.ip", "src_endpoint.port", "dst_endpoint.port", "process.cmd_line", "actor.user.name"}
    rules = [
        ({"src", "source"}, {"ip", "address"}, ["src_endpoint.ip"]), ({"src", "source"}, {"port"}, ["src_endpoint.port"]), ({"dst", "destination"}, {"port"}, ["dst_endpoint.port"]),
        ({"dst", "destination"}, {"ip", "address"}, ["dst_endpoint.ip"]), ({"command", "cmd"}, {"line"}, ["process.command", "process.cmd_line"]), ({"user"}, set(), ["actor.user.name"]),
    ]
    names = ["srcIpAddress", "DestinationPort", "source_port", "CommandLine", "userName", "flavour"]
    return spark.createDataFrame([(n, mapping.suggest(n, rules, valid)) for n in names], "field string, path string")


@query("""WITH {store}, r AS (SELECT event_uid AS uid, cmd_line, image_name, event_uid % 4 = 0 AS gone FROM process)
SELECT 'has_command' AS probe, count(*) AS records, count(*) FILTER (WHERE gone) AS lost FROM r UNION ALL SELECT 'image_kept', count(*), count(*) FILTER (WHERE gone OR image_name = 'cmd.exe') FROM r""")
def mapping_probes(spark, sf_dir):
    """What an emitter lost, by class of failure: records that are gone, values that were changed."""
    full = records(spark, sf_dir, "process")
    out = full.filter("uid % 4 <> 0").withColumn("process", F.struct(F.when(F.col("process.name") != "cmd.exe", F.col("process.name")).otherwise(F.lit("CMD")).alias("name"), F.col("process.cmd_line").alias("cmd_line")))
    wanted = full.select("uid", F.lit("has_command").alias("probe"), F.lit("process.cmd_line").alias("path"), F.lit(None).cast("string").alias("wanted")).unionByName(
        full.select("uid", F.lit("image_kept").alias("probe"), F.lit("process.name").alias("path"), F.col("process.name").alias("wanted")))
    return mapping.probes(out, wanted, "uid")


@query("""SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, true), (5, false), (6, true), (7, false)) t(i, same)""")
def mapping_value_equality(spark, sf_dir):
    """Values of two JSON documents: numbers by value, booleans only with booleans, objects whatever the order of their keys."""
    pairs = [("1", "1.0"), ('{"a":1,"b":2}', '{"b":2,"a":1.0}'), ("true", "1"), ('"1"', "1"), ("[1,2]", "[1,2.0]"), ("[1,2]", "[2,1]"), ("null", "null"), ("null", "0")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return rows.select("i", mapping.same_value(F.col("a"), F.col("b")).alias("same"))


@query("""SELECT * FROM (VALUES ('rows', true), ('rounding', true), ('beyond', false), ('null_is_not_zero', false), ('dates', true), ('majority', true), ('tie', false)) t(what, same)""")
def answers_compared(spark, sf_dir):
    """Equality of answers of engines, and their vote."""
    import datetime

    same, vote = scoring.same_answers, scoring.consensus
    rows = [
        ("rows", same([(1, "a"), (None, True)], [("1", "a"), (None, 1)])), ("rounding", same([(1.004,)], [(1.0149,)])), ("beyond", same([(1.0,)], [(1.03,)])), ("null_is_not_zero", same([(None,)], [(0,)])),
        ("dates", same([(datetime.date(2024, 1, 2),)], [("2024-01-02 00:00:00",)])), ("majority", vote({"a": "1", "b": "1", "c": "2"}) == ("1", ["c"])), ("tie", vote({"a": "1", "b": "2"})[0] is not None),
    ]
    return spark.createDataFrame(rows, "what string, same boolean")


# -- storage arithmetic


@query("""WITH t AS (SELECT * FROM (VALUES ('hot', 0, 30, 0.12), ('warm', 30, 120, 0.03), ('cold', 120, 400, 0.004)) v(tier, first, last, price)), d AS (SELECT CAST(i AS INT) AS day FROM range(1, 366) r(i))
SELECT day, tier, CAST(greatest(0, least(day, last) - first) * 50.0 AS DOUBLE) AS gb, round(greatest(0, least(day, last) - first) * 50.0 * price / 30, 4) AS cost FROM t, d""")
def storage_retention(spark, sf_dir):
    got = layout.retention_cost(spark, 50.0, [("hot", 30, 0.12), ("warm", 90, 0.03), ("cold", 280, 0.004)], 365)
    return got.select("day", "tier", F.col("gb").cast("double").alias("gb"), F.round("cost", 4).alias("cost"))


@query("SELECT true AS compressed, true AS amplified, count(*) AS n FROM lineitem")
def storage_accounting(spark, sf_dir):
    """Bytes as text, as files and as written with a compaction: compression is above one, amplification below two raw sizes."""
    rows = scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    raw = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + 1)).first()[0]
    table = LogTable(spark, scratch(spark, "accounted"))
    table.append(rows)
    first = table.statistics()["data_bytes"]
    table.compact(1)
    stored = table.statistics()["data_bytes"]
    got = layout.accounting(raw, stored, first + stored, 30.0, 10 * raw)
    ok = (got["compression"] > 1, 0 < got["write_amplification"] < 2 and got["drive_writes_per_day"] > 0)
    return table.read().agg(F.count(F.lit(1)).alias("n")).select(F.lit(ok[0]).alias("compressed"), F.lit(ok[1]).alias("amplified"), "n")


@query("SELECT * FROM (VALUES (100, true), (800, true), (2500, true)) t(columns, readable)")
def wide_tables(spark, sf_dir):
    """Tables of ever more columns, written and read by one of them: there is no catalog here that would refuse."""
    out = []
    for n in (100, 800, 2500):
        path = scratch(spark, "wide")
        spark.range(3).select(*[(F.col("id") + k).alias(f"c{k}") for k in range(n)]).coalesce(1).write.parquet(path)
        back = spark.read.parquet(path)
        out.append((n, len(back.columns) == n and back.agg(F.sum(f"c{n - 1}")).first()[0] == 3 * n))
    return spark.createDataFrame(out, "columns int, readable boolean")


@query("""WITH {soc}, d AS (SELECT k.seed, s.status_id FROM soc s, (VALUES (1), (2), (3), (4), (5)) k(seed) WHERE substr(md5(concat(CAST(k.seed AS STRING), '-', CAST(s.uid AS STRING))), 1, 1) < '4'),
r AS (SELECT seed, count(*) AS n, CAST(count(*) FILTER (WHERE status_id = 2) AS DOUBLE) / count(*) AS share FROM d GROUP BY seed)
SELECT count(*) AS draws, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd, round(min(share), 6) AS least, round(max(share), 6) AS most FROM r""")
def sweep_redraw(spark, sf_dir):
    """A statistic over redrawn samples, a draw per seed, in one pass: its mean, deviation and bounds."""
    seeds = spark.createDataFrame([(k,) for k in range(1, 6)], "seed int")
    rows = soc(spark, sf_dir).select("uid", "status_id").crossJoin(F.broadcast(seeds))  # five draws a row
    drawn = rows.filter(F.substring(F.md5(F.concat_ws("-", F.col("seed").cast("string"), F.col("uid").cast("string"))), 1, 1) < "4")
    shares = drawn.groupBy("seed").agg((F.count_if(F.col("status_id") == 2) / F.count(F.lit(1))).alias("share"))
    got = scoring.bands(shares.withColumn("k", F.lit(0)), ["k"], "share")
    return got.select(F.col("n").alias("draws"), *[F.round(c, 6).alias(c) for c in ("mean", "sd", "least", "most")])


@query("SELECT concat('n:', CAST(n_nationkey AS STRING)) AS id FROM nation UNION ALL SELECT concat('r:', CAST(r_regionkey AS STRING)) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)")
def graph_leaves(spark, sf_dir):
    """Concepts of the hierarchy that nothing is below."""
    nodes, edges = concept_graph(spark, sf_dir)
    above = edges.filter("rel = 'subClassOf'").select(F.col("dst").alias("id")).distinct()
    return nodes.filter("ntype IN ('region', 'nation')").select("id").join(above, "id", "left_anti")
