import random

from pyspark.sql import functions as F

from siftlake.operators import layout, panels
from siftlake.streaming import streams


def brute(rows, steps, span):
    out = set()
    for k in {r[0] for r in rows}:
        starts = [None] * len(steps)
        for _, t, what in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            for i in reversed(range(len(steps))):
                if steps[i] == what:
                    start = t if i == 0 else starts[i - 1]
                    if start is not None and t - start <= span and (i == 0 or t > start):
                        starts[i] = start if starts[i] is None else max(starts[i], start)
                        if i == len(steps) - 1:
                            out.add((k, starts[i], t))
    return out


def test_ordered_sequences_equal_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"u{rnd.randrange(4)}", t, rnd.choice("abcx")) for t in sorted(rnd.sample(range(20_000), 160))]
    df = spark.createDataFrame(rows, "u string, s long, kind string").select("u", F.timestamp_seconds("s").alias("ts"), "kind")
    # Five batches, each with events of the whole time; the last brings the watermark past all others.
    dealt = df.withColumn("k", F.pmod(F.xxhash64("u", "ts"), F.lit(4)))
    for k in range(4):
        dealt.filter(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", 90_000, "x")], "u string, s long, kind string").select("u", F.timestamp_seconds("s").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.ordered_sequences(streams.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), "ts", "u", "kind", ["a", "b", "c"], 900, 21_000)
    streams.drain(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    got = {(r.key, r.start, r["at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == brute(rows, "abc", 900) and got


def test_duplicates_and_survivors(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 5).alias("k"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") > 2, F.lit("S0")).alias("state"))
    df.write.parquet(f"{tmp_path}/in")
    source = lambda: streams.file_stream(spark, f"{tmp_path}/in", df.schema)
    streams.drain(streams.deduplicated(source(), "ts", ["k"]), f"{tmp_path}/d", f"{tmp_path}/cd")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 5
    streams.drain(streams.survivors(source(), "state", ["S0"]), f"{tmp_path}/s", f"{tmp_path}/cs")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 3  # a null is not a dropped value


def test_panel_in_a_stream(spark, tmp_path):
    spark.range(90).select((F.col("id") % 4).alias("k")).repartition(3).write.parquet(f"{tmp_path}/in")
    seen = {}
    panel = panels.Panel((("k", "k"),), (("n", "count", "1"),))
    source = streams.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    streams.maintained(source, f"{tmp_path}/c", panel, lambda d: seen.update({r.k: r.n for r in d.collect()}))
    assert seen == {0: 23, 1: 23, 2: 22, 3: 22}


def test_storage_arithmetic(spark):
    assert layout.accounting(100, 25, 150, 1, 300) == {"compression": 4.0, "write_amplification": 1.5, "drive_writes_per_day": 0.5}
    got = {(r.day, r.tier): r.gb for r in layout.retention_cost(spark, 2.0, [("hot", 3, 0.1), ("cold", 10, 0.01)], 5).collect()}
    assert got[(2, "hot")] == 4 and got[(5, "hot")] == 6 and got[(5, "cold")] == 4 and got[(3, "cold")] == 0


def test_z_order_prunes_both_dimensions(spark, tmp_path):
    df = spark.range(4096).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    layout.z_ordered(df, ["x", "y"], 16).write.parquet(f"{tmp_path}/z")
    stats = layout.row_groups(spark, f"{tmp_path}/z", ["x", "y"])
    for c in ("x", "y"):
        one = stats.filter(F.col("column") == c)
        assert one.filter(layout.may_match(F.col("low"), F.col("high"), "range", [0, 3])).count() < one.count() / 2
    assert spark.read.parquet(f"{tmp_path}/z").count() == 4096
