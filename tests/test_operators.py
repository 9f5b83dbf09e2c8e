import random

import pytest
from pyspark.sql import functions as F

from siftlake.functions.expressions import ipv4, morton, row_digest
from siftlake.operators import components, graph, layout, mapping, panels, safety, sigma
from siftlake.sources.logtable import Conflict, LogTable
from siftlake.streaming import streams


def test_rules_match_without_case_and_reject_the_unknown(spark):
    df = spark.createDataFrame([(1, "Net.exe USER add", "a"), (2, "powershell -enc", None), (3, None, "b")], "id int, cmd string, who string")
    hit = lambda rule: [r.id for r in df.filter(sigma.compile_rule(rule)).orderBy("id").collect()]
    assert hit({"detection": {"s": {"cmd|contains|all": ["net", "user"]}, "condition": "s"}}) == [1]
    assert hit({"detection": {"s": {"cmd|contains": ["user", "-ENC"]}, "f": {"who": "a"}, "condition": "s and not f"}}) == [2]
    assert hit({"detection": {"s": {"who": None}, "condition": "s"}}) == [2]
    assert hit({"detection": {"s": {"cmd|endswith": "add"}, "t": {"who": "b"}, "condition": "1 of them"}}) == [1, 3]
    for bad in ({"detection": {"s": {"cmd|base64": "x"}, "condition": "s"}}, {"detection": {"s": {"cmd": "x"}, "condition": "s | count() > 3"}}):
        with pytest.raises(ValueError):
            sigma.compile_rule(bad)


def test_correlations_keep_their_span(spark):
    rows = [("u", 0, "a"), ("u", 50, "b"), ("u", 400, "b"), ("v", 0, "b"), ("v", 10, "a"), ("w", 0, "a"), ("w", 299, "a"), ("w", 301, "a")]
    df = spark.createDataFrame(rows, "g string, time_s long, rule string")
    run = lambda **c: {r.g: r["at"] for r in sigma.correlate(df, {"group-by": ["g"], **c}).collect()}
    assert run(type="event_count", rules=["a"], timespan="5m", condition={"gte": 2}) == {"w": 299}
    assert run(type="temporal", rules=["a", "b"], timespan="5m") == {"u": 50, "v": 10}
    assert run(type="temporal_ordered", rules=["a", "b"], timespan="5m") == {"u": 50}
    with pytest.raises(ValueError):
        run(type="event_count", rules=["a"], timespan="", condition={"gte": 2})


def test_clusters_equal_union_find(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), f"k{rnd.randrange(260)}") for _ in range(400)] + [(i, "hub") for i in range(40)] + [(7, None)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for n, k in pairs:
        if k:
            a, b = root(("n", n)), root(("k", k))
            up[max(a, b)] = min(a, b)
    want = {}
    for n, k in pairs:
        if k:
            want.setdefault(root(("n", n)), set()).add(n)
    got = {}
    for r in components.resolve(spark.createDataFrame(pairs, "node long, key string")).collect():
        got.setdefault(r.cluster, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(m) for c, m in got.items())
    assert components.resolve(spark.createDataFrame([], "node long, key string")).count() == 0


def test_paths_rank_by_the_weakest_edge(spark):
    e = spark.createDataFrame([("a", "b", "r", "x", 0.9), ("b", "d", "r", "x", 0.2), ("a", "c", "r", "x", 0.6), ("c", "d", "r", "x", 0.7), ("d", "a", "back", "x", 0.1)], "src string, dst string, rel string, trust_class string, trust double")
    got = [(r.path, r.trust, r.weakest_hop, r.crosses_inference) for r in graph.paths(e, "a", "d").collect()]
    assert got == [(["a", "c", "d"], 0.6, 1, False), (["a", "b", "d"], 0.2, 2, True), (["a", "d"], 0.1, 1, True)]


def test_morton_interleaves(spark):
    r = spark.sql("SELECT 5L AS x, 3L AS y").select(morton([F.col("x"), F.col("y")], 4).alias("z")).first()
    assert r.z == 0b011011
    rows = spark.createDataFrame([("10.1.2.3",), ("256.1.1.1",), ("1.2.3",), (None,), ("a.b.c.d",)], "a string").select(ipv4(F.col("a")).alias("v")).collect()
    assert [x.v for x in rows] == [167838211, None, None, None, None]


def test_digest_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    digest = lambda d: d.agg(row_digest("id", "x").alias("d")).first().d
    assert digest(df) == digest(df.repartition(5, "x")) != digest(df.filter("id > 0"))


def test_log_table_commits_conflicts_and_compacts(spark, tmp_path):
    t = LogTable(spark, f"file://{tmp_path}/t", inline_rows=5)
    for k in range(4):
        t.append(spark.range(k * 20, k * 20 + 20))
    t.append(spark.range(1000, 1003))
    assert t.read().count() == 83 and t.read(0).count() == 20 and len(t.snapshot().inline) == 3
    seen = t.snapshot()
    t.delete(F.col("id") == 3)
    with pytest.raises(Conflict):
        t.delete(F.col("id") == 4, at=seen)
    assert sorted(r.id for r in t.read().filter("id < 6").collect()) == [0, 1, 2, 4, 5]
    t.compact(1, ["id"])
    assert len(t.snapshot().files) == 1 and t.read().count() == 82 and not t.snapshot().inline
    assert t.expire(1) > 0 and t.read().count() == 82


def test_inlined_rows_are_deleted_and_survive_a_racing_compaction(spark, tmp_path):
    t = LogTable(spark, f"file://{tmp_path}/inline", inline_rows=5)
    t.append(spark.range(3))
    t.delete(F.col("id") == 1)
    assert sorted(r.id for r in t.read().collect()) == [0, 2] and len(t.snapshot().inline) == 2
    write = t._write

    def late(df):
        files = write(df)
        LogTable(spark, t.path, inline_rows=5).append(spark.range(10, 12))
        return files

    t._write = late
    t.compact(1, ["id"])
    assert sorted(r.id for r in t.read().collect()) == [0, 2, 10, 11] and len(t.snapshot().inline) == 2
    t._write = write
    seen = t.snapshot()
    t.delete(F.col("id") == 10)
    with pytest.raises(Conflict):
        t.delete(F.col("id") == 11, at=seen)
    assert sorted(r.id for r in t.read().collect()) == [0, 2, 11]
    assert t.statistics()["files"] == 1 and t.statistics()["inlined"] == 1


def test_a_batch_is_added_once_and_writers_contend(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = LogTable(spark, f"file://{tmp_path}/once")
    for batch in (0, 1, 1, 0):
        t.append(spark.range(10), ("s", batch))
    assert t.read().count() == 20
    t.expire(1)
    t.append(spark.range(10), ("s", 1))
    assert t.read().count() == 20
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda k: LogTable(spark, t.path, retries=50).append(spark.range(k, k + 1)), range(100, 112)))
    assert len(set(versions)) == 12 and t.read().count() == 32


def test_pruning_is_conservative(spark, tmp_path):
    spark.range(0, 4000).repartitionByRange(8, "id").write.parquet(f"{tmp_path}/p")
    stats = layout.row_groups(spark, f"{tmp_path}/p", ["id"])
    for v in (0, 1999, 3999, 5000):
        kept = stats.filter(layout.may_match(F.col("low"), F.col("high"), "eq", [v])).count()
        assert kept == (1 if v < 4000 else 0)


def test_panel_answers_equal_recomputation(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("c"), (F.col("id") % 10).alias("b"), "id")
    p = panels.Panel((("c", "c"), ("b", "b")), (("n", "count", "1"), ("m", "max", "id")))
    held = panels.Panels()
    held.declare(p)
    for k in range(3):
        held.apply(rows.filter(F.col("id") % 3 == k))
    want = panels.Panel(p.keys[:1], p.measures)
    got, used = held.answer(want, rows)
    assert used and sorted(got.collect()) == sorted(want.partial(rows).collect())
    assert not held.answer(panels.Panel(p.keys, (("s", "sum", "id"),)), rows)[1]
    with pytest.raises(ValueError):
        panels.Panel((), (("d", "distinct", "id"),))


def test_mapping_paths_and_absence(spark):
    schema = {"catch_alls": ["unmapped"], "classes": {"c": {"attrs": {"a": "obj", "unmapped": "object"}}}, "objects": {"obj": {"attrs": {"x": "int"}}}}
    assert mapping.resolve_path(schema, "c", "a.x") == "full" and mapping.resolve_path(schema, "c", "unmapped.q") == "deep"
    with pytest.raises(ValueError):
        mapping.resolve_path(schema, "c", "a.y")
    raw = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    out = mapping.normalise(raw, [mapping.Field("x", "a.x")], {"k": 1}).collect()
    assert [r.a.x for r in out] == [None, 5]
    gold = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id int, x int")
    r = mapping.fidelity(gold, raw, "id", ["x"]).first()
    assert (r.gold, r.present, r.same) == (3, 2, 2)


def test_safe_sql(spark):
    assert safety.safe_sql(spark, "SELECT * FROM range(100)").count() == 20
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            safety.safe_sql(spark, bad)


def test_safe_sql_looks_into_the_plan(spark, tmp_path):
    (tmp_path / "secret.txt").write_text("secret")
    spark.range(3).createOrReplaceTempView("three")
    good = ("SELECT count(*) AS n, max(id) FROM three WHERE id IN (SELECT id FROM three) AND id > 0", "WITH a AS (SELECT id FROM three) SELECT upper(CAST(id AS STRING)) FROM a",
            "SELECT CASE WHEN id > 1 THEN 'x' END, row_number() OVER (ORDER BY id) FROM three")
    for text in good:
        assert safety.safe_sql(spark, text).count() >= 1
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'java.home')", "SELECT java_method('java.lang.System', 'getProperty', 'java.home')", f"SELECT * FROM text.`{tmp_path}/secret.txt`",
                f"SELECT (SELECT max(value) FROM text.`{tmp_path}/secret.txt`) AS x", f"WITH a AS (SELECT * FROM csv.`{tmp_path}`) SELECT * FROM a", "SELECT * FROM nowhere",
                "SELECT id FROM three WHERE EXISTS (SELECT 1 FROM three WHERE input_file_name() = 'x')", "SELECT current_user()", "SELECT id, (SELECT reflect('a', 'b')) FROM three",
                "SELECT * FROM three WHERE id IN (SELECT java_method('a', 'b'))", "SELECT transform(array(1), x -> reflect('a', 'b'))"):
        with pytest.raises(ValueError):
            safety.safe_sql(spark, bad)


def test_log_table_publishes_by_rename_and_reads_from_checkpoints(spark, tmp_path):
    t = LogTable(spark, f"file://{tmp_path}/r", checkpoint_every=4)
    t._create = lambda version, entry, ending=".json": t._published(f"{t.path}/_log/x{version}{ending}.tmp", f"{t.path}/_log/{version:012d}{ending}", __import__("json").dumps(entry).encode())
    for k in range(10):
        t.append(spark.range(k, k + 1).coalesce(1))
    assert not t._create(3, {}) and t.read().count() == 10 and t._names(".base") == [4, 8]
    read, seen = t._read, []
    t._read = lambda v, ending=".json": seen.append((v, ending)) or read(v, ending)
    assert len(t.snapshot().files) == 10 and seen == [(8, ".base"), (9, ".json")]
    assert t.read(5).count() == 6
    t._read = read
    t.delete(F.col("id") < 3)
    assert t.expire(1) > 0 and t.read().count() == 7 and t.versions() == [10] and t._names(".base") == [10]


def test_expiry_leaves_readers_whole_at_every_step(spark, tmp_path):
    t = LogTable(spark, f"file://{tmp_path}/e")
    for k in range(6):
        t.append(spark.range(k, k + 1).coalesce(1))
    t.compact(1)
    counts, fs = [], t._fs

    class Watched:
        def __getattr__(self, name):
            return getattr(fs, name)

        def delete(self, *a):
            counts.append(LogTable(spark, t.path).read().count())
            return fs.delete(*a)

    t._fs = Watched()
    assert t.expire(1) == 6 and counts and set(counts) == {6} and t.read().count() == 6


def test_inlined_rows_move_into_files_beyond_the_total(spark, tmp_path):
    t = LogTable(spark, f"file://{tmp_path}/i", inline_rows=5, inline_total=12)
    sizes = []
    for k in range(5):
        t.append(spark.range(5 * k, 5 * k + 5))
        sizes.append(len(t.snapshot().inline))
    assert sizes == [5, 10, 0, 5, 10] and sorted(r.id for r in t.read().collect()) == list(range(25))
    with pytest.raises(ValueError):
        t.add_files(_foreign(spark, tmp_path))  # another column


def _foreign(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/foreign")
    return spark.read.parquet(f"{tmp_path}/foreign").inputFiles()


def test_graph_closures_have_no_depth_limit(spark):
    chain = [(f"c{i + 1}", f"c{i}", "subClassOf") for i in range(70)] + [("c0", "c70", "subClassOf")]
    edges = spark.createDataFrame(chain, "src string, dst string, rel string")
    assert graph.descendants(edges, "c0").count() == 71
    with pytest.raises(RuntimeError):
        graph.descendants(edges, "c0", most=10)


def test_paths_say_when_the_budget_was_reached(spark):
    e = [("a", f"m{i}", "r", 0.5 + i / 1000) for i in range(40)] + [(f"m{i}", "z", "r", 0.9) for i in range(40)]
    edges = spark.createDataFrame(e, "src string, dst string, rel string, trust double")
    full, cut = graph.paths(edges, "a", "z").collect(), graph.paths(edges, "a", "z", budget=5).collect()
    assert full[0].path == cut[0].path == ["a", "m39", "z"] and all(r.complete for r in full) and not any(r.complete for r in cut)


def test_kinds_within_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.randrange(3), rnd.randrange(300), rnd.choice("abcd"), "r") for _ in range(200)]
    df = spark.createDataFrame(rows, "u int, time_s long, ip string, rule string")
    for gte in (2, 3, 4):
        got = {r.u: r["at"] for r in sigma.correlate(df, {"type": "value_count", "rules": ["r"], "group-by": ["u"], "timespan": "10s", "condition": {"gte": gte, "field": "ip"}}).collect()}
        want = {}
        for u, t, _, _ in sorted(rows, key=lambda r: r[1]):
            if len({v for x, s, v, _ in rows if x == u and t - 10 <= s <= t}) >= gte:
                want.setdefault(u, t)
        assert got == want


def test_late_events_land_in_their_window_or_are_dropped(spark, tmp_path):
    # A batch drops by the watermark that the batch before it has used, so one more batch stands in between.
    rows = [[("2024-01-01 00:01:00", "a")], [("2024-01-01 03:00:00", "a")], [("2024-01-01 03:01:00", "a")], [("2024-01-01 00:02:00", "a")], [("2024-01-01 09:00:00", "a")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(0.05)
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def first_window(late):
        out = f"{tmp_path}/out{late[0]}"
        streams.drain(streams.tumbling(streams.file_stream(spark, f"{tmp_path}/in", schema), "ts", ["k"], "5 minutes", late), out, f"{tmp_path}/c{late[0]}")
        return {str(r.start): r.n for r in spark.read.parquet(out).collect()}["2024-01-01 00:00:00"]

    assert first_window("4 hours") == 2 and first_window("1 hour") == 1


def test_every_query_has_a_name_of_its_own():
    from siftlake.plans import registry

    assert len(registry.QUERIES) > 100 and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
