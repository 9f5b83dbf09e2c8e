import datetime
import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import graph, mapping, payloads, scoring, triples, workload


def test_schedule_spreads_shapes_and_probes():
    due = workload.schedule(["a", "b"], 10, 2, 5)
    assert [x for x in due if x[1] != "probe"] == [(0, "a"), (5, "b"), (10, "a"), (15, "b")]
    assert [t for t, s in due if s == "probe"] == [0, 5, 10, 15]


def test_latency_counts_from_the_due_time_and_failures_are_rows(spark):
    import time

    def slow(chance):
        time.sleep(0.4)
        return spark.range(1)

    def wrong(chance):
        raise ValueError("no")

    runs = workload.drive(spark, [(0.0, "slow"), (0.0, "slow"), (0.0, "wrong")], {"slow": slow, "wrong": wrong}, workers=1)
    got = {r["number"]: r for r in runs.collect()}
    assert len(got) == 3 and got[1]["waited_s"] >= 0.4 and got[1]["latency_s"] >= 0.8
    assert [r["failed"] for _, r in sorted(got.items())] == [False, False, True] and "no" in got[2]["error"]
    out = {r["shape"]: r for r in workload.latencies(runs).collect()}
    assert out["slow"]["runs"] == 2 and out["slow"]["p50"] <= out["slow"]["p99"] and out["wrong"]["failures"] == 1 and out["wrong"]["p50"] is None


@pytest.mark.parametrize("block", [1, 7])
def test_payloads_come_back_whole(spark, block):
    df = spark.range(3000).select("id", F.concat(F.lit("user-"), F.col("id") % 97, F.lit("@corp.example")).alias("who"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("gap"))
    rows = payloads.payload(df)
    held = payloads.train(rows, 4096, 2000)
    for codec, level, d in (("zlib", 6, None), ("zstd", 3, None), ("zstd", 3, held)):
        packed = payloads.compressed(rows, codec, level, d, block)
        assert packed.agg(F.sum("rows")).first()[0] == 3000
        back = payloads.expanded(packed, codec, d)
        assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
    if block == 1:
        size = {r["codec"]: r["stored"] for r in payloads.regimes(rows, held, (1,)).collect()}
        assert size["zstd-3+dict"] < size["zstd-3"]


def test_patterns_over_tables(spark):
    api = spark.createDataFrame([(1, "Attach", False, "u1"), (2, "Attach", True, "u2"), (3, "Attach", None, "u1"), (4, "Get", False, "u1")], "uid int, op string, mfa boolean, actor string")
    sess = spark.createDataFrame([(7, "u1", 10.5), (8, "u2", 3.0)], "uid int, who string, hours double")
    classes = {"Api": triples.ClassMap(api, "api/{uid}", {"op": "op", "mfa": "mfa", "actor": "actor", "uid": "uid"}), "Session": triples.ClassMap(sess, "s/{uid}", {"who": "who", "hours": "hours"})}
    ask = lambda q: sorted(tuple(r) for r in triples.select(classes, q).collect())
    assert ask('PREFIX : <http://x/#> SELECT ?x WHERE { ?x a :Api ; :op "Attach" ; :mfa ?m . FILTER(?m = false) }') == [("api/1",)]
    assert ask("SELECT ?x ?s WHERE { ?x a :Api ; :mfa ?m ; :actor ?w . ?s a :Session ; :who ?w ; :hours ?h . FILTER(?h > 10.25 && ?m != true) }") == [("api/1", "s/7"), ("api/4", "s/7")]
    for bad in ("SELECT ?x WHERE { ?x :op ?o }", "SELECT ?x WHERE { ?x a :Api ; :nothing ?o }", "SELECT ?x ?y WHERE { ?x a :Api . ?y a :Session }", "DELETE WHERE { ?x a :Api }"):
        with pytest.raises(ValueError):
            ask(bad)


def test_controls_reach_and_stages(spark):
    edges = spark.createDataFrame([("c:1", "d:1", "broader"), ("d:2", "c:2", "related"), ("c:1", "c:2", "related"), ("d:1", "d:2", "related"), ("c:1", "d:1", "broader")], "src string, dst string, rel string")
    got = graph.one_control(edges, lambda c: c.startswith("c:")).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == [("d:1", "c:1"), ("d:2", "c:2")]
    left = spark.createDataFrame([("d1", "T1.001"), ("d2", "T2"), ("d3", "T3")], "a string, via string")
    right = spark.createDataFrame([("x", "T1"), ("y", "T2.002"), ("z", "T9")], "b string, via string")
    assert sorted(tuple(r) for r in graph.reach(left, right, "via").collect()) == [("d1", "x"), ("d2", "y")]
    steps = [spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "src string, dst string")]
    names = spark.createDataFrame([("b", "G"), ("c", "G")], "id string, grp string")
    assert [tuple(r) for r in graph.stages(steps, [None, names]).collect()] == [(0, "a", "G", 2)]


def test_retrieval_is_bounded_and_closes_aliases(spark):
    hub = [("hub", f"n{i:03d}", "touches") for i in range(200)] + [("n001", "alias1", "sameAs"), ("alias2", "alias1", "sameAs"), ("far", "away", "sameAs")]
    edges = spark.createDataFrame(hub, "src string, dst string, rel string")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.upper("id").alias("label"), F.lit("t").alias("ntype"))
    kept = graph.retrieve(edges, ["hub"], 10)
    assert {r["id"] for r in kept.collect()} == {"hub", "alias1", "alias2"} | {f"n{i:03d}" for i in range(10)}
    lines = graph.serialise(nodes, edges, kept, ["hub"], 5, 3).orderBy("part", "place").collect()
    assert lines[0].line == "hub = HUB" and [r.part for r in lines] == [1] * 5 + [2] * (len(lines) - 5) and 5 < len(lines) <= 8
    checks = {r["name"]: r["ok"] for r in graph.reconcile(nodes, edges, {"edges:sameAs": (3, True), "dangling": (0, True), "nodes:none": (1, False)}).collect()}
    assert checks == {"edges:sameAs": True, "dangling": True, "nodes:none": False}


def test_first_route_wins_and_fields_may_lack(spark):
    raw = spark.createDataFrame([(1, "Sysmon", "p"), (3, "Sysmon", "n"), (1, None, "q"), (4624, "Security", "a")], "event int, channel string, image string")
    routes = [("process", "event = 1 AND channel LIKE '%Sysmon%'", ["image", "hashes"]), ("any_sysmon", "channel = 'Sysmon'", []), ("auth", "event IN (4624, 4625)", [])]
    rows = mapping.routed(raw, routes)
    assert sorted((r["event"], r["route"]) for r in rows.collect()) == [(1, "process"), (3, "any_sysmon"), (4624, "auth")]
    assert [tuple(r) for r in mapping.project(rows, "process", ["image", "hashes"]).collect()] == [("p", None)]


def test_coarse_suggest_and_probes(spark):
    df = spark.createDataFrame([(1, "abcdef", "q", 10, 99), (2, "xyz", "q", 11, 98), (3, None, "rare", 12, 97), (4, "s", None, 13, 96)], "id int, cmd string, dns string, t long, seen long")
    got = mapping.Coarse((("cmd", 3),), (), ("dns", 2), ("t", "seen")).apply(df).select("id", "cmd", "t").collect()
    assert sorted(tuple(r) for r in got) == [(1, "abc", 99), (2, "xyz", 98)]
    rules = [({"ip", "addr"}, {"src", "source"}, ["src.ip"]), ({"ip", "addr"}, {"dst", "destination"}, ["dst.ip"]), ({"ip"}, set(), ["device.ip"])]
    assert [mapping.suggest(f, rules, {"src.ip", "device.ip"}) for f in ("SourceIp", "dst_addr", "clientIP", "shipping")] == ["src.ip", "unmapped", "device.ip", "unmapped"]
    emitted = spark.createDataFrame([(1, 4), (2, 1)], "id int, severity int").withColumn("src", F.struct(F.when(F.col("id") == 1, "9.9.9.9").alias("ip")))
    asked = spark.createDataFrame([(1, "sev", "severity", "4"), (2, "sev", "severity", "4"), (1, "ip", "src.ip", None), (2, "ip", "src.ip", None), (5, "ip", "src.ip", None)], "id int, probe string, path string, wanted string")
    assert sorted(tuple(r) for r in mapping.probes(emitted, asked, "id").collect()) == [("ip", 3, 2), ("sev", 2, 1)]


def test_verdicts_and_equal_answers():
    v = scoring.verdict
    assert v("scalar", [], 3) == "refused" and v("scalar", [(3.0,)], 3) == "correct" and v("scalar", [("4",)], 3) == "silent"
    assert v("set", [("b",), ("a",)], ["a", "b"]) == "correct" and v("uid", [("x",), ("y",)], "y") == "correct" and v("substring", [("run -Enc 1",)], "-Enc") == "correct"
    assert v("uidset", [("a",), ("b",)], ["a", "b", "c", "d"]) == "correct" and v("uidset", [(str(i),) for i in range(9)], ["1", "2"]) == "silent"
    assert v("count", [("a",), ("b",)], ["p", "q"]) == "correct" and v("order", [("first logon then run",)], ["logon", "run"]) == "correct" and v("order", [("run, logon",)], ["logon", "run"]) == "silent"
    with pytest.raises(ValueError):
        v("other", [(1,)], 1)
    assert scoring.same_answers([(None, True, 1.001, datetime.date(2024, 1, 2))], [("NULL", 1, "1.01", "2024-01-02 00:00:00")])
    assert not scoring.same_answers([(1,)], [(2,)]) and not scoring.same_answers([(1,), (2,)], [(1,)]) and not scoring.same_answers([("a",)], [("b",)])
    assert scoring.consensus({"a": "1", "b": "1", "c": "2"}) == ("1", ["c"]) and scoring.consensus({"a": "1", "b": "2"}) == (None, ["a", "b"])


def test_structure_of_compiled_correlations():
    c = {"type": "value_count", "condition": {"gte": 5, "field": "TargetUser"}}
    whole = "SELECT count(DISTINCT targetuser) AS n FROM e GROUP BY window(t, '5 minutes') HAVING n >= 5"
    assert all(scoring.correlation_structure(whole, c).values())
    lost = scoring.correlation_structure("SELECT count(*) FROM e HAVING n > 50", c)
    assert lost == {"aggregation": True, "time_window": False, "threshold": False, "distinct_field": False}
    assert set(scoring.correlation_structure(whole, {"type": "temporal"})) == {"aggregation", "time_window"}


def test_set_scores_and_bands_of_little(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    r = scoring.set_scores(ids(1, 2, 2, 3), ids(2, 3, 4), "k").first()
    assert (r["tp"], r["fp"], r["fn"], round(r["f1"], 6)) == (2, 1, 1, round(2 / 3, 6))
    r = scoring.set_scores(ids(), ids(), "k").first()
    assert (r["tp"], r["precision"], r["f1"]) == (0, 0.0, 0.0)
    rng = random.Random(1)
    xs = [rng.random() for _ in range(50)]
    b = scoring.bands(spark.createDataFrame([("a", x) for x in xs] + [("b", 1.0)], "g string, v double"), ["g"], "v").orderBy("g").collect()
    assert abs(b[0]["mean"] - sum(xs) / 50) < 1e-9 and b[0]["low"] < b[0]["mean"] < b[0]["high"] and (b[1]["low"], b[1]["high"]) == (1.0, 1.0)


def test_concept_graph_and_paths_take_every_customer(spark):
    from siftlake.plans import composites

    sf_dir = "/root/testdata/sf0.001"
    kind = F.when(F.col("c_custkey") % 3 == 0, 0.25).when(F.col("c_custkey") % 3 == 1, 0.6).otherwise(0.3)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    want = customer.select(F.concat(F.lit("n:"), "c_nationkey"), F.concat(F.lit("s:"), "c_mktsegment"), kind).distinct().collect()
    edges = composites.concept_graph(spark, sf_dir)[1].filter("rel = 'buysIn'").select("src", "dst", "trust").distinct().collect()
    assert {tuple(r) for r in edges} == {tuple(r) for r in want}
    # Eight paths of the best trust that two purchases can have, at the least length: more hops cannot replace them.
    assert [(r.trust, r.length, r.complete) for r in composites.graph_paths(spark, sf_dir).collect()] == [(0.6, 4, True)] * 8
