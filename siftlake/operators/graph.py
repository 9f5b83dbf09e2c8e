"""Property graphs as two DataFrames: nodes (id, ntype, label) and edges (src, dst, rel, trust_class)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import persisted, resolve

UNKNOWN_TRUST, WEAK = 0.30, 0.25


def merge_nodes(hops: list[DataFrame]) -> DataFrame:
    """Nodes of all hops; of an id that several have, the first hop's counts."""
    every = None
    for i, h in enumerate(hops):
        h = h.withColumn("hop", F.lit(i))
        every = h if every is None else every.unionByName(h, allowMissingColumns=True)
    first = Window.partitionBy("id").orderBy("hop", "label")
    return every.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "hop")


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "rel", "trust_class"])


def with_trust(edges: DataFrame, trust: dict[str, float]) -> DataFrame:
    """edges with their trust: that of the class, UNKNOWN_TRUST for others."""
    table = F.create_map(*[F.lit(x) for kv in trust.items() for x in kv]) if trust else None
    value = F.coalesce(table[F.col("trust_class")], F.lit(UNKNOWN_TRUST)) if trust else F.lit(UNKNOWN_TRUST)
    return edges.withColumn("trust", value)


def find(nodes: DataFrame, text: str, most: int = 50) -> DataFrame:
    """Nodes by exact id, id without its prefix, label, or part of a label; the best kind of match only."""
    low = text.lower()
    rank = (
        F.when(F.col("id") == text, 0).when(F.col("id").endswith(":" + text), 1)
        .when(F.lower("label") == low, 2).when(F.lower("label").contains(low), 3)
    )
    hits = nodes.withColumn("rank", rank).filter("rank IS NOT NULL")
    best = hits.agg(F.min("rank").alias("best"))
    return hits.join(F.broadcast(best), F.col("rank") == F.col("best")).drop("best").orderBy("rank", "id").limit(most)


def neighbours(edges: DataFrame, node: str, direction: str = "both", rel_prefix: str = "", min_trust: float = 0.0) -> DataFrame:
    kept = edges.filter(F.col("rel").startswith(rel_prefix) & (F.col("trust") >= min_trust))
    out = kept.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "rel", "trust")
    back = kept.filter(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "rel", "trust")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def descendants(edges: DataFrame, root: str, rel: str = "subClassOf", most: int | None = None) -> DataFrame:
    """(id, depth) of everything below root along rel (child -> parent edges), to the last level; cycles end.

    most bounds the levels; a graph that goes on below them raises.
    """
    up = edges.filter(F.col("rel") == rel).select(F.col("src").alias("child"), F.col("dst").alias("id"))
    spark = edges.sparkSession
    seen = front = spark.createDataFrame([(root, 0)], "id string, depth int")
    d = 0
    while True:
        d += 1
        new = front.join(up, "id").select(F.col("child").alias("id")).distinct().join(seen, "id", "left_anti")
        new = persisted(new.withColumn("depth", F.lit(d)))
        if new.isEmpty():
            return seen
        if most is not None and d > most:
            raise RuntimeError(f"more than {most} levels below {root}")
        seen, front = persisted(seen.unionByName(new)), new


def paths(edges: DataFrame, source: str, target: str, hops: int = 6, most: int = 8, min_trust: float = 0.0, budget: int = 250_000) -> DataFrame:
    """The most trusted simple paths between two nodes, edges taken either way.

    (path, rels, trust: that of the weakest edge, weakest_hop, length, crosses_inference), by trust,
    then length, then path. Each hop extends every open path; when more than `budget` are open, the
    most trusted stay and `complete` is false. What one task extends is cut to the budget before it is
    written: only paths that at least `budget` others of the same task precede are left out, none of
    which could stay.
    """
    both = edges.select("src", "dst", "rel", "trust").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "trust"))
    both = persisted(both.filter(F.col("trust") >= min_trust))
    spark = edges.sparkSession
    open_ = spark.createDataFrame([([source], [], 1.0, 0, source)], "path array<string>, rels array<string>, trust double, weakest_hop int, src string")
    done, complete = None, True
    for hop in range(1, hops + 1):
        step = open_.withColumnRenamed("trust", "so_far").join(both, "src").filter(~F.array_contains("path", F.col("dst")))
        weaker = F.col("trust") < F.col("so_far")
        step = step.select(
            F.concat("path", F.array("dst")).alias("path"), F.concat("rels", F.array("rel")).alias("rels"),
            F.least("so_far", "trust").alias("trust"), F.when(weaker | (F.col("weakest_hop") == 0), F.lit(hop)).otherwise(F.col("weakest_hop")).alias("weakest_hop"),
            F.col("dst").alias("src"),
        )
        order = [F.desc("trust"), "path", "rels"]
        found = persisted(step.filter(F.col("src") == target).orderBy(*order).limit(budget))
        done = found if done is None else done.unionByName(found)
        if hop == hops:
            break
        # One more than the budget tells whether there were more; limit() bounds what a task sends.
        open_ = persisted(step.filter(F.col("src") != target).orderBy(*order).limit(budget + 1))
        n = open_.count()
        if n == 0:
            break
        if n > budget:
            complete = False
            open_ = persisted(open_.orderBy(*order).limit(budget))
    return done.select(
        "path", "rels", "trust", "weakest_hop", F.size("rels").alias("length"), (F.col("trust") <= WEAK).alias("crosses_inference"),
        F.lit(complete).alias("complete"),
    ).orderBy(F.desc("trust"), "length", "path", "rels").limit(most)


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(id, similarity) of the k most similar vectors by cosine; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("vector", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    sim = F.when(norm > 0, dot / (norm * size)).otherwise(0.0)
    return vectors.select("id", F.round(sim, 9).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def fingerprint(nodes: DataFrame, edges: DataFrame) -> str:
    """A digest that does not depend on order or partitioning."""
    import hashlib

    def part(df):
        h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
        return df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 40))), F.lit(0))).first()

    return hashlib.sha256(repr([tuple(part(nodes)), tuple(part(edges))]).encode()).hexdigest()


def one_control(edges: DataFrame, is_control) -> DataFrame:
    """Edges of which exactly one end is a control, turned so that it is dst; is_control maps a column of ids to a boolean."""
    s, d = is_control(F.col("src")), is_control(F.col("dst"))
    one = edges.filter(s != d)
    turned = s & ~d
    src, dst = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
    return one.select(src.alias("src"), dst.alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]).distinct()


def reach(left: DataFrame, right: DataFrame, via: str) -> DataFrame:
    """left (a, via) to right (b, via): pairs (a, b) whose technique is equal, or equal without its part after the dot."""
    base = lambda c: F.split_part(F.col(c), F.lit("."), F.lit(1))
    x, y = left.withColumn("base", base(via)), right.withColumn("base", base(via))
    return x.select("a", "base").distinct().join(y.select("b", "base").distinct(), "base").select("a", "b").distinct()


def coverage(nodes: DataFrame, edges: DataFrame, technique: str) -> DataFrame:
    """(ntype, covered, best): how many nodes of each kind touch a technique, and their best trust."""
    near = neighbours(edges, technique).groupBy("id").agg(F.max("trust").alias("trust"))
    return near.join(nodes.select("id", "ntype"), "id").groupBy("ntype").agg(F.count(F.lit(1)).alias("covered"), F.max("trust").alias("best"))


def retrieve(edges: DataFrame, seeds: list[str], budget: int = 60, alias_rel: str = "sameAs") -> DataFrame:
    """(id) of the seeds, of the budget's share of each seed's neighbours in order of id, and of all their aliases, along chains of any length.

    The cut per seed is the feature: what is retrieved is read by someone. A hub's neighbours are ranked
    within salted parts before the parts' best are ranked together, so no task sorts them all.
    """
    spark = edges.sparkSession
    share = max(2, budget // max(1, len(seeds)))
    start = spark.createDataFrame([(s, s) for s in seeds], "seed string, id string")
    both = edges.select("src", "dst", "rel").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))
    near = both.join(F.broadcast(start.select(F.col("id").alias("src"), "seed")), "src").select("seed", F.col("dst").alias("id")).distinct()
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    part = Window.partitionBy("seed", salt).orderBy("id")
    best = near.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= share).drop("r")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).filter(F.col("r") <= share)
    kept = persisted(start.select("id").unionByName(best.select("id")).distinct())
    # Aliases are whole components, which chains of any length reach in rounds of their logarithm.
    alias = edges.filter(F.col("rel") == alias_rel).select("src", "dst").distinct()
    held = resolve(alias.select(F.explode(F.array("src", "dst")).alias("node"), F.struct("src", "dst").alias("key")))
    touched = held.join(kept.select(F.col("id").alias("node")), "node", "left_semi").select("cluster").distinct()
    return kept.unionByName(held.join(touched, "cluster", "left_semi").select(F.col("node").alias("id"))).distinct()


def serialise(nodes: DataFrame, edges: DataFrame, kept: DataFrame, seeds: list[str], most_nodes: int = 60, most_edges: int = 120) -> DataFrame:
    """(part, place, line): what is kept as lines to read, a row each: part 1 the nodes, part 2 the edges among them.

    Nodes are the seeds in their order, then the others by id; a line is "id = label" or "src [rel] dst". The
    caps are the feature: a reader has so much room. Lines are one ranked plan; nothing comes to the driver.
    """
    given = F.array(*[F.lit(s) for s in seeds]).cast("array<string>")
    rank = F.coalesce(F.nullif(F.array_position(given, F.col("id")), F.lit(0).cast("long")), F.lit(len(seeds) + 1).cast("long"))
    shown = nodes.join(kept, "id", "left_semi").withColumn("seed", rank).orderBy("seed", "id").limit(most_nodes)
    shown = persisted(shown.withColumn("place", F.row_number().over(Window.orderBy("seed", "id"))))  # most_nodes rows
    ends = F.broadcast(shown.select("id"))
    inner = edges.select("src", "rel", "dst").join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    inner = inner.distinct().orderBy("src", "rel", "dst").limit(most_edges).withColumn("place", F.row_number().over(Window.orderBy("src", "rel", "dst")))
    facts = shown.select(F.lit(1).alias("part"), "place", F.concat("id", F.lit(" = "), F.coalesce("label", F.lit(""))).alias("line"))
    return facts.unionByName(inner.select(F.lit(2).alias("part"), "place", F.concat("src", F.lit(" ["), "rel", F.lit("] "), "dst").alias("line")))


def event_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the event store's seven tables: hosts, addresses, users, endpoints, domains, roles, assets and every event.

    An event is a node of its own between who did it and what it touched; aliases of a machine are sameAs
    edges. One select per kind, united; of a node that several tables name one row stays.
    """
    def name(kind: str, column: str):
        return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))

    nodes, edges = [], []

    def node(table: str, kind: str, column: str, label=None, where: str = "true"):
        df = tables[table].filter(where).filter(F.col(column).isNotNull())
        text = label if label is not None else F.concat(F.lit(f"{kind} "), F.col(column).cast("string"))
        nodes.append(df.select(name(kind, column).alias("id"), F.lit(kind).alias("ntype"), text.alias("label")))

    def edge(table: str, src: tuple[str, str], rel: str, dst: tuple[str, str], where: str = "true"):
        df = tables[table].filter(where).filter(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull())
        edges.append(df.select(name(*src).alias("src"), F.lit(rel).alias("rel"), name(*dst).alias("dst")))

    node("asset", "host", "hostname")
    node("asset", "ip", "ip")
    node("asset", "asset", "canonical_asset")
    edge("asset", ("host", "hostname"), "sameAs", ("ip", "ip"))
    edge("asset", ("host", "hostname"), "sameAs", ("asset", "canonical_asset"))
    events = {
        "auth": (("user", "user_uid"), "authenticated", None, None, ["outcome", "is_remote"]),
        "session": (("user", "user_uid"), "opened", ("host", "host"), "on_host", ["start_time", "end_time"]),
        "network": (("host", "src_hostname"), "connected", ("ip", "dst_ip"), "to", ["dst_port", "bytes_out", "bytes_in", "duration"]),
        "dns": (("host", "src_hostname"), "queried", ("domain", "query_hostname"), "resolves", []),
        "process": (("host", "device_hostname"), "ran", None, None, ["image_name", "cmd_line"]),
        "api": (("user", "actor_user_uid"), "called", ("service", "service"), "on_service", ["api_operation", "mfa_present"]),
    }
    for table, (who, did, what, touched, facts) in events.items():
        label = F.concat_ws(" ", F.lit(table), *[F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in facts])
        node(table, table, "event_uid", label)
        node(table, who[0], who[1])
        edge(table, who, did, (table, "event_uid"))
        if what:
            node(table, what[0], what[1])
            edge(table, (table, "event_uid"), touched, what)
    node("api", "role", "actor_user_uid", where="api_operation = 'AssumeRole'")
    edge("api", ("user", "actor_user_uid"), "assumed", ("role", "actor_user_uid"), where="api_operation = 'AssumeRole'")

    def united(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # The label of an id depends on its kind alone, but for events, whose ids are their own.
    return united(nodes).groupBy("id", "ntype").agg(F.min("label").alias("label")), united(edges).distinct()


def stages(steps: list[DataFrame], labels: list[DataFrame | None]) -> DataFrame:
    """(stage, source, target, n): for a chain of step tables (src, dst), distinct steps between groups of nodes.

    labels[k] maps ids before step k (the last one: after the last step) to a group (id, grp); None leaves
    ids as they are. Steps are counted once a pair, before the groups are looked up.
    """
    def grouped(df: DataFrame, column: str, names: DataFrame | None, out: str) -> DataFrame:
        if names is None:
            return df.withColumn(out, F.col(column))
        return df.join(names.select(F.col("id").alias(column), F.col("grp").alias(out)), column)

    out = None
    for k, step in enumerate(steps):
        pairs = step.select("src", "dst").distinct()
        named = grouped(grouped(pairs, "src", labels[k], "source"), "dst", labels[k + 1], "target")
        part = named.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("stage"), "source", "target", "n")
        out = part if out is None else out.unionByName(part)
    return out


def reconcile(nodes: DataFrame, edges: DataFrame, expected: dict[str, tuple[int, bool]]) -> DataFrame:
    """(name, got, expected, hard, ok): counts "nodes", "edges", "nodes:TYPE", "edges:REL" and "dangling" against what they should be."""
    n = {f"nodes:{r['ntype']}": r["count"] for r in nodes.groupBy("ntype").count().collect()}
    e = {f"edges:{r['rel']}": r["count"] for r in edges.groupBy("rel").count().collect()}
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    got = n | e | {"nodes": sum(n.values()), "edges": sum(e.values()), "dangling": ends.join(nodes, "id", "left_anti").count()}
    rows = [(k, got.get(k, 0), v, hard, got.get(k, 0) == v) for k, (v, hard) in expected.items()]
    return edges.sparkSession.createDataFrame(rows, "name string, got long, expected long, hard boolean, ok boolean")
