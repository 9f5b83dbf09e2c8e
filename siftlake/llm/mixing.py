"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Sizes are words. Targets share a budget by weight; a target stops at `cap` times its source's size
   and the excess is shared again, which is water-filling, solved in closed form over the sources.
2. Each source is one stream of words: its documents in a shuffled order (by hash), cut into blocks of
   equal size (the last may be shorter). Start offsets are two-level prefix sums, so no task ever
   holds a source.
3. Slot t of the mix draws the golden-ratio point frac(t * phi) and goes to the source in whose
   interval of cumulative weights the point lies. The k-th slot of a source (ranked in two levels,
   too) is joined to its k-th block, the second pass over a source following the first.
4. A document has what the slots take of its blocks.

Only DataFrame operations; nothing but the number of slots comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import located, picked, settle, text_of

#: ASCII white space is what separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of one block, prefix buckets of one source, slots ranked in one task, cells of the interval [0, 1).
BLOCK, BUCKETS, SLOTS_PER_TASK, CELLS = 256, 65536, 4096, 4096
#: Prefix sums that one task makes at a time, rows of one id that lie together in the order.
TOGETHER, REPEATS = 256, 1024
#: Golden-ratio points as t * STEP mod MODULUS (a prime; STEP is MODULUS / phi, rounded): exact in longs.
MODULUS, STEP = 2147483647, 1327217885
WEIGHTS = (5.0, 2.0, 1.0)


@dataclass(frozen=True)
class Mix:
    """takes: a row per document; slots: the schedule; sources: sizes and targets."""

    takes: DataFrame
    slots: DataFrame
    sources: DataFrame


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ahead(df: DataFrame, key: list[str], at: str, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over the rows of the same key whose `at` (a number of its own from 0 on) is less.

    In two levels: windows see TOGETHER rows, or a row per TOGETHER of them.
    """
    df = df.withColumn("stretch", F.expr(f"`{at}` div {TOGETHER}"))
    whole = df.groupBy(*key, "stretch").agg(F.sum(value).alias("whole"))
    of_key = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*key, "stretch", F.coalesce(F.sum("whole").over(of_key), F.lit(0)).alias("earlier"))
    inner = Window.partitionBy(*key, "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(base, [*key, "stretch"])
    return df.withColumn(name, F.col(name) + F.col("earlier")).drop("stretch", "earlier")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(no_source, source, source_size) with weight and target: water-filling under the caps.

    A window over all sources: a row per source, not per document.
    """
    order = Window.orderBy("no_source", "source")
    which = (F.row_number().over(order) - 1) % len(weights) + 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), which.cast("int")))
    s = s.withColumn("most", (F.col("source_size") * cap).cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "no_source", "source")
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum(F.col("source_size").cast("double")).over(everyone) * share
    s = s.withColumn("level", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    s = s.withColumn("level", F.max(free).over(everyone))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return s.select("no_source", "source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2, block: int = BLOCK, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of docs: takes has a row per row of docs (doc_id, source, size, source_size, target, taken).

    size: words of the text (null: 0); taken: words that the mix takes, repeats counted, at most `cap`
    times the size. Sources are ordered by code point, null last; weights repeat over them. Texts
    without words take nothing; an empty table gives empty results. Repeated rows are separate
    documents. Same files, same result.
    """
    return _mix(located(docs, "mix-docs"), weights, share, cap, block, seed, id_col, text_col, source_col)


def _mix(spots: DataFrame, weights=WEIGHTS, share=1.5, cap=2, block=BLOCK, seed=0, id_col="doc_id", text_col="text", source_col="source") -> Mix:
    spark = spots.sparkSession
    field = F.col("doc").getField
    source = field(source_col).cast("string")
    rows = settle(
        spots.select(
            field(id_col).alias("doc_id"),
            source.isNull().alias("no_source"),
            F.coalesce(source, F.lit("")).alias("source"),
            word_count(text_of(field(text_col))).alias("size"),
            F.struct("file", "row").alias("rid"),
        ),
        "mix-sizes",
    )
    key = ["no_source", "source"]
    # An id's hash, whatever files its row lies in; rows of an id that very many have get places of their own.
    often = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > REPEATS) & F.col("doc_id").isNotNull())
    rows = rows.join(often, "doc_id", "left")
    alone = F.col("doc_id").isNull() | F.col("rows").isNotNull()
    place = F.when(alone, F.xxhash64(F.lit(seed), "doc_id", "rid")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.withColumn("place", place).drop("rows").withColumn("bucket", F.shiftrightunsigned("place", 64 - (BUCKETS - 1).bit_length()))
    per_bucket = settle(rows.groupBy(*key, "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sizes = per_bucket.groupBy(*key).agg(F.sum("words").alias("source_size"))
    sources = source_targets(sizes, weights, share, cap)
    sources = sources.withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * cap))
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    live = F.col("source_size") > 0
    passes = F.when(live, F.expr("goal div source_size")).otherwise(0)
    rest = F.when(live, F.expr("goal % source_size")).otherwise(0)
    sources = sources.withColumn("blocks", blocks).withColumn("slots", passes * blocks + F.ceil(rest / F.lit(block)).cast("long"))
    up_to = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sources = sources.withColumn("hi", F.sum("slots").over(up_to)).withColumn("lo", F.col("hi") - F.col("slots"))
    sources = settle(sources, "mix-sources")

    starts = ahead(per_bucket, key, "bucket", "words", "base").drop("words")
    starts = starts.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, key).select(
        *key, "bucket", "base", "source_size", "target"
    )
    within = Window.partitionBy(*key, "bucket").orderBy("place", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, [*key, "bucket"])
    spans = spans.withColumn("start", F.col("base") + F.col("ahead")).withColumn("end", F.col("start") + F.col("size"))

    slots = _schedule(spark, sources, key)
    at = (F.col("rank") % F.col("blocks")).alias("block")
    epoch = F.expr("rank div blocks")
    lasts = F.least(F.lit(block) * (at + 1), F.col("goal") - epoch * F.col("source_size"))
    takes = (
        slots.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, key)
        .select(*key, at, lasts.alias("until"))
        .groupBy(*key, "block").agg(F.collect_list("until").alias("untils"))  # one for each pass: cap at most
    )
    last_block = F.greatest(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))
    pieces = spans.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), last_block))))
    lo = F.greatest("start", F.col("block") * block)
    hi = F.least("end", (F.col("block") + 1) * block)
    words = F.aggregate("untils", F.lit(0).cast("long"), lambda a, u: a + F.greatest(F.lit(0), F.least(hi, u) - lo))
    taken = (
        pieces.join(takes, [*key, "block"], "left").select("rid", words.alias("words"))
        .groupBy("rid").agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"))
    )
    out = spans.join(taken, "rid").select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "taken", "rid"
    )
    return Mix(out, slots, sources)


def _schedule(spark, sources: DataFrame, key: list[str]) -> DataFrame:
    """(t, source, rank): slots in the order of the mix; each source has just the slots that fill its goal."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    point = (F.col("id") % MODULUS * STEP) % MODULUS / F.lit(float(MODULUS))
    drawn = spark.range(total).select(F.col("id").alias("t"), (point * total).alias("x"))
    per = max(1.0, total / CELLS)
    cells = sources.filter("slots > 0").select(
        *key, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / per), F.floor(F.col("hi") / per))).alias("cell")
    )
    drawn = drawn.withColumn("cell", F.floor(F.col("x") / per)).join(cells, "cell").filter("x >= lo AND x < hi")
    drawn = drawn.select("t", *key, F.expr(f"t div {SLOTS_PER_TASK}").alias("chunk"))
    per_chunk = drawn.groupBy(*key, "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = ahead(per_chunk, key, "chunk", "n", "base").drop("n")
    ranked = drawn.join(base, [*key, "chunk"]).withColumn(
        "rank", F.col("base") + F.row_number().over(Window.partitionBy(*key, "chunk").orderBy("t")) - 1
    )
    wanted = sources.select(*key, "slots")
    small = sources.count() <= 10_000
    ranked = ranked.join(F.broadcast(wanted) if small else wanted, key).filter("rank < slots").select("t", *key, "rank")
    got = per_chunk.groupBy(*key).agg(F.sum("n").alias("got"))
    short = wanted.join(got, key, "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    filled = short.select(F.lit(total).alias("t"), *key, F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(filled)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each as often as it is taken whole, columns as they were.

    Of a document that the end of a source's goal cuts, the greater part decides. Documents are not
    shuffled: what is taken k times or more is picked from the files for each k up to the cap.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    spots = located(docs, "mix-docs")
    kept = settle(_mix(spots, **how).takes.select("rid.file", "rid.row", times.alias("times")).filter("times > 0"), "mix-times")
    out = picked(spots, kept)
    for k in range(2, (kept.agg(F.max("times")).first()[0] or 0) + 1):
        out = out.unionByName(picked(spots, kept.filter(F.col("times") >= k)))
    return out.select("doc.*")
