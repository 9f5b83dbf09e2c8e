"""Exact deduplication by a keyed state that streams fill and that never expires.

Every row sends its digest, its identifier and a locator of its content (file and row number) to a
streaming aggregation whose state store (RocksDB: on disk, checkpointed to the shared folder) keeps,
for each digest, the winner's identifier and locator and the count. A digest that is met again is a
hit. Hits are then checked byte for byte: the locators pick both texts while their files are scanned, and
rows whose bytes differ from the winner's although the digests agree are grouped by the text itself.
No other text leaves its task.

Everything runs on DataFrame operations. A hot digest is one row per map task before the state's
shuffle; the join that checks bytes spreads a large group over salts, so no task gets the group.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, located, picked, scratch, settle, text_of

#: Members of one group that one task compares with a copy of the winner's text.
GROUP_PER_TASK = 512
#: Files that one micro-batch takes from the table of digests.
FILES_PER_BATCH = 4096
#: The state lies on disk; its files take the room that they need, without preallocation, and its memory is bounded.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Executors close a partition's state when its batch is committed, instead of keeping it open for the next batch.
CLOSED = {"spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def observe(stream: DataFrame, state_dir: str, batches: int = 2) -> None:
    """Takes all that the stream has now into the state at state_dir; called again, it goes on from there.

    stream: streaming rows (digest binary, ident struct<doc_id, file, row>); batches: how many it will take, at
    least. After a single one the state does not stay open in the executors' memory.
    """
    spark = stream.sparkSession
    seen = stream.groupBy("digest").agg(F.max("ident").alias("winner"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, STATE | (CLOSED if batches == 1 else {})):
        query = (
            seen.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def state_of(spark: SparkSession, state_dir: str) -> DataFrame:
    """(digest, winner, n) as the state holds them."""
    with _settings(spark, STATE):
        state = spark.read.format("statestore").load(state_dir)
    names = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key").getField(state.schema["key"].dataType.fieldNames()[0]).alias("digest"),
        F.col("value").getField(names[0]).alias("winner"),
        F.col("value").getField(names[1]).alias("n"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, file, row.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The row with
    the largest id stays (a null id is less than any other); of rows that repeat that id, the one that
    lies last (file, row number) stays. An empty table gives an empty result. Other columns of docs,
    whatever their names, are not looked at. Texts may be as long as a Spark string can be.
    """
    return _groups(located(docs, "dedup-docs"), id_col, text_col)


def _groups(spots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = spots.sparkSession
    texts = _texts(spots, id_col, text_col)
    rows = settle(texts.select(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), "ident"), "digests")
    if rows.isEmpty():
        return _named(rows.select("ident", F.col("ident").alias("winner"), F.lit(1).cast("long").alias("n"), "digest"))

    state_dir = scratch(spark, "dedup-state")
    files = rows.inputFiles()
    path = files[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    observe(stream, state_dir, -(-len(files) // FILES_PER_BATCH))
    state = settle(state_of(spark, state_dir), "dedup-winners")
    hits = settle(rows.join(state.filter("n > 1"), "digest"), "dedup-hits")
    met = _texts(picked(spots, hits.select("ident.file", "ident.row")), id_col, text_col)

    different = _different(met, hits)
    marked = rows.join(state, "digest").select("ident", "winner", "n", "digest")
    if different.isEmpty():
        return _named(marked)
    return _named(_regrouped(met, marked, different))


def _texts(spots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    field = F.col("doc").getField
    return spots.select(ascii_lower(text_of(field(text_col))).alias("text"), F.struct(field(id_col).alias("doc_id"), "file", "row").alias("ident"))


def _different(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Idents of hits whose bytes are not those of their digest's winner; texts: those of the hits."""
    found = hits.select("ident", "digest", "winner", F.ceil(F.col("n") / GROUP_PER_TASK).cast("int").alias("salts")).join(texts, "ident")
    is_winner = F.col("ident") == F.col("winner")
    winners = found.filter(is_winner).select(
        "digest", F.col("text").alias("winner_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    members = found.filter(~is_winner).withColumn("salt", F.pmod(F.xxhash64("ident"), F.col("salts")).cast("int"))
    return settle(members.join(winners, ["digest", "salt"]).filter("text <> winner_text").select("ident"), "dedup-collisions")


def _regrouped(texts: DataFrame, marked: DataFrame, different: DataFrame) -> DataFrame:
    """marked with the rows of a digest that two texts share grouped by text."""
    shared = marked.join(different, "ident", "left_semi").select("digest").distinct()
    apart = marked.join(shared, "digest", "left_semi").join(texts, "ident")
    groups = apart.groupBy("digest", "text").agg(F.max("ident").alias("winner"), F.count(F.lit(1)).alias("n"))
    again = apart.drop("winner", "n").join(groups, ["digest", "text"]).select("ident", "winner", "n", "digest")
    return marked.join(shared, "digest", "left_anti").unionByName(again)


def _named(marked: DataFrame) -> DataFrame:
    return marked.select(
        F.col("ident.doc_id").alias("doc_id"),
        F.col("winner.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("ident.file") == F.col("winner.file")).__and__(F.col("ident.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("ident.file").alias("file"),
        F.col("ident.row").alias("row"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() does not keep; columns as they were. Documents are not shuffled."""
    spots = located(docs, "dedup-docs")
    gone = _groups(spots, id_col, text_col).filter("NOT kept").select("file", "row")
    return picked(spots, gone, inside=False).select("doc.*")
