"""Shared scratch tables, row locators and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this run that driver and executors all reach; it is deleted when the process ends.

    It lies below ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a temporary
    folder; a cluster gets one below the warehouse if that names a store that is not the machine's own.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and (sc.master.startswith("local[") or sc.master == "local"):
            base = tempfile.mkdtemp(prefix="siftlake-")
        if not base:
            base = spark.conf.get("spark.sql.warehouse.dir")
            scheme = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()
            if scheme == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{base.rstrip('/')}/siftlake-{uuid.uuid4().hex}"
        _ROOTS[sc.applicationId] = root
        atexit.register(_remove, spark, root)
    return _ROOTS[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table or state folder of this run."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of an Arrow batch while a table is settled, unless the session has a number of its own.
BATCH_ROWS, _BATCH = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    Texts may be long, so Arrow batches have few rows meanwhile; the session's setting is then as it was.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_BATCH)
    if int(before) == 10_000:  # Spark's default
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly that name, whatever dots or spaces it has."""
    return df["`" + name.replace("`", "``") + "`"]


def located(df: DataFrame, name: str) -> DataFrame:
    """df as (doc: struct of all its columns, file: string, row: long), a lasting locator per row.

    Files that Spark scans have one already, also where a column of theirs is named _metadata; any other
    frame is written to the shared folder first.
    """
    def scan(d: DataFrame) -> DataFrame:
        cols = F.struct(*[column(d, c).alias(c) for c in d.columns]).alias("doc")
        place = d.metadataColumn("_metadata")
        return d.select(cols, place.getField("file_path").alias("file"), place.getField("row_index").alias("row"))

    try:
        out = scan(df)
        _ = out.schema
        return out
    except AnalysisException:
        return scan(settle(df, name))


#: Rows that one cell of a bitmap stands for (a fixed value of Spark's bitmap functions), cells that are broadcast at once.
CELL, CELLS_AT_ONCE = 32768, 8192


def picked(spots: DataFrame, wanted: DataFrame, inside: bool = True, cells_at_once: int = CELLS_AT_ONCE) -> DataFrame:
    """Rows of spots (doc, file, row) whose locator is among wanted's (or is not); spots are not shuffled.

    wanted's locators become bitmaps, 4 KB for 32,768 rows of a file, which the scan looks at. At most
    cells_at_once bitmaps (32 MB) are broadcast together: where there are more, ranges of files, and of
    rows within a file, are scanned one after the other, each with its own bitmaps.
    """
    spark = spots.sparkSession
    cells = wanted.groupBy("file", F.expr(f"row div {CELL}").alias("cell")).agg(F.bitmap_construct_agg(F.expr(f"row % {CELL}")).alias("bits"))
    cells = settle(cells, "bitmaps")
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(pos div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(pos % 8 AS INT))")) != 0, F.lit(False))

    def held(part: DataFrame, own: DataFrame) -> DataFrame:
        asked = part.withColumn("cell", F.expr(f"row div {CELL}")).join(F.broadcast(own), ["file", "cell"], "left")
        asked = asked.withColumn("pos", F.expr(f"row % {CELL}"))
        return asked.filter(bit if inside else ~bit).select("doc", "file", "row")

    if cells.count() <= cells_at_once:
        return held(spots, cells)
    sizes = sorted((r.file, r.top) for r in cells.groupBy("file").agg(F.max("cell").alias("top")).collect())  # a row per file
    parts, low, room = [], (None, None), cells_at_once

    def within(frame: DataFrame, at, high) -> DataFrame:
        if low[0] is not None:
            frame = frame.filter(F.col("file") >= low[0]).filter((F.col("file") > low[0]) | (at >= low[1]))
        if high is not None:
            frame = frame.filter(F.col("file") <= high[0]).filter((F.col("file") < high[0]) | (at < high[1]))
        return frame

    def cut(high) -> None:
        nonlocal low, room
        parts.append(held(within(spots, F.expr(f"row div {CELL}"), high), within(cells, F.col("cell"), high)))
        low, room = high, cells_at_once

    for file, top in sizes:
        at = 0
        while top + 1 - at > room:
            at += room
            cut((file, at))
        room -= top + 1 - at
    cut(None)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_of(col: Column) -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone; texts of ASCII only take the faster way to the same result."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 512):
    """Arrow batches cut to a few rows each: texts may be long, and Python's copies of them are larger."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Collects this process's garbage and gives freed memory back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(spark: SparkSession) -> None:
    """Lets go of what finished steps have left on the driver: Python's objects, then the JVM's references to shuffles and
    broadcasts, which Spark removes everywhere once they are collected, then what the JVM has freed outside its heap."""
    trim()
    spark._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """Gives freed memory outside the heap of the driver's JVM (compilers, codecs) back to the system, as trim() does for
    Python; the C library keeps it for each thread otherwise, beside a heap that is bounded."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    java = jvm.java.lang

    def array(kind, *items):
        out = new(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:  # by reflection, as the server's own class is not open
        kinds = [java.Class.forName(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        call = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *kinds))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call.invoke(java.management.ManagementFactory.getPlatformMBeanServer(),
                    array(java.Object, command, "systemTrimNativeHeap", array(java.Object), array(java.String)))
    except Py4JError:  # another JVM or C library
        pass


def tidy_executors(spark: SparkSession, workers: bool = False) -> None:
    """A short task on each core: the executor's JVM collects its garbage.

    A heap that has grown in one step stays that large otherwise, beside the workers of the next. With workers, each
    core's Python worker forgets its encoders and gives freed memory back too; without, no Python runs on executors.
    """
    def run(batches):
        from . import tokens

        tokens.forget()
        trim()
        yield from batches

    n = spark.sparkContext.defaultParallelism
    cores = spark.range(0, n, 1, n)
    if workers:
        cores = cores.mapInArrow(run, "id long")
    cores.select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def forget(*tables: DataFrame) -> None:
    """Deletes tables that settle() wrote and that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _remove(t.sparkSession, path)
