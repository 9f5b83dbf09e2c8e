"""Structured Streaming: windows over late events, deduplication, panels, filters and ordered sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.operators.panels import Panel
from siftlake.sources.logtable import LogTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Runs a stream over what there is, into files, exactly once."""
    stream.writeStream.outputMode(mode).format(fmt).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, do: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def commits(stream: DataFrame, checkpoint: str, table: LogTable, name: str) -> list[dict]:
    """Appends every batch to a log table as one version; (batch, version, rows visible, seconds) of each, in order.

    A batch that runs again after a failure is not added twice: the table knows the last batch of each stream.
    """
    import time as clock

    done = []

    def add(df: DataFrame, batch: int) -> None:
        began = clock.perf_counter()
        version = table.append(df, (name, batch))
        took = clock.perf_counter() - began
        done.append({"batch": batch, "version": version, "visible": table.read(version).count(), "seconds": took})

    each_batch(stream, checkpoint, add)
    return done


def event_time(df: DataFrame, column: str) -> DataFrame:
    """A watermark needs a timestamp with a zone; naive times count as the session's (UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(stream: DataFrame, time: str, keys: list[str], size: str = "5 minutes", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts by event-time window; rows later than `late` behind the watermark are dropped."""
    win = F.window(time, size, slide) if slide else F.window(time, size)
    out = event_time(stream, time).withWatermark(time, late).groupBy(win.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = event_time(stream, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(stream: DataFrame, time: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    return event_time(stream, time).withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def maintained(stream: DataFrame, checkpoint: str, panel: Panel, publish: Callable[[DataFrame], None]) -> None:
    """Keeps a panel in the state of a streaming aggregation; each batch publishes the rows that changed."""
    each_batch(panel.partial(stream), checkpoint, lambda df, _: publish(df), mode="update")


def survivors(raw: DataFrame, column: str, dropped: list[str]) -> DataFrame:
    """The drop-filter route: rows whose column is not one of the dropped values; a null stays."""
    return raw.filter(~F.coalesce(F.col(column).isin(*dropped), F.lit(False)))


def ordered_sequences(stream: DataFrame, time: str, key: str, kind: str, steps: list[str], span_s: int, late_s: int = 3600) -> DataFrame:
    """(key, start, at) whenever the steps occur in order within the span, by keyed state that times out with event time.

    The state holds, for each step, the greatest start of a chain that has got so far, and the rows that the
    watermark has not passed. Those are taken in order of time once it has, so events may come out of order
    in any batches, as long as they are no later than `late_s`; a key's state goes when nothing of it can
    count any more.
    """
    out_schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("start", T.LongType()), T.StructField("at", T.LongType())])
    state_schema = T.StructType([
        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("kinds", T.ArrayType(T.StringType())),
    ])

    def run(k, batches, state):
        import pandas as pd

        held = state.get if state.exists else ([None] * len(steps), [], [])
        starts, waiting = list(held[0]), list(zip(held[1], held[2]))
        for rows in batches:  # none when the time is up
            waiting += [(int(t), what) for t, what in zip(rows["_t"], rows["_kind"]) if what in steps]
        passed = state.getCurrentWatermarkMs() // 1000  # no row of an earlier second will come
        ready = sorted((t, steps.index(what), what) for t, what in waiting if t < passed)
        waiting = [(t, what) for t, what in waiting if t >= passed]
        found, i = [], 0
        while i < len(ready):  # rows of one second see what was there before that second
            j, before = i, list(starts)
            while j < len(ready) and ready[j][0] == ready[i][0]:
                j += 1
            t = ready[i][0]
            for what in dict.fromkeys(r[2] for r in ready[i:j]):
                for n in [n for n, s in enumerate(steps) if s == what]:
                    start = t if n == 0 else before[n - 1]
                    if start is not None and t - start <= span_s:
                        starts[n] = start if starts[n] is None else max(starts[n], start)
                        if n == len(steps) - 1:
                            found.append((k[0], start, t))
            i = j
        starts = [s if s is not None and s + span_s >= passed else None for s in starts]
        if waiting or any(s is not None for s in starts):
            state.update((starts, [t for t, _ in waiting], [w for _, w in waiting]))
            due = min([t + 1 for t, _ in waiting] + [s + span_s + 1 for s in starts if s is not None])
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, due * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["key", "start", "at"])

    rows = event_time(stream, time).withWatermark(time, f"{late_s} seconds")
    rows = rows.withColumn("_t", F.unix_seconds(time)).select(F.col(key).cast("string").alias("_key"), "_t", F.col(kind).alias("_kind"), time)
    return rows.groupBy("_key").applyInPandasWithState(run, out_schema, state_schema, "append", "EventTimeTimeout")
