"""Load at a fixed schedule: queries are due at set times and their latency counts from then, not from when they could start."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "shape string, number int, due_s double, waited_s double, latency_s double, failed boolean, error string"


def schedule(shapes: list[str], cycle_s: float, cycles: int, every_s: float | None = None, probe: str = "probe") -> list[tuple[float, str]]:
    """(seconds from the start, shape): the shapes spread evenly over each cycle, a probe every every_s besides."""
    due = [(c * cycle_s + k * cycle_s / len(shapes), s) for c in range(cycles) for k, s in enumerate(shapes)]
    if every_s:
        due += [(k * every_s, probe) for k in range(math.ceil(cycles * cycle_s / every_s))]
    return sorted(due)


def drive(spark: SparkSession, due: list[tuple[float, str]], run: dict[str, Callable[[random.Random], DataFrame]], workers: int = 8, seed: int = 0) -> DataFrame:
    """Runs every query of the schedule and returns a row for each: SCHEMA.

    Nothing is skipped when the cluster falls behind: a query waits for a worker, and its wait is part of
    its latency. Each shape has a scheduler pool of its own, so that with spark.scheduler.mode=FAIR a probe
    shares the executors with the load instead of standing behind it. Parameters come from a generator
    seeded by the query's number; a repeated run asks the same.
    """
    began = time.perf_counter()

    def one(number: int, at: float, shape: str):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", shape)
        start, error = time.perf_counter() - began, None
        try:
            run[shape](random.Random(f"{seed}-{number}")).write.format("noop").mode("overwrite").save()
        except Exception as e:  # a failed query is a result of the run
            error = f"{type(e).__name__}: {e}"[:300]
        return shape, number, at, max(0.0, start - at), time.perf_counter() - began - at, error is not None, error

    with ThreadPoolExecutor(workers) as pool:
        sent = []
        for number, (at, shape) in enumerate(sorted(due)):
            time.sleep(max(0.0, began + at - time.perf_counter()))
            sent.append(pool.submit(one, number, at, shape))
        done = [f.result() for f in sent]
    return spark.createDataFrame(done, SCHEMA)


def latencies(runs: DataFrame) -> DataFrame:
    """(shape, runs, failures, p50, p95, p99, worst) by nearest rank, of the queries that came to an end."""
    ok = F.expr("CASE WHEN NOT failed THEN latency_s END")
    ranks = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY CASE WHEN NOT failed THEN latency_s END)").alias(f"p{p}") for p in (50, 95, 99)]
    return runs.groupBy("shape").agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"), *ranks, F.max(ok).alias("worst"))
