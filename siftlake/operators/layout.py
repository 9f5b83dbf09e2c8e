"""Table layout: clustering on write, footer statistics, conservative pruning, storage accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.expressions import morton, scaled
from siftlake.sources.formats import footer_rows


def z_ordered(df: DataFrame, columns: list[str], partitions: int, bits: int = 16) -> DataFrame:
    """df in z-order of the (numeric) columns: ranges of the Morton key, sorted inside. One pass finds the columns' bounds."""
    bounds = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    dims = [scaled(F.col(c), bounds[f"lo_{i}"] or 0, bounds[f"hi_{i}"] or 0, bits) for i, c in enumerate(columns)]
    keyed = df.withColumn("_z", morton(dims, bits))
    return keyed.repartitionByRange(partitions, "_z").sortWithinPartitions("_z").drop("_z")


def row_groups(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """(file, row_group, rows, column, low, high, nulls) as footers have them; tasks open each file and read its footer alone."""

    def rows_of(name: str, meta):
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for k in range(group.num_columns):
                col = group.column(k)
                if col.path_in_schema in columns:
                    s = col.statistics
                    has = s is not None and s.has_min_max
                    yield {"file": name, "row_group": g, "rows": group.num_rows, "column": col.path_in_schema, "low": str(s.min) if has else None,
                           "high": str(s.max) if has else None, "nulls": s.null_count if s is not None and s.has_null_count else None}

    return footer_rows(spark, path, "file string, row_group int, rows long, column string, low string, high string, nulls long", rows_of)


def may_match(low: Column, high: Column, op: str, values: list, kind: str = "double") -> Column:
    """Whether a row group may hold a match; without statistics it may. kind: the type in which values are compared."""
    lo, hi = low.cast(kind), high.cast(kind)
    at = [F.lit(v).cast(kind) for v in values]
    tests = {
        "eq": lambda: (lo <= at[0]) & (hi >= at[0]),
        "range": lambda: (lo <= at[1]) & (hi >= at[0]),
        "in": lambda: F.exists(F.array(*at), lambda v: (v >= lo) & (v <= hi)),
    }
    return F.coalesce(tests[op](), F.lit(True))


def accounting(raw_bytes: int, stored_bytes: int, written_bytes: int, days: float = 1.0, capacity_bytes: int | None = None) -> dict[str, float]:
    """Compression, write amplification and drive writes per day."""
    out = {"compression": raw_bytes / stored_bytes if stored_bytes else 0.0, "write_amplification": written_bytes / raw_bytes if raw_bytes else 0.0}
    if capacity_bytes:
        out["drive_writes_per_day"] = written_bytes / days / capacity_bytes
    return out


def retention_cost(spark: SparkSession, gb_per_day: float, tiers: list[tuple[str, int, float]], days: int) -> DataFrame:
    """(day, tier, gb, cost): what lies in each tier (name, days it keeps, price of a GB and month) on each day."""
    rows, start = [], 0
    for name, keep, price in tiers:
        rows.append((name, start, start + keep, float(price)))
        start += keep
    plan = spark.createDataFrame(rows, "tier string, first int, last int, price double")
    held = plan.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    gb = F.greatest(F.lit(0), F.least("day", "last") - F.col("first")) * gb_per_day
    return held.select("day", "tier", gb.alias("gb"), F.round(gb * F.col("price") / 30, 6).alias("cost"))
