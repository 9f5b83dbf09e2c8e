"""Values at given ranks of a whole column, without gathering or sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit: a pass counts at most 2 ** BITS digits a percentage.
BITS = 16


def at_percents(values: DataFrame, percents: list[int]) -> DataFrame:
    """One row, p<percent> for each: the least value that so many hundredths of all values do not exceed.

    values has one column, which is taken as long; nulls are left out, and without values the row is null.
    Ranks are exact: hundredths are compared as whole numbers. The value is found a digit at a time, from the
    top: rows are counted by digit, and the next pass counts only those that share the digits found so far.
    So a pass shuffles, and its window holds, 65,536 counts a percentage at most, however many values differ.
    """
    rows = values.toDF("v").select(F.col("v").cast("long").alias("v")).filter("v IS NOT NULL")
    asked = F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("percent")
    found, done = None, 64
    while done:
        done -= BITS
        digits = F.shiftright("v", done).alias("digits")  # signed, so in order; the last are the value
        if found is None:
            counts = rows.groupBy(digits).agg(F.count(F.lit(1)).alias("n")).select(asked, "digits", "n", F.lit(0).cast("long").alias("below"))
            counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("percent")))
        else:
            mine = rows.join(F.broadcast(found), F.shiftright("v", done + BITS) == F.col("prefix"))
            counts = mine.groupBy("percent", "below", "total", digits).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("percent").orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.col("below") + F.sum("n").over(before))
        reached = counts.filter(F.col("upto") * 100 >= F.col("total") * F.col("percent"))
        least = reached.groupBy("percent").agg(F.min(F.struct("digits", (F.col("upto") - F.col("n")).alias("below"), "total")).alias("x"))
        found = least.select("percent", F.col("x.digits").alias("prefix"), "x.below", "x.total")
    return found.agg(*[F.max(F.when(F.col("percent") == p, F.col("prefix"))).alias(f"p{p}") for p in percents])
