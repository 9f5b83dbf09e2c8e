"""Whether answers are right: kinds of questions, equality of results of two engines, structure of compiled correlations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(value) -> str:
    """A value as text that engines agree on: NULL, 0 or 1, two decimals, days of dates."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, int):
        return str(value)
    text = str(value)
    if re.fullmatch(r"[-+]?\d+", text):
        return str(int(text))
    try:
        return f"{float(text):.2f}"
    except ValueError:
        return text[:10] if re.match(r"\d{4}-\d\d-\d\d", text) else text


def same_answers(a: Iterable[Iterable], b: Iterable[Iterable], tolerance: float = 0.02) -> bool:
    """Rows in order, cell by cell; numbers may differ by the tolerance, since sums of floats depend on their order."""
    a, b = [[cell(v) for v in r] for r in a], [[cell(v) for v in r] for r in b]
    return [len(r) for r in a] == [len(r) for r in b] and all(_near(x, y, tolerance) for p, q in zip(a, b) for x, y in zip(p, q))


def _number(text) -> float | None:
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def _near(x: str, y: str, tolerance: float) -> bool:
    if x == y:
        return True
    p, q = _number(x), _number(y)
    return p is not None and q is not None and abs(p - q) <= tolerance + 1e-12


def verdict(kind: str, rows: list, gold) -> str:
    """ "refused" for no rows, else "correct" or "silent" (an answer that is wrong without saying so).

    scalar: a cell equals gold; set: the cells are gold; uid: gold is among them; substring: a cell contains
    gold; uidset: half of gold is found within four times as many cells; count: gold's size is a cell or the
    number of cells; order: the stages' words appear first in gold's order.
    """
    if not rows:
        return "refused"
    cells = [str(c) for r in rows for c in r]
    numbers = [n for n in map(_number, cells) if n is not None]
    if kind == "scalar":
        n = _number(gold)
        right = str(gold) in cells if n is None else any(abs(v - n) <= 1e-9 * max(1.0, abs(n)) for v in numbers)
    elif kind == "set":
        right = set(cells) == {str(g) for g in gold}
    elif kind == "uid":
        right = str(gold) in cells
    elif kind == "substring":
        right = any(str(gold) in c for c in cells)
    elif kind == "uidset":
        truth = {str(g) for g in gold}
        right = 2 * len(truth & set(cells)) >= len(truth) and len(cells) <= 4 * len(truth)
    elif kind == "count":
        n = gold if isinstance(gold, int) else len(gold)
        right = n in numbers or len(cells) == n
    elif kind == "order":
        at = [" ".join(cells).lower().find(str(g).lower()) for g in gold]
        right = min(at) >= 0 and all(p < q for p, q in zip(at, at[1:]))
    else:
        raise ValueError(f"no kind {kind}")
    return "correct" if right else "silent"


def consensus(answers: dict[str, str]) -> tuple[str | None, list[str]]:
    """(what more than half of the engines say, else None; who says otherwise)."""
    counts = {}
    for v in answers.values():
        counts[v] = counts.get(v, 0) + 1
    best = max(counts, key=lambda v: (counts[v], v), default=None)
    if best is None or 2 * counts[best] <= len(answers):
        return None, sorted(answers)
    return best, sorted(k for k, v in answers.items() if v != best)


def correlation_structure(text: str, correlation: dict) -> dict[str, bool]:
    """Which parts of a correlation a compiled text still has: aggregation, distinct field, threshold, window.

    Names of the group are not scored: a compiler may rename fields into its own schema.
    """
    low, condition = text.lower(), correlation.get("condition") or {}
    out = {
        "aggregation": bool(re.search(r"\b(count|sum|group by|stats|summarize|row_number|min|max)\b", low)),
        "time_window": bool(re.search(r"\b(window|range between|interval|timespan|bin|span|bucket|between)\b", low)),
    }
    bounds = [v for k, v in condition.items() if k != "field"]
    if correlation["type"] in ("event_count", "value_count") and bounds:
        out["threshold"] = bool(re.search(rf"(>=?|<=?|=)\s*{re.escape(str(bounds[0]))}\b", low))
    if condition.get("field"):
        out["distinct_field"] = bool(re.search(r"\b(distinct|dc|cardinality|dcount)\b", low)) and condition["field"].split(".")[-1].lower() in low
    return out


def set_scores(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of sets of keys; an empty side gives zeros, not errors."""
    sides = found.select(key).distinct().withColumn("f", F.lit(1)).unionByName(truth.select(key).distinct().withColumn("f", F.lit(2)))
    by_key = sides.groupBy(key).agg(F.sum("f").alias("s"))
    n = by_key.agg(*[F.count_if(F.col("s") == v).alias(c) for c, v in (("tp", 3), ("fp", 1), ("fn", 2))])
    part = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    n = n.withColumn("precision", part("tp", "fp")).withColumn("recall", part("tp", "fn"))
    total = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def bands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, standard error, 95 % interval, least and most of repeated measurements."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    out = df.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), sd.alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    out = out.withColumn("se", F.col("sd") / F.sqrt("n"))
    return out.withColumn("low", F.col("mean") - 1.96 * F.coalesce("se", F.lit(0.0))).withColumn("high", F.col("mean") + 1.96 * F.coalesce("se", F.lit(0.0)))
