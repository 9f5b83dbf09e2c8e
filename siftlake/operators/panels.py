"""Materialized panels: additive aggregates, maintained from batches, and queries answered from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import persisted

#: What can be aggregated again; a distinct count cannot.
ADDITIVE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Panel:
    """keys: (name, SQL expression); measures: (name, kind, SQL expression); where: SQL predicate or None."""

    keys: tuple[tuple[str, str], ...]
    measures: tuple[tuple[str, str, str], ...]
    where: str | None = None

    def __post_init__(self):
        if bad := [k for _, k, _ in self.measures if k not in ADDITIVE]:
            raise ValueError(f"not additive: {bad}")

    def partial(self, rows: DataFrame) -> DataFrame:
        rows = rows.filter(self.where) if self.where else rows
        first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
        return rows.groupBy(*[F.expr(e).alias(n) for n, e in self.keys]).agg(*[first[k](F.expr(e)).alias(n) for n, k, e in self.measures])

    def merge(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*[n for n, _ in self.keys]).agg(*[ADDITIVE[k](n).alias(n) for n, k, _ in self.measures])


class Panels:
    """Panels by spec: apply() takes a batch into all of them, answer() serves a query that a panel covers.

    A panel is held as runs, partial results of more and more batches. A batch adds a run of its own; runs that
    have come from as many batches as a newer one are merged with it, so that a row of the panel is written as
    often as the logarithm of the number of batches, not with each of them. answer() merges the runs there are.
    """

    def __init__(self):
        self.held: dict[Panel, list[tuple[int, DataFrame]]] = {}

    def declare(self, panel: Panel) -> None:
        self.held.setdefault(panel, [])

    def apply(self, batch: DataFrame) -> None:
        for panel, runs in self.held.items():
            size, part = 1, panel.partial(batch)
            while runs and runs[-1][0] <= size:
                older, run = runs.pop()
                size, part = size + older, panel.merge(run.unionByName(part))
            runs.append((size, persisted(part)))

    def answer(self, wanted: Panel, base: DataFrame) -> tuple[DataFrame, bool]:
        """(result, whether a panel gave it): one with the same predicate whose keys and measures hold the wanted ones."""
        for panel, runs in self.held.items():
            if runs and panel.where == wanted.where and set(wanted.keys) <= set(panel.keys) and set(wanted.measures) <= set(panel.measures):
                every = runs[0][1]
                for _, run in runs[1:]:
                    every = every.unionByName(run)
                return wanted.merge(every), True
        return wanted.partial(base), False
