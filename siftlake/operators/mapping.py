"""Normalisation of raw sources into schema-checked nested records, and scoring of what comes out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_path(schema: dict, cls: str, path: str) -> str:
    """"full" if the class schema has the dotted path, "deep" if it ends below a catch-all; else ValueError."""
    attrs = schema["classes"][cls]["attrs"]
    parts = path.split(".")
    for i, part in enumerate(parts):
        if part not in attrs:
            raise ValueError(f"{cls} has no {'.'.join(parts[: i + 1])}")
        kind = attrs[part]
        if kind in schema.get("catch_alls", ()) or part in schema.get("catch_alls", ()):
            return "full" if i == len(parts) - 1 else "deep"
        if i < len(parts) - 1:
            if kind not in schema["objects"]:
                raise ValueError(f"{'.'.join(parts[: i + 1])} of {cls} has no fields")
            attrs = schema["objects"][kind]["attrs"]
    return "full"


@dataclass(frozen=True)
class Field:
    """source: a column or SQL expression; target: dotted path; status: typed, coerced or unmapped."""

    source: str
    target: str | None
    status: str = "typed"
    cast: str | None = None
    detection: bool = False


def validate(schema: dict, cls: str, fields: list[Field], catch_all: str = "unmapped") -> None:
    """Each source once, each target a path of the schema, only unmapped fields in the catch-all."""
    names = [f.source for f in fields]
    if len(set(names)) != len(names):
        raise ValueError("a field is mapped twice")
    for f in fields:
        if f.status == "unmapped":
            if f.target is not None and f.target.split(".")[0] != catch_all:
                raise ValueError(f"{f.source} is unmapped, yet has {f.target}")
        else:
            resolve_path(schema, cls, f.target)


def normalise(raw: DataFrame, fields: list[Field], constants: dict[str, object] | None = None) -> DataFrame:
    """raw as nested records: targets with a common prefix become structs. Absent stays null, never a default."""
    tree: dict = {}

    def put(path: str, col: Column) -> None:
        *heads, leaf = path.split(".")
        at = tree
        for h in heads:
            at = at.setdefault(h, {})
            if not isinstance(at, dict):
                raise ValueError(f"{path}: {h} is a value")
        if leaf in at:
            raise ValueError(f"{path} is mapped twice")
        at[leaf] = col

    for path, value in (constants or {}).items():
        put(path, F.lit(value))
    for f in fields:
        if f.target:
            col = F.expr(f.source)
            put(f.target, col.cast(f.cast) if f.cast else col)
    build = lambda t: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
    return raw.select(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])


def coverage(fields: list[Field]) -> dict[str, object]:
    """Shares of typed, coerced and unmapped fields, and what detections lose."""
    n = len(fields) or 1
    share = {s: sum(f.status == s for f in fields) / n for s in ("typed", "coerced", "unmapped")}
    return share | {"breaking": sorted(f.source for f in fields if f.detection and f.status != "typed")}


def fidelity(gold: DataFrame, emitted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row per column: gold rows, rows that were emitted with the field, rows with the same value.

    A gold null is matched by absence; a gold row that was not emitted has lost all its fields.
    """
    e = emitted.select(F.col(key), F.struct(*columns).alias("e"), F.lit(True).alias("there"))
    both = gold.select(F.col(key), F.struct(*columns).alias("g")).join(e, key, "left")
    there = F.coalesce("there", F.lit(False))
    cells = [
        F.struct(F.lit(c).alias("field"), there.alias("present"), (there & F.col(f"g.{c}").eqNullSafe(F.col(f"e.{c}"))).alias("same"))
        for c in columns
    ]
    rows = both.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("gold"), F.count_if("present").alias("present"), F.count_if("same").alias("same"))


def routed(raw: DataFrame, routes: list[tuple[str, str, list[str]]], route: str = "route") -> DataFrame:
    """raw with the name of the first route (name, SQL predicate, fields) that each row meets; rows that meet none go.

    One pass decides for all routes; project() then takes a route's fields. A predicate that is null is not met.
    """
    first = None
    for name, predicate, _ in routes:
        met = F.coalesce(F.expr(predicate), F.lit(False))
        first = F.when(met, name) if first is None else first.when(met, name)
    return raw.withColumn(route, first).filter(F.col(route).isNotNull())


def project(rows: DataFrame, name: str, fields: list[str], route: str = "route", keep: list[str] = ()) -> DataFrame:
    """The fields of one route's rows; a field that the source lacks is a null text."""
    have = set(rows.columns)
    return rows.filter(F.col(route) == name).select(*[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in [*fields, *keep]])


@dataclass(frozen=True)
class Coarse:
    """What a lean store does to a table: texts cut, columns emptied, rare values dropped, event time lost."""

    cut: tuple[tuple[str, int], ...] = ()
    emptied: tuple[str, ...] = ()
    rare: tuple[str, int] | None = None
    time: tuple[str, str] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """df after it. rare (column, n) keeps rows whose value has n rows or more; null values go. time (event, ingest) copies the latter."""
        if self.rare:
            column, n = self.rare
            usual = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(column)
            df = df.join(usual, column, "left_semi")
        kinds, cuts = dict(df.dtypes), dict(self.cut)
        out = []
        for c in df.columns:
            if c in self.emptied:
                out.append(F.lit(None).cast(kinds[c]).alias(c))
            elif c in cuts:
                out.append(F.left(F.col(c), F.lit(cuts[c])).alias(c))
            elif self.time and c == self.time[0]:
                out.append(F.col(self.time[1]).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


def suggest(field: str, rules: list[tuple[set[str], set[str], list[str]]], valid: set[str], catch_all: str = "unmapped") -> str:
    """The first path of the first rule (any of, all groups also any of, paths) that a field's words meet and the class has.

    Words are the parts between other characters and between lower and upper case. The result depends on
    the name alone, so the same field is mapped alike in every source.
    """
    import re

    words = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", field)} | {field.lower()}
    for some, also, paths in rules:
        if words & some and (not also or words & also):
            for p in paths:
                if p in valid:
                    return p
    return catch_all


def probes(emitted: DataFrame, expectations: DataFrame, key: str) -> DataFrame:
    """Failure classes: (probe, records, lost). expectations has (key, probe, path, wanted); wanted null asks for any value.

    A value is compared as its JSON text; a record that was not emitted has lost all. Paths are taken from
    the record as JSON, so one plan serves all probes.
    """
    out = emitted.select(F.col(key), F.to_json(F.struct(*emitted.columns)).alias("_record"))
    both = expectations.join(out, key, "left")
    value = F.expr("get_json_object(_record, concat('$.', path))")
    kept = F.when(F.col("wanted").isNull(), value.isNotNull()).otherwise(F.coalesce(value == F.col("wanted"), F.lit(False)))
    return both.groupBy("probe").agg(F.count(F.lit(1)).alias("records"), F.count_if(~kept).alias("lost"))


def same_value(a: Column, b: Column) -> Column:
    """Whether two JSON texts have the same value: numbers are equal by value, booleans equal booleans alone, objects
    whatever the order of their keys, arrays in order."""
    return _canonical(a).eqNullSafe(_canonical(b))


def _canonical(text: Column) -> Column:
    """JSON with sorted keys and one way to write a number; parsing sorts the keys of a variant."""
    plain = F.to_json(F.try_parse_json(text))
    # Outside of strings: a decimal point with zeros alone after it goes.
    parts = F.split(plain, r'(?<!\\)"', -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"(\d)\.0+(?!\d)", "$1")).otherwise(x)), '"')
