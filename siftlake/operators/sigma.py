"""Detection rules compiled to Column predicates, and event correlations over windows of time.

A rule is a mapping (or YAML text) with named selections and a condition over them. A selection maps
`field|modifier` to a value or list; fields are joined by and, a list by or (by and with `all`).
Matching of strings ignores case, as rules expect. What is not supported raises, and a correlation
without a time span raises too: nothing is dropped in silence.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODIFIERS = {"contains", "startswith", "endswith", "re", "all", "gte", "gt", "lte", "lt", "cased"}
_SPAN = re.compile(r"^(\d+)([smhd])$")
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def load(rule) -> dict:
    if isinstance(rule, str):
        import yaml

        return yaml.safe_load(rule)
    return rule


def _one(col: Column, mods: list[str], value) -> Column:
    if value is None:
        return col.isNull()
    if isinstance(value, bool):
        return col == F.lit(value)
    for name, op in (("gte", col.__ge__), ("gt", col.__gt__), ("lte", col.__le__), ("lt", col.__lt__)):
        if name in mods:
            return op(F.lit(value))
    if isinstance(value, (int, float)) and not set(mods) & {"contains", "startswith", "endswith", "re"}:
        return col == F.lit(value)
    text, want = col.cast("string"), str(value)
    if "re" in mods:
        return text.rlike(want)
    if "cased" not in mods:
        text, want = F.lower(text), want.lower()
    for name, op in (("contains", text.contains), ("startswith", text.startswith), ("endswith", text.endswith)):
        if name in mods:
            return op(want)
    if "*" in want or "?" in want:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in want)
        return text.rlike(f"(?s)^{pattern}$")
    return text == F.lit(want)


def _selection(spec, fields: dict[str, str]) -> Column:
    if isinstance(spec, list):
        return reduce(Column.__or__, [_selection(s, fields) for s in spec])
    parts = []
    for key, value in spec.items():
        name, *mods = key.split("|")
        if unknown := set(mods) - MODIFIERS:
            raise ValueError(f"modifiers not supported: {sorted(unknown)}")
        col, values = F.col(fields.get(name, name)), value if isinstance(value, list) else [value]
        tests = [_one(col, mods, v) for v in values]
        parts.append(F.coalesce(reduce(Column.__and__ if "all" in mods else Column.__or__, tests), F.lit(False)))
    return reduce(Column.__and__, parts)


def compile_rule(rule, fields: dict[str, str] | None = None) -> Column:
    """The predicate of a rule; fields renames the rule's fields to columns. A comparison with null does not match."""
    detection = dict(load(rule)["detection"])
    condition = detection.pop("condition")
    named = {k: _selection(v, fields or {}) for k, v in detection.items()}
    tokens = re.findall(r"\(|\)|\d+ of [\w*]+|all of [\w*]+|[\w*]+", condition)
    if "".join(tokens).replace(" ", "") != re.sub(r"\s", "", condition):
        raise ValueError(f"condition not supported: {condition}")
    pos = 0

    def some(token: str) -> Column:
        many = re.fullmatch(r"(all|\d+) of ([\w*]+)", token)
        if not many:
            if token not in named:
                raise ValueError(f"no selection {token}")
            return named[token]
        pattern = ".*" if many[2] == "them" else many[2].replace("*", ".*")
        hits = [c for k, c in named.items() if re.fullmatch(pattern, k)]
        if not hits:
            raise ValueError(f"no selection matches {many[2]}")
        need = len(hits) if many[1] == "all" else int(many[1])
        return reduce(Column.__add__, [c.cast("int") for c in hits]) >= need

    def atom() -> Column:
        nonlocal pos
        token, pos = tokens[pos], pos + 1
        if token == "not":
            return ~atom()
        if token == "(":
            inner = either()
            if pos >= len(tokens) or tokens[pos] != ")":
                raise ValueError(f"condition not supported: {condition}")
            pos += 1
            return inner
        return some(token)

    def each() -> Column:
        nonlocal pos
        left = atom()
        while pos < len(tokens) and tokens[pos] == "and":
            pos += 1
            left = left & atom()
        return left

    def either() -> Column:
        nonlocal pos
        left = each()
        while pos < len(tokens) and tokens[pos] == "or":
            pos += 1
            left = left | each()
        return left

    out = either()
    if pos != len(tokens):
        raise ValueError(f"condition not supported: {condition}")
    return out


def seconds(span: str) -> int:
    found = _SPAN.match(span or "")
    if not found:
        raise ValueError(f"time span not supported: {span!r}")
    return int(found[1]) * _SECONDS[found[2]]


def correlate(events: DataFrame, correlation: dict, time: str = "time_s", rule: str = "rule") -> DataFrame:
    """Groups that fulfil a correlation, (group columns, at: the earliest second at which it is fulfilled).

    events: one row per match with its rule's name. event_count and value_count look back `timespan`
    from every event (a sliding range frame, not fixed buckets); temporal wants all rules within it,
    temporal_ordered in the order given.
    """
    kind, by = correlation["type"], correlation["group-by"]
    span, rules = seconds(correlation["timespan"]), correlation["rules"]
    rows = events.filter(F.col(rule).isin(rules))
    back = Window.partitionBy(*by).orderBy(time).rangeBetween(-span, 0)
    if kind == "event_count":
        hit = F.count(F.lit(1)).over(back) >= correlation["condition"]["gte"]
    elif kind == "value_count":
        return _kinds_within(rows, by, correlation["condition"]["field"], time, span, correlation["condition"]["gte"])
    elif kind == "temporal":
        return _kinds_within(rows, by, rule, time, span, len(set(rules)))
    elif kind == "temporal_ordered":
        # The latest chance of each step: the greatest start of a chain that has got so far.
        starts = None
        for r in rules:
            here = F.col(rule) == r
            if starts is None:
                rows = rows.withColumn("_start", F.when(here, F.col(time)))
            else:
                prior = F.max("_start").over(Window.partitionBy(*by).orderBy(time).rangeBetween(-span, -1))
                rows = rows.withColumn("_next", F.when(here & (prior >= F.col(time) - span), prior))
                rows = rows.withColumn("_start", F.col("_next")).drop("_next")
            starts = r
        hit = F.col("_start").isNotNull()
    else:
        raise ValueError(f"correlation not supported: {kind}")
    return rows.withColumn("_hit", hit).filter("_hit").groupBy(*by).agg(F.min(time).alias("at"))


def _kinds_within(rows: DataFrame, by: list[str], kind: str, time: str, span: int, least: int) -> DataFrame:
    """The first second at which the last `span` seconds hold `least` kinds, by group.

    A kind is present from an event until `span` after it; where no event of its follows by then, it goes.
    The number of kinds is a running sum of comings and goings, so no task gathers what a window holds.
    """
    seen = rows.filter(F.col(kind).isNotNull()).select(*by, F.col(kind).alias("_kind"), F.col(time).alias("_t")).distinct()
    own = Window.partitionBy(*by, "_kind").orderBy("_t")
    seen = seen.withColumn("_before", F.lag("_t").over(own)).withColumn("_after", F.lead("_t").over(own))
    comes = seen.filter(F.col("_before").isNull() | (F.col("_t") - F.col("_before") > span)).select(*by, "_t", F.lit(1).alias("_d"))
    goes = seen.filter(F.col("_after").isNull() | (F.col("_after") - F.col("_t") > span)).select(*by, (F.col("_t") + span + 1).alias("_t"), F.lit(-1).alias("_d"))
    steps = comes.unionByName(goes).groupBy(*by, "_t").agg(F.sum("_d").alias("_d"))
    upto = Window.partitionBy(*by).orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("_n", F.sum("_d").over(upto)).filter(F.col("_n") >= least).groupBy(*by).agg(F.min("_t").alias("at"))


def techniques(tags: Column) -> Column:
    """The base techniques (t1059) that a rule's tags (attack.t1059.001) name, each once, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.array_join(tags, " ")), F.lit(r"\b(t\d{4})"), F.lit(1))))


def recall_loss(full: DataFrame, coarse: DataFrame, rules: dict[str, dict], groups: dict[str, str]) -> DataFrame:
    """What rules lose on a coarse store: a row per group of rules, from one pass over each store.

    (grp, fired: rules with matches on the full store, mean_loss: of the share of matches gone, over-matches
    counting as no loss, blind: rules without any match left, over_matched, mean_signed).
    """
    def counted(store: DataFrame, name: str) -> DataFrame:
        flags = [F.struct(F.lit(n).alias("rule"), F.coalesce(compile_rule(r), F.lit(False)).alias("hit")) for n, r in rules.items()]
        return store.select(F.explode(F.array(*flags)).alias("f")).groupBy("f.rule").agg(F.count_if("f.hit").alias(name))

    group = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    both = counted(full, "n").join(counted(coarse, "m"), "rule", "left").filter("n > 0").select(group[F.col("rule")].alias("grp"), "n", F.coalesce("m", F.lit(0)).alias("m"))
    loss = 1 - F.col("m") / F.col("n")
    return both.groupBy("grp").agg(
        F.count(F.lit(1)).alias("fired"), F.avg(F.greatest(loss, F.lit(0.0))).alias("mean_loss"), F.count_if(F.col("m") == 0).alias("blind"),
        F.count_if(F.col("m") > F.col("n")).alias("over_matched"), F.avg(loss).alias("mean_signed"),
    )


def score(events: DataFrame, rules: dict[str, Column], needle: Column) -> DataFrame:
    """A row per rule: matches, true positives, needles, in one pass over the events."""
    flags = [F.struct(F.lit(n).alias("rule"), c.alias("hit")) for n, c in rules.items()]
    rows = events.select(needle.alias("needle"), F.explode(F.array(*flags)).alias("f")).select("needle", "f.*")
    return rows.groupBy("rule").agg(
        F.count_if("hit").alias("matches"), F.count_if(F.col("hit") & F.col("needle")).alias("tp"), F.count_if("needle").alias("needles")
    )
