"""Read-only SQL for callers who are not trusted, and row-level security."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Functions that a caller may use. None of them reads files, calls Java, or tells of the session.
FUNCTIONS = frozenset("""
abs any_value approx_count_distinct array array_contains array_distinct array_join array_sort avg bigint bit_and bit_or bit_xor bool_and
bool_or bround ceil char_length coalesce collect_list collect_set concat concat_ws contains count count_if cume_dist date_trunc datediff
day dayofweek dense_rank double element_at endswith exists exp explode filter first floor from_json from_unixtime get_json_object greatest
hour if ifnull initcap instr int isnotnull isnull lag last lead least left len length like ln locate log log10 lower lpad ltrim map max
max_by md5 mean median min min_by minute mod mode month named_struct ntile nullif nvl percent_rank percentile pmod position power quarter
rank regexp_count regexp_extract regexp_like regexp_replace repeat replace reverse right round row_number rpad rtrim second sequence sha2
sign size sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring sum timestamp
timestamp_millis to_date to_json to_timestamp transform translate trim try_cast unix_micros unix_millis unix_seconds upper var_pop var_samp
variance weekofyear when window xxhash64 year
""".split())


def _names(option) -> str:
    return ".".join(option.apply(i) for i in range(option.size()))


def _walk(node):
    """All nodes of a parsed plan, with its expressions, subqueries and named parts."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        more = [x.children(), x.innerChildren()]
        names = {m.getName() for m in x.getClass().getMethods() if m.getParameterCount() == 0}
        if "expressions" in names:
            more.append(x.expressions())
        if "plan" in names:
            stack.append(x.plan())
        for seq in more:
            stack += [seq.apply(i) for i in range(seq.size())]


def safe_sql(spark: SparkSession, text: str, limit: int = 20) -> DataFrame:
    """One SELECT (or WITH ... SELECT) of one line, checked on the parsed plan, never more than limit rows.

    The plan may hold no command, read nothing but tables and views that the catalog has (so no path or
    format in their place), and call only FUNCTIONS: what is not known to be harmless is refused.
    """
    text = text.strip().rstrip(";").strip()
    if "\n" in text or ";" in text:
        raise ValueError("one statement on one line")
    if not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("only SELECT")
    named, read = set(), set()
    for node in _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
        kind = node.getClass().getSimpleName()
        if re.search(r"Command|Statement$|Insert|Create|Drop|Alter|Delete|Update|Merge|ScriptTransform|Reflect", kind):
            raise ValueError(f"not allowed: {kind}")
        if kind == "UnresolvedWith":
            named |= {node.cteRelations().apply(i)._1().lower() for i in range(node.cteRelations().size())}
        elif kind == "UnresolvedRelation":
            read.add(_names(node.multipartIdentifier()))
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator", "UnresolvedTableValuedFunction"):
            name = {"UnresolvedFunction": lambda: _names(node.nameParts()), "UnresolvedGenerator": lambda: node.name().funcName()}.get(kind, lambda: _names(node.name()))()
            if name.lower() not in (FUNCTIONS if kind != "UnresolvedTableValuedFunction" else ("range",)):
                raise ValueError(f"function not allowed: {name}")
    for name in read:
        if name.lower() not in named and (not re.fullmatch(r"\w+(\.\w+){0,2}", name) or not spark.catalog.tableExists(name)):
            raise ValueError(f"no such table: {name}")
    return spark.sql(text).limit(limit)


def secured(df: DataFrame, tenant_column: str, tenants: list[int]) -> DataFrame:
    """The rows that a caller may see; queries start from here, so no limit is taken before the filter."""
    return df.filter(df[tenant_column].isin(*tenants))
