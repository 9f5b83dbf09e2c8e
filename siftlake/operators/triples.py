"""Tables seen as classes of things with properties, and graph patterns over them answered by one relational plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClassMap:
    """Rows of a table as things of one class: an id template such as "api/{uid}", and property -> column."""

    table: DataFrame
    template: str
    properties: dict[str, str]

    def ids(self) -> Column:
        parts = re.split(r"\{(\w+)\}", self.template)
        return F.concat(*[F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)])


@dataclass(frozen=True)
class Var:
    name: str


_TOKEN = re.compile(r'\s*(\?\w+|-?\d+(?:\.\d+)?(?!\w)|:?\w+|"(?:[^"\\]|\\.)*"|[;.,(){}]|!=|<=|>=|[=<>]|&&)')


def parse(text: str) -> tuple[list[str], list[tuple], list[tuple]]:
    """(variables, triples, filters) of SELECT ?v ... WHERE { ?s a :C ; :p ?o ; :q "x" . FILTER(?o > 3 && ...) }."""
    found = re.fullmatch(r"(?is)\s*(?:PREFIX\s+\w*:\s*<[^>]*>\s*)*SELECT\s+(.*?)\s*WHERE\s*\{(.*)\}\s*", text)
    if not found:
        raise ValueError("only SELECT ... WHERE { ... }")
    body, at, tokens = found[2].strip(), 0, []
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise ValueError(f"cannot read {body[at:at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
        while at < len(body) and body[at].isspace():
            at += 1

    def term(t: str):
        if t.startswith("?"):
            return Var(t[1:])
        if t.startswith('"'):
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if t in ("true", "false"):
            return t == "true"
        return float(t) if "." in t else int(t)

    triples, filters, i, subject = [], [], 0, None
    while i < len(tokens):
        if tokens[i] == ".":
            subject, i = None, i + 1
        elif tokens[i] == ";":
            i += 1
        elif tokens[i].upper() == "FILTER":
            i += 2
            while True:
                filters.append((term(tokens[i]), tokens[i + 1], term(tokens[i + 2])))
                i += 4
                if tokens[i - 1] == ")":
                    break
        else:
            if subject is None:
                subject, i = term(tokens[i]), i + 1
            verb, value = tokens[i], tokens[i + 1]
            triples.append((subject, "a" if verb == "a" else verb.lstrip(":"), value.lstrip(":") if verb == "a" else term(value)))
            i += 2
    return re.findall(r"\?(\w+)", found[1]), triples, filters


_TESTS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def select(classes: dict[str, ClassMap], text: str) -> DataFrame:
    """The distinct solutions of the pattern. A row without a property has no triple for it, so a null never matches.

    Each subject becomes one scan of its class with the constants as filters; subjects are joined on the
    variables they share. Subjects must state their class and hang together: a product is refused.
    """
    wanted, triples, filters = parse(text)
    subjects: dict[str, list] = {}
    for s, p, o in triples:
        if not isinstance(s, Var):
            raise ValueError("a subject is a variable")
        subjects.setdefault(s.name, []).append((p, o))
    parts = []
    for name, facts in subjects.items():
        kinds = [o for p, o in facts if p == "a"]
        if len(kinds) != 1:
            raise ValueError(f"?{name} needs one class")
        c = classes[kinds[0]]
        rows, columns = c.table, {name: c.ids()}
        for p, o in facts:
            if p == "a":
                continue
            if p not in c.properties:
                raise ValueError(f"{kinds[0]} has no {p}")
            col = F.col(c.properties[p])
            rows = rows.filter(col.isNotNull())
            if not isinstance(o, Var):
                rows = rows.filter(col == F.lit(o))
            elif o.name in columns:
                rows = rows.filter(col == columns[o.name])
            else:
                columns[o.name] = col
        parts.append(rows.select(*[v.alias(k) for k, v in columns.items()]))
    out, rest = parts[0], parts[1:]
    while rest:
        nxt = next((p for p in rest if set(p.columns) & set(out.columns)), None)
        if nxt is None:
            raise ValueError("the pattern falls into parts that share no variable")
        rest = [p for p in rest if p is not nxt]
        out = out.join(nxt, sorted(set(nxt.columns) & set(out.columns)))
    value = lambda t: F.col(t.name) if isinstance(t, Var) else F.lit(t)
    for a, op, b in filters:
        out = out.filter(_TESTS[op](value(a), value(b)))
    return out.select(*wanted).distinct()
