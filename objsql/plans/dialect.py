"""What SQL a query may use, decided on Spark's parsed plan.

``extended`` takes any read-only query. ``strict`` takes one table with a
filter and either a projection or global aggregates, and names what else it
finds; nothing is ignored silently.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

TABLE = "s3object"


class DialectError(ValueError):
    """SQL that a dialect doesn't take."""


#: Plan nodes of statements that only read.
_READS = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except", "Join", "LateralJoin", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "UnresolvedTableValuedFunction",
    "WithWindowDefinition", "Generate", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedHint", "Sample", "UnresolvedTVFAliases", "ParameterizedQuery", "View", "Tail", "ResolvedInlineTable", "UnresolvedOrdinal",
}
#: What strict doesn't take, by plan node.
_NOT_STRICT = {
    "Sort": "ORDER BY", "GlobalLimit": "LIMIT", "LocalLimit": "LIMIT", "Offset": "OFFSET", "Distinct": "DISTINCT", "Union": "UNION", "Intersect": "INTERSECT", "Except": "EXCEPT", "Join": "JOIN",
    "LateralJoin": "LATERAL", "UnresolvedWith": "WITH", "UnresolvedHaving": "HAVING", "Aggregate": "GROUP BY", "UnresolvedInlineTable": "VALUES", "Generate": "LATERAL VIEW", "OneRowRelation": "no FROM",
    "WithWindowDefinition": "WINDOW", "Pivot": "PIVOT", "UnresolvedPivot": "PIVOT", "Unpivot": "UNPIVOT", "Sample": "TABLESAMPLE",
}
_WORDS = (("windowspecdefinition", "OVER"), ("windowspecreference", "OVER"), ("scalar-subquery", "a subquery"), ("exists#", "EXISTS"), ("listquery", "IN (SELECT ...)"))


def _nodes(plan) -> list:
    out = [plan]
    children = plan.children()
    for k in range(children.size()):
        out += _nodes(children.apply(k))
    inner = plan.innerChildren()
    for k in range(inner.size()):
        child = inner.apply(k)
        if hasattr(child, "children") and "plans.logical" in child.getClass().getName():
            out += _nodes(child)
    return out


def check(spark: SparkSession, sql: str, dialect: str = "extended") -> None:
    """Raises DialectError unless the text is one read-only query of the dialect."""
    if dialect not in ("extended", "strict"):
        raise ValueError(f"unknown dialect: {dialect}")
    if not sql.strip():
        raise DialectError("the query is empty")
    # The parser takes its settings from the thread's active session.
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise DialectError(f"syntax: {str(getattr(e, 'java_exception', e)).splitlines()[0]}") from None
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
    nodes = [n.getClass().getSimpleName() for n in _nodes(plan)]
    wrong = [n for n in nodes if n not in _READS]
    if wrong:
        raise DialectError(f"only queries are allowed, not {wrong[0]}")
    if dialect == "strict":
        for node in nodes:
            if node in _NOT_STRICT:
                raise DialectError(f"strict queries have no {_NOT_STRICT[node]}")
        text = plan.toString().lower()
        for mark, name in _WORDS:
            if mark in text:
                raise DialectError(f"strict queries have no {name}")
        if re.search(r"(?i)\b(count|sum|avg|min|max)\s*\(\s*distinct\b", sql):
            raise DialectError("strict queries have no DISTINCT")
        if re.search(r"(?i)\)\s*filter\s*\(", sql):
            raise DialectError("strict queries have no FILTER")
        if nodes.count("UnresolvedRelation") != 1:
            raise DialectError("strict queries have one table")


#: Text in quotes, comments, or a table's name in quotes.
_LITERALS = re.compile(r"(?i)(\b(?:from|join)\s+)('(?:[^']|'')+')|('(?:[^']|'')*')|(\"(?:[^\"]|\"\")*\")|(--[^\n]*|/\*.*?\*/)", re.S)


def object_tables(sql: str) -> tuple[str, list[str]]:
    """The text with each quoted name after FROM or JOIN replaced by a view's name, and the names in order of the views objects_0, objects_1, ..."""
    found: list[str] = []

    def put(m: re.Match) -> str:
        if not m[2]:
            return m[0]
        name = m[2][1:-1].replace("''", "'")
        if name not in found:
            found.append(name)
        return f"{m[1]}objects_{found.index(name)}"

    return _LITERALS.sub(put, sql), found


#: Words that may follow a table's name and are no alias.
_NO_ALIAS = {"WHERE", "JOIN", "ON", "USING", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "LATERAL", "SEMI", "ANTI", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", "QUALIFY", "WINDOW", "TABLESAMPLE", "PIVOT", "UNPIVOT"}
_QUOTED = r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`"


def positions(sql: str, tables: dict[str, list[str]]) -> str:
    """Replaces _1, _2, ... by the names of the columns there, outside quotes; names that are columns themselves stay.

    ``tables`` has the columns of each table. After an alias or a table's name
    its own columns count, else those of the query's first table.
    """
    known = {name.lower(): columns for name, columns in tables.items()}
    order: list[str] = []
    names = "|".join(map(re.escape, known)) or "(?!)"
    for found in re.finditer(rf"(?i){_QUOTED}|(?:\bfrom|\bjoin|,)\s+({names})\b(?:\s+(?:as\s+)?([a-z_]\w*))?", sql):
        if found[1]:
            name, alias = found[1].lower(), found[2]
            alias = (alias if alias and alias.upper() not in _NO_ALIAS else name).lower()
            known[alias] = known[name]
            order.append(alias)
    first = known[order[0]] if order else next(iter(known.values()), [])

    def put(m: re.Match) -> str:
        if m[0][0] in "'\"`":
            return m[0]
        columns = known.get(m[1].lower(), []) if m[1] else first
        n = int(m[2])
        if f"_{n}" in (c.lower() for c in columns) or not 1 <= n <= len(columns):
            return m[0]
        owner = f"{m[1]}." if m[1] else f"{order[0]}." if len(order) > 1 else ""
        return f"{owner}`{columns[n - 1]}`"

    return re.sub(rf"{_QUOTED}|(?:\b([A-Za-z_]\w*)\.|(?<![\w.]))_(\d+)\b", put, sql)
