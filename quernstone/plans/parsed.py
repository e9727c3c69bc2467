"""The only module that reads logical plans through the JVM: it turns a parsed statement into plain data."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Plan nodes that only read (fixed values). Any other node makes a statement unsafe.
QUERY_NODES = frozenset(
    """Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Union Intersect Except Distinct SubqueryAlias
    UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith OneRowRelation LocalRelation UnresolvedInlineTable
    UnresolvedHaving Generate Pivot UnresolvedPivot Unpivot UnresolvedHint LateralJoin AsOfJoin WithWindowDefinition
    Window Sample UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedTableValuedFunctionAlias CTERelationRef WithCTE Tail
    UnresolvedOrderBy LateralSubquery ParameterizedQuery NamedParametersQuery PosParametersQuery Deduplicate""".split()
)
#: Built-in functions that reach outside the tables; no statement may call them.
OUTSIDE_FUNCTIONS = frozenset(
    ("reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "version", "python_worker_logs", "raise_error")
)
#: Functions that may stand for a table.
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"))
#: Aggregate functions that a signature names (fixed values).
AGGREGATES = frozenset("count sum avg mean min max".split())


@dataclass
class Statement:
    """Plain facts of one parsed statement."""

    nodes: Counter = field(default_factory=Counter)
    tables: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    columns: list[tuple[str, ...]] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    table_functions: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    ctes: list[str] = field(default_factory=list)
    projections: int = 0
    selects: int = 0
    groups: list[str] = field(default_factory=list)
    orders: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    limits: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    subqueries: int = 0


def _seq(x: Any) -> Iterator[Any]:
    for k in range(x.size()):
        yield x.apply(k)


def _name(x: Any) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def parse(spark: SparkSession, sql: str) -> Statement:
    """Facts of a statement; raises ParseException if it isn't exactly one statement."""
    out = Statement()
    _plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), out, True)
    return out


def _plan(node: Any, out: Statement, top: bool) -> None:
    kind = _name(node)
    out.nodes[kind] += 1
    if kind == "UnresolvedRelation":
        out.tables.append(".".join(_seq(node.multipartIdentifier())).lower())
    elif kind == "UnresolvedTableValuedFunction":
        out.table_functions.append(".".join(_seq(node.name())).lower())
    elif kind == "SubqueryAlias" and _name(node.child()) == "UnresolvedRelation":
        out.aliases[node.identifier().name().lower()] = ".".join(_seq(node.child().multipartIdentifier())).lower()
    elif kind in ("Project", "Aggregate"):
        items = node.projectList() if kind == "Project" else node.aggregateExpressions()
        out.selects += 1
        out.projections += items.size()
        if top and not out.outputs:
            out.outputs = [x.sql() for x in _seq(items)]
        if kind == "Aggregate":
            out.groups += [x.sql() for x in _seq(node.groupingExpressions())]
    elif kind == "Filter":
        out.filters.append(node.condition().sql())
    elif kind == "Sort":
        out.orders += [x.sql() for x in _seq(node.order())]
    elif kind == "GlobalLimit":
        out.limits.append(node.limitExpr().sql())
    elif kind == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            out.ctes.append(pair.productElement(0).lower())
    for x in _seq(node.expressions()):
        _expression(x, out)
    inside = node.children().size()
    for x in _seq(node.children()):
        _plan(x, out, top and inside == 1)
    for x in _seq(node.innerChildren()):
        if hasattr(x, "innerChildren") and kind != "UnresolvedHint" and "plans.logical" in x.getClass().getName() or _name(x) in QUERY_NODES:
            _plan(x, out, False)


def _expression(x: Any, out: Statement) -> None:
    kind = _name(x)
    if kind == "UnresolvedAttribute":
        out.columns.append(tuple(p.lower() for p in _seq(x.nameParts())))
    elif kind == "UnresolvedFunction":
        out.functions.append(".".join(_seq(x.nameParts())).lower())
    elif kind == "Literal":
        text = x.sql()
        out.literals.append(("string:" if text.startswith("'") else "number:") + text.strip("'").lower())
    if hasattr(x.getClass(), "getMethods") and kind in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery", "UnresolvedScalarSubquery"):
        out.subqueries += 1
        if kind != "InSubquery":
            _plan(x.plan(), out, False)
        else:
            out.subqueries -= 1
    for y in _seq(x.children()):
        _expression(y, out)


def unsafe_nodes(statement: Statement) -> list[str]:
    return sorted(set(statement.nodes) - QUERY_NODES)


def reaches_outside(spark: SparkSession, statement: Statement) -> list[str]:
    """What a statement names beyond views of the session and harmless built-in functions: files and tables of
    other catalogs (names of several parts), functions that are not built in, and those that look outside."""
    known = builtin_functions(spark)
    found = [f"relation {t}" for t in statement.tables if "." in t or "/" in t]
    found += [f"function {f}" for f in statement.functions if f not in known or f in OUTSIDE_FUNCTIONS]
    found += [f"table function {f}" for f in statement.table_functions if f not in TABLE_FUNCTIONS]
    return sorted(set(found))


_builtin: dict[str, frozenset[str]] = {}


def builtin_functions(spark: SparkSession) -> frozenset[str]:
    if not _builtin:
        _builtin["names"] = frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return _builtin["names"]


def signature(spark: SparkSession, sql: str) -> dict[str, Any] | None:
    """What two statements are compared by; None if the text does not parse."""
    try:
        s = parse(spark, sql)
    except ParseException:
        return None
    return {
        "tables": sorted({t.rpartition(".")[2] for t in s.tables}),
        "columns": sorted({c[-1] for c in s.columns}),
        "aggregate_functions": sorted(f for f in s.functions if f in AGGREGATES),
        "literals": sorted(s.literals),
        "join_count": s.nodes["Join"],
        "select_count": s.selects,
        "projection_count": s.projections,
        "subquery_count": s.subqueries,
        "set_operation_count": s.nodes["Union"] + s.nodes["Intersect"] + s.nodes["Except"],
        "has_where": s.nodes["Filter"] > 0,
        "has_group_by": bool(s.groups),
        "has_having": s.nodes["UnresolvedHaving"] > 0,
        "has_order_by": s.nodes["Sort"] > 0,
        "has_limit": s.nodes["GlobalLimit"] > 0,
        "has_distinct": s.nodes["Distinct"] > 0,
    }


#: The label of a difference in each part of a signature (fixed values).
MISMATCHES = {
    "tables": "table_selection_mismatch",
    "columns": "column_reference_mismatch",
    "aggregate_functions": "aggregation_mismatch",
    "literals": "literal_or_value_mismatch",
    "join_count": "join_structure_mismatch",
    "select_count": "select_or_subquery_count_mismatch",
    "projection_count": "projection_count_mismatch",
    "subquery_count": "subquery_structure_mismatch",
    "set_operation_count": "set_operation_mismatch",
    "has_where": "where_clause_mismatch",
    "has_group_by": "group_by_mismatch",
    "has_having": "having_mismatch",
    "has_order_by": "order_by_mismatch",
    "has_limit": "limit_mismatch",
    "has_distinct": "distinct_mismatch",
}


def structural_mismatches(spark: SparkSession, gold: str, predicted: str) -> list[str]:
    """In what two statements differ; nothing if either does not parse."""
    parts = [signature(spark, sql) for sql in (gold, predicted)]
    if None in parts:
        return []
    sides = [{(k, repr(v)) for k, v in part.items()} for part in parts]
    differing = {k for k, _ in sides[0] ^ sides[1]}
    return [MISMATCHES[k] for k in MISMATCHES if k in differing] if differing else ["other_semantic_mismatch"]


def canonical_sql(spark: SparkSession, sql: str) -> str:
    """One normalised rendering for texts that parse alike; an ``error:`` text otherwise."""
    try:
        parse(spark, sql)
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).canonicalized().toString()
    except ParseException as e:
        return f"error: {e.getCondition()}"


def references(spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """Lower-cased tables (names of common table expressions too) and columns."""
    s = parse(spark, sql)
    return {t.rpartition(".")[2] for t in s.tables} | set(s.ctes), {c[-1] for c in s.columns}


def grounding(spark: SparkSession, sql: str, schema: dict[str, list[str]]) -> dict[str, bool | None]:
    """Whether all tables and all columns exist; unknown if there is no table or the text does not parse."""
    try:
        s = parse(spark, sql)
    except ParseException:
        return {"tables_grounded": None, "columns_grounded": None}
    known = {t.lower() for t in schema} | set(s.ctes)
    columns = {c.lower() for cs in schema.values() for c in cs}
    if not s.tables:
        return {"tables_grounded": None, "columns_grounded": None}
    return {"tables_grounded": all(t.rpartition(".")[2] in known for t in s.tables), "columns_grounded": all(c[-1] in columns for c in s.columns)}


def repair_column(spark: SparkSession, sql: str, missing: str, schema: dict[str, list[str]]) -> str | None:
    """The statement with a column moved to the only table that owns it, if that has one alias here."""
    import re

    alias, _, column = missing.lower().rpartition(".")
    s = parse(spark, sql)
    wrong = s.aliases.get(alias, alias)
    owners = [t for t, cs in schema.items() if column in (c.lower() for c in cs) and t.lower() != wrong]
    if len(owners) != 1:
        return None
    names = [a for a, t in s.aliases.items() if t == owners[0].lower()] or [t for t in s.tables if t == owners[0].lower()]
    if len(names) != 1:
        return None
    target = rf"\b{re.escape(alias)}\s*\.\s*{re.escape(column)}\b" if alias else rf"(?<![.\w]){re.escape(column)}\b"
    return re.sub(target, f"{names[0]}.{column}", sql, flags=re.IGNORECASE)


def explain_sql(spark: SparkSession, sql: str) -> str:
    """What a statement does, in a few English sentences."""
    try:
        s = parse(spark, sql)
    except ParseException:
        return "This statement could not be parsed."
    tables = list(dict.fromkeys(s.tables))
    parts = [f"Shows {', '.join(s.outputs) if s.outputs and s.outputs != ['*'] else 'all columns'}" + (f" from {', '.join(tables)}" if tables else "")]
    if s.nodes["Join"]:
        parts.append(f"combining them with {s.nodes['Join']} join{'s' * (s.nodes['Join'] > 1)}")
    if s.filters:
        parts.append("where " + " and ".join(s.filters))
    if s.groups:
        parts.append("for each " + ", ".join(s.groups))
    if s.orders:
        parts.append("sorted by " + ", ".join(s.orders))
    if s.limits:
        parts.append(f"at most {s.limits[0]} rows")
    return (", ".join(parts) + ".").replace("`", "")
