"""Structure of SQL text as column expressions: features, tiers, joins, taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_sql

AGGREGATE = r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\("
SET_OPERATION = r"\b(UNION|INTERSECT|EXCEPT)\b"


def _n(upper: Column, pattern: str) -> Column:
    return F.regexp_count(upper, F.lit(pattern)).cast("int")


def query_features(sql: Column) -> dict[str, Column]:
    """Counts and flags of a statement, and its complexity by a weighted score."""
    text = normalize_sql(sql)
    found = _found(text, F.upper(text))
    return found | {"complexity_proxy": _complexity(found)}


def with_features(df: DataFrame, sql: Column) -> DataFrame:
    """The table with the same features as columns. Text, upper case and features are steps of their own, so each
    is computed once for a row, however often later expressions name it."""
    texts = df.withColumn("__text", normalize_sql(sql)).withColumn("__upper", F.upper("__text"))
    out = texts.withColumns(_found(F.col("__text"), F.col("__upper"))).drop("__text", "__upper")
    return out.withColumn("complexity_proxy", _complexity({k: F.col(k) for k in out.columns}))


def _found(text: Column, upper: Column) -> dict[str, Column]:
    counts = {"select_count": r"\bSELECT\b", "join_count": r"\bJOIN\b", "set_operation_count": SET_OPERATION, "aggregate_count": AGGREGATE}
    flags = {"has_group_by": r"\bGROUP\s+BY\b", "has_order_by": r"\bORDER\s+BY\b", "has_having": r"\bHAVING\b", "has_where": r"\bWHERE\b", "has_limit": r"\bLIMIT\b", "has_distinct": r"\bDISTINCT\b"}
    out = {"token_count": F.size(F.split(text, r"\s+")).cast("int")}
    out |= {k: _n(upper, p) for k, p in counts.items()}
    out["has_subquery"] = out["select_count"] > 1
    return out | {k: upper.rlike(p) for k, p in flags.items()}


def _complexity(out: dict[str, Column]) -> Column:
    score = (
        out["join_count"]
        + 2 * out["has_subquery"].cast("int")
        + 2 * out["set_operation_count"]
        + sum((out[k].cast("int") for k in ("has_group_by", "has_having", "has_order_by")), F.lit(0))
        + (out["aggregate_count"] > 1).cast("int")
    )
    return F.when(score <= 1, "simple").when(score <= 3, "moderate").otherwise("complex")


def matched_features(f: dict[str, Column]) -> Column:
    """The tags of a statement, from its features."""
    subquery = F.coalesce(f["has_subquery"], F.lit(False))
    tests = {
        "aggregation": f["aggregate_count"] > 0,
        "multiple_aggregates": f["aggregate_count"] > 1,
        "join": f["join_count"] > 0,
        "multi_join": f["join_count"] > 1,
        "set_operation": f["set_operation_count"] > 0,
        "subquery": subquery,
        "join_and_subquery": (f["join_count"] > 0) & subquery,
        "where": f["has_where"],
        "group_by": f["has_group_by"],
        "having": f["has_having"],
        "order_by": f["has_order_by"],
        "limit": f["has_limit"],
        "distinct": f["has_distinct"],
    }
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))


def clause_flags(sql: Column) -> dict[str, Column]:
    """Which clauses and operators a statement uses."""
    upper = F.upper(sql)
    words = {"join": r"\bJOIN\b", "group_by": r"\bGROUP\s+BY\b", "order_by": r"\bORDER\s+BY\b", "having": r"\bHAVING\b", "limit": r"\bLIMIT\b", "distinct": r"\bDISTINCT\b", "union": r"\bUNION\b", "intersect": r"\bINTERSECT\b", "except": r"\bEXCEPT\b", "aggregation": AGGREGATE, "where": r"\bWHERE\b", "like": r"\bLIKE\b", "between": r"\bBETWEEN\b", "in": r"\bIN\s*\("}
    return {f"has_{k}": upper.rlike(p) for k, p in words.items()} | {"has_subquery": _n(upper, "SELECT") > 1}


def complexity_tier(sql: Column) -> Column:
    f = clause_flags(sql)
    parts = [f[f"has_{k}"] for k in ("join", "subquery", "group_by", "having", "union", "intersect", "except")] + [_n(F.upper(sql), r"\bJOIN\b") > 1]
    score = sum((p.cast("int") for p in parts), F.lit(0))
    return F.when(score == 0, "simple").when(score == 1, "moderate").when(score <= 3, "complex").otherwise("extra")


def hardness(sql: Column) -> Column:
    upper = F.upper(sql)
    joins = _n(upper, r"\bJOIN\b")
    nested, combined = _n(upper, r"\bSELECT\b") > 1, upper.rlike(SET_OPERATION)
    components = _n(upper, r"\bWHERE\b") + _n(upper, r"\bGROUP\s+BY\b") + _n(upper, r"\bORDER\s+BY\b") + joins
    hard = nested | combined | (components >= 4) | (joins >= 2)
    extra = nested & (combined | (joins >= 2) | (components >= 3))
    medium = (components >= 2) | (joins == 1) | upper.rlike(AGGREGATE)
    return F.when(hard & extra, "extra hard").when(hard, "hard").when(medium, "medium").otherwise("easy")


def table_refs(sql: Column) -> Column:
    """Names after FROM and JOIN in order of first mention, as first spelled; case does not tell them apart."""
    found = F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_]\w*)"), 1)
    lower = F.transform(found, F.lower)
    return F.filter(found, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def join_types(sql: Column) -> Column:
    """The kind of each join in order; a bare JOIN is INNER."""
    found = F.regexp_extract_all(F.upper(sql), F.lit(r"\b((?:INNER|LEFT|RIGHT|FULL|CROSS)?(?:\s+OUTER)?\s*JOIN)\b"), 1)

    def kind(x: Column) -> Column:
        first = F.regexp_extract(x, r"^(INNER|LEFT|RIGHT|FULL|CROSS)", 1)
        return F.when(first == "", "INNER").otherwise(first)

    return F.transform(found, kind)


def join_conditions(sql: Column) -> Column:
    """Column pairs after ON, each as left=right."""
    pattern = F.lit(r"(?i)\bON\s+([A-Za-z_]\w*\.[A-Za-z_]\w*\s*=\s*[A-Za-z_]\w*\.[A-Za-z_]\w*)")
    return F.transform(F.regexp_extract_all(sql, pattern, 1), lambda x: F.regexp_replace(x, r"\s*=\s*", "="))


#: Operators looked for in a WHERE clause (fixed values).
WHERE_OPERATORS = {
    "=": r"(?<![<>!=])=(?!=)",
    ">": r"(?<![<>])>(?!=)",
    "<": r"(?<![<>])<(?!=)",
    ">=": r">=",
    "<=": r"<=",
    "!=/<>": r"(?:!=|<>)",
    "LIKE": r"(?i)\bLIKE\b",
    "IN": r"(?i)\bIN\s*\(",
    "BETWEEN": r"(?i)\bBETWEEN\b",
    "IS NULL": r"(?i)\bIS\s+NULL\b",
}


def where_operators(sql: Column) -> Column:
    """The operators that occur in the WHERE clause."""
    clause = F.regexp_extract(sql, r"(?is)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|$)", 1)
    return F.array_compact(F.array(*(F.when(clause.rlike(p), name) for name, p in WHERE_OPERATORS.items())))


def subquery_locations(sql: Column) -> Column:
    """For each nested SELECT the clause keyword nearest before it."""
    pieces = F.split(F.upper(sql), r"\bSELECT\b")
    # What comes before the n-th nested SELECT ends with piece n; SELECT itself stands before each piece.
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))

    def nearest(x: Column) -> Column:
        word = F.regexp_extract(x, r"(?s)^.*(WHERE|HAVING|FROM|AND|OR|ON)", 1)
        return F.when(word == "", "SELECT").otherwise(word)

    return F.transform(inner, nearest)


def relation_topology(tables: Column, joins: Column) -> Column:
    return (
        F.when(tables <= 1, "single")
        .when(tables == 2, "binary")
        .when(joins >= tables, "mesh")
        .when((tables >= 4) & (joins == tables - 1), "chain_or_star")
        .when(joins == tables - 1, "chain")
        .otherwise("partial")
    )


def primary_outcome(match: Column, status: Column, valid: Column) -> Column:
    return (
        F.when(F.coalesce(match, F.lit(False)), "correct")
        .when(status == "unsafe", "non_sql_or_unsafe")
        .when(~F.coalesce(valid, F.lit(False)), "invalid_sql")
        .when(F.coalesce(status, F.lit("")) != "ok", "database_execution_error")
        .otherwise("executable_wrong_result")
    )


def format_issue(raw: Column, predicted: Column, compliant: Column) -> Column:
    raw, predicted = F.trim(F.coalesce(raw, F.lit(""))), F.trim(F.coalesce(predicted, F.lit("")))
    before = F.regexp_extract(raw, r"(?is)^(.*?)\b(?:SELECT|WITH)\b", 1)
    found = raw.rlike(r"(?i)\b(SELECT|WITH)\b")
    return (
        F.when(F.coalesce(compliant, F.lit(False)), "compliant")
        .when(raw.contains("```"), "markdown_fence")
        .when(~found, "no_sql_in_response")
        .when(F.length(before) > 0, "prose_before_sql")
        .when(raw != predicted, "trailing_text_or_multiple_statements")
        .otherwise("other_format_issue")
    )


#: Text in an error, and the category it stands for, the first that fits (fixed values).
ERROR_TEXTS = (
    ("no such column", "unknown_column"),
    ("unresolved_column", "unknown_column"),
    ("ambiguous column name", "ambiguous_column"),
    ("ambiguous_reference", "ambiguous_column"),
    ("no such table", "unknown_table"),
    ("table_or_view_not_found", "unknown_table"),
    ("no such function", "unknown_function"),
    ("unresolved_routine", "unknown_function"),
    ("misuse of aggregate", "aggregate_misuse"),
    ("aggregate functions are not allowed", "aggregate_misuse"),
    ("missing_aggregation", "aggregate_misuse"),
    ("missing_group_by", "aggregate_misuse"),
    ("selects to the left and right", "set_operation_shape_mismatch"),
    ("num_columns_mismatch", "set_operation_shape_mismatch"),
    ("syntax error", "syntax_error"),
    ("parse_syntax_error", "syntax_error"),
    ("circular reference", "circular_reference"),
)


def error_category(status: Column, error: Column) -> Column:
    """The category of a failed statement, from its status and error text or condition."""
    out, text = F.lit("other_database_error"), F.lower(F.coalesce(error, F.lit("")))
    for needle, label in reversed(ERROR_TEXTS):
        out = F.when(text.contains(needle), label).otherwise(out)
    return F.when(status == "unsafe", "non_sql_or_unsafe").when(status.isin("timeout", "too_many_rows"), status).otherwise(out)


def taxonomy(match: Column, valid: Column, status: Column, error: Column) -> Column:
    kind = error_category(status, error)
    return (
        F.when(F.coalesce(match, F.lit(False)), "correct")
        .when(~F.coalesce(valid, F.lit(True)), "syntax_error")
        .when(kind == "unknown_column", "hallucinated_column")
        .when(kind == "unknown_table", "hallucinated_table")
        .when(kind == "ambiguous_column", "ambiguous_column")
        .when(status == "ok", "semantic_mismatch")
        .otherwise("other_execution_error")
    )


def gold_features(sql: Column) -> dict[str, Column]:
    """What error reports slice by: joins, grouping, a nested query in brackets, and over 31 words."""
    joins = _n(sql, r"(?i)\bJOIN\b")
    nested = sql.rlike(r"(?i)\(\s*SELECT\b")
    words = F.size(F.split(F.trim(sql), r"\s+"))
    return {
        "has_join": joins >= 1,
        "multiple_joins": joins >= 2,
        "has_group_by": sql.rlike(r"(?i)\bGROUP\s+BY\b"),
        "has_subquery": nested,
        "join_and_subquery": (joins >= 1) & nested,
        "long_sql": words > 31,
        "join_count": joins,
        "token_count": words,
    }


def missing_name(error: Column) -> dict[str, Column]:
    """The column and the table that an error message says do not exist, or null."""
    column = F.regexp_extract(error, r"(?i)no such column:\s*([^\s,;]+)", 1)
    spark_column = F.regexp_extract(error, r"(?is)UNRESOLVED_COLUMN.*?name `?([\w.`]+?)`? cannot", 1)
    table = F.regexp_extract(error, r"(?i)no such table:\s*([^\s,;]+)", 1)
    spark_table = F.regexp_extract(error, r"(?is)TABLE_OR_VIEW_NOT_FOUND.*?view `?([\w.`]+?)`? cannot", 1)

    def first(a: Column, b: Column) -> Column:
        return F.nullif(F.replace(F.when(a != "", a).otherwise(b), F.lit("`"), F.lit("")), F.lit(""))

    return {"column": first(column, spark_column), "table": first(table, spark_table)}
