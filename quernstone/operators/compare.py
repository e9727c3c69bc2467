"""Comparison of result sets as DataFrame algebra: bags, ordered rows, and equality up to column order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_order_by, repair_operators, strip_distinct
from .execute import EVAL_ROWS, EVAL_SECONDS, Result, guarded, numbered, row_json, run


def _difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*keys, F.lit(0), F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left <> n_right")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (as JSON) whose number differs, with n_left and n_right. One shuffle of partial counts."""
    return _difference(row_json(left), row_json(right), ["row_json"])


def strict_equal(left: DataFrame, right: DataFrame, ordered: bool = False) -> bool:
    """Equal column counts and equal rows, compared as JSON text, so 1 and 1.0 differ. Where the order counts,
    rows are compared with their places; such results should be capped."""
    if len(left.columns) != len(right.columns):
        return False
    a, b = row_json(left), row_json(right)
    found = _difference(numbered(a), numbered(b), ["at", "row_json"]) if ordered else _difference(a, b, ["row_json"])
    return found.limit(1).count() == 0


def rows_match(left: DataFrame, right: DataFrame) -> bool:
    """Equal bags, whatever the order; null equals null."""
    return len(left.columns) == len(right.columns) and bag_difference(left, right).limit(1).count() == 0


def _plain(df: DataFrame) -> DataFrame:
    """Columns by position; numbers as doubles, so that 1 equals 1.0, all else as text."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    cells = []
    for k, (c, kind) in enumerate(df.dtypes):
        x = F.col(f"`{c}`")
        number = kind in numbers or kind.startswith("decimal")
        cells.append(F.when(x.isNotNull(), F.concat(F.lit("n:"), F.bround(x.cast("double"), 8).cast("string")) if number else F.concat(F.lit("s:"), x.cast("string"))).alias(f"c{k}"))
    return df.select(cells)


def _fingerprints(df: DataFrame) -> list[tuple]:
    """For each column a digest of its bag of values."""
    aggs = [x for c in df.columns for x in (F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]
    row = df.agg(*aggs).first()
    return [(row[f"s_{c}"], row[f"n_{c}"]) for c in df.columns]


def _alike(df: DataFrame, choices: list[list[int]]) -> dict[int, int]:
    """For each column of df the first one that holds the same in every row; only columns that are choices
    for one place are compared."""
    pairs = sorted({(i, j) for found in choices for i in found for j in found if i < j})
    kind = {j: j for j in range(len(df.columns))}
    if pairs:
        row = df.agg(*(F.count_if(~F.col(f"c{i}").eqNullSafe(F.col(f"c{j}"))).alias(f"d{n}") for n, (i, j) in enumerate(pairs))).first()
        for n, (i, j) in enumerate(pairs):
            if not row[f"d{n}"]:
                kind[j] = min(kind[j], kind[i])
    return kind


def compatible_equal(left: DataFrame, right: DataFrame, ordered: bool = False) -> bool:
    """Equal under one order of the columns. Two empty results are equal whatever their columns.

    The search backtracks over columns not yet used, the place with the fewest choices first. Of columns
    that hold the same in every row one is tried, and an order is given up as soon as the columns chosen
    so far differ as results of their own. There is no cap.
    """
    n, m = left.count(), right.count()
    if n == 0 and m == 0:
        return True
    if n != m or len(left.columns) != len(right.columns):
        return False
    a, b = _plain(left), _plain(right)
    fa, fb = _fingerprints(a), _fingerprints(b)
    if sorted(map(str, fa)) != sorted(map(str, fb)):
        return False
    choices = [[j for j, y in enumerate(fb) if y == x] for x in fa]
    places = sorted(range(len(choices)), key=lambda k: len(choices[k]))
    kind = _alike(b, choices)

    def fit(order: list[int]) -> bool:
        x, y = ([F.col(f"c{j}").alias(f"c{k}") for k, j in enumerate(js)] for js in (places[: len(order)], order))
        return strict_equal(a.select(*x), b.select(*y), ordered)

    def search(order: list[int]) -> bool:
        if len(order) == len(places):
            return fit(order)
        found = {kind[j]: j for j in choices[places[len(order)]] if j not in order}.values()
        for j in found:
            longer = [*order, j]
            if (len(found) == 1 or len(longer) == len(places) or fit(longer)) and search(longer):
                return True
        return False

    return search([])


def prepare_compatible(sql: Column) -> Column:
    """The text that compatible comparison runs: operators joined, DISTINCT left out."""
    return strip_distinct(repair_operators(sql))


def score(spark: SparkSession, gold: str, predicted: str, seconds: float = EVAL_SECONDS, rows: int = EVAL_ROWS) -> dict[str, object]:
    """Both metrics of one prediction: the statuses of both statements, whether they match strictly (the order
    counts if the reference statement has ORDER BY), and whether they match compatibly (split operators
    joined, DISTINCT left out, any one order of the columns)."""
    one = spark.range(1).select(has_order_by(F.lit(gold)).alias("o"), *(prepare_compatible(F.lit(x)).alias(k) for k, x in (("g", gold), ("p", predicted)))).first()
    first, second = (run(spark, x, rows, seconds) for x in (gold, predicted))
    strict = _both_ok(first, second) and strict_equal(guarded(spark, gold), guarded(spark, predicted), one["o"])
    loose = [run(spark, one[k], rows, seconds) for k in ("g", "p")]
    compatible = _both_ok(*loose) and compatible_equal(guarded(spark, one["g"]), guarded(spark, one["p"]), one["o"])
    return {"gold_status": first.status, "status": second.status, "strict": strict, "compatible": compatible}


def _both_ok(*results: Result) -> bool:
    return all(r.status == "ok" for r in results)


def signatures(rows: DataFrame, example: str, candidate: str, cells: list[str], distinct: bool = False) -> DataFrame:
    """(example, candidate, signature): a digest of each candidate's rows; with ``distinct`` of their set."""
    row = F.to_json(F.struct(*(F.col(c) for c in cells)), {"ignoreNullFields": "false"})
    gathered = F.collect_set(row) if distinct else F.collect_list(row)
    return rows.groupBy(example, candidate).agg(F.sha2(F.array_join(F.array_sort(gathered), "\n"), 256).alias("signature"))


def ordered_rows(df: DataFrame, *by: str) -> DataFrame:
    """Rows with their place under an explicit order, for ordered comparison on large inputs."""
    return df.withColumn("at", F.row_number().over(Window.orderBy(*by)))
