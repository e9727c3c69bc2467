"""Guarded, read-only execution of SQL text with a row cap and a time limit."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cell_text, is_read_only
from ..plans import parsed

#: Row caps and time limits of evaluation, of the interactive path and of validation (fixed values).
EVAL_ROWS, EVAL_SECONDS, ASK_ROWS, ASK_SECONDS, CHECK_SECONDS, SYNTHETIC_SECONDS = 100_000, 3.0, 200, 5.0, 2.0, 0.5


@dataclass(frozen=True)
class Result:
    """status is ok, unsafe, error, timeout, too_many_rows or not_run."""

    status: str
    columns: list[str] | None = None
    rows: list[tuple] | None = None
    elapsed_ms: float = 0.0
    error: str | None = None


def gate(spark: SparkSession, sql: str) -> tuple[str, str | None]:
    """("ok", None) if the text is one statement that only reads: by its first word, by every plan node, and by
    the relations and functions it names, which must be views of the session and harmless built-ins."""
    import re

    if not re.match(r"^\s*(SELECT|WITH)\b", sql or "", re.I):
        return "unsafe", "not a SELECT or WITH statement"
    try:
        statement = parsed.parse(spark, sql)
        found = parsed.unsafe_nodes(statement) + parsed.reaches_outside(spark, statement)
    except ParseException as e:
        return "error", e.getCondition() or "PARSE_SYNTAX_ERROR"
    return ("unsafe", "not read-only: " + ", ".join(found)) if found else ("ok", None)


def guarded(spark: SparkSession, sql: str) -> DataFrame:
    """The statement as a DataFrame, without running it; raises ValueError if it isn't read-only."""
    status, why = gate(spark, sql)
    if status != "ok":
        raise ValueError(f"{status}: {why}")
    return spark.sql(sql)


def confined(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A session of its own in which only the given tables are views, files are no tables, and double quotes
    stand around names."""
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    for name, df in tables.items():
        own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    return own


def run(spark: SparkSession, sql: str, rows: int = ASK_ROWS, seconds: float = ASK_SECONDS) -> Result:
    """Runs a statement; over ``rows`` rows there are none, over ``seconds`` its jobs are cancelled."""
    began = time.monotonic()
    status, why = gate(spark, sql)
    if status != "ok":
        return Result(status, error=why)
    sc, tag, late = spark.sparkContext, f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        df = spark.sql(sql)
        found = df.limit(rows + 1).collect()
    except (AnalysisException, ParseException) as e:
        return Result("error", elapsed_ms=_ms(began), error=e.getCondition() or str(e)[:200])
    except Exception as e:  # noqa: BLE001 - whatever a statement raises is its result
        if late.is_set():
            return Result("timeout", elapsed_ms=_ms(began), error=f"over {seconds} s")
        condition = e.getCondition() if isinstance(e, PySparkException) else None
        return Result("error", elapsed_ms=_ms(began), error=condition or str(e)[:200])
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    if len(found) > rows:
        return Result("too_many_rows", df.columns, None, _ms(began), f"over {rows} rows")
    return Result("ok", df.columns, [tuple(r) for r in found], _ms(began))


def _ms(began: float) -> float:
    return round((time.monotonic() - began) * 1000, 3)


def validate(spark: SparkSession, sql: str, seconds: float = CHECK_SECONDS) -> Result:
    """Runs a statement for its first row only."""
    status, why = gate(spark, sql)
    if status != "ok":
        return Result(status, error=why)
    out = run(spark, f"SELECT * FROM ({sql.strip().rstrip(';')}) LIMIT 1", 1, seconds)
    return Result(out.status, out.columns, None, out.elapsed_ms, out.error)


def validate_many(spark: SparkSession, statements: Iterable[str], threads: int = 4) -> list[Result]:
    """Each distinct statement once, several at a time, results in the order asked; one without a result is
    an error."""
    asked = list(statements)
    with ThreadPoolExecutor(threads) as pool:
        found = dict(zip(dict.fromkeys(asked), pool.map(lambda s: validate(spark, s), dict.fromkeys(asked)), strict=True))
    if missing := [s for s in asked if found.get(s) is None]:
        raise ValueError(f"{len(missing)} statements have no result")
    return [found[s] for s in asked]


def validate_synthetic(spark: SparkSession, tables: dict[str, str], sql: str, seconds: float = SYNTHETIC_SECONDS) -> str:
    """The status of a statement against scratch tables given as queries, in a session of their own."""
    if not gate(spark, sql)[0] == "ok":
        return "not_read_only_or_missing" if gate(spark, sql)[0] == "unsafe" else "non_query_target"
    own = spark.newSession()
    try:
        for name, query in tables.items():
            own.sql(query).createOrReplaceTempView(name)
    except Exception:  # noqa: BLE001
        return "context_execution_error"
    if not tables:
        return "empty_schema"
    status = validate(own, sql, seconds).status
    return {"ok": "accepted", "timeout": "target_timeout"}.get(status, "target_execution_error")


def row_json(df: DataFrame, places: int = 8) -> DataFrame:
    """One column, row_json: the cells by position, doubles rounded, nulls kept, names ignored."""
    cells = []
    for k, (c, kind) in enumerate(df.dtypes):
        x = F.col(f"`{c}`")
        cells.append((F.bround(x.cast("double"), places) if kind in ("double", "float") else F.lower(F.hex(x)) if kind == "binary" else x).alias(f"c{k}"))
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("row_json"))


def result_signature(df: DataFrame, ordered: bool = False) -> str:
    """A digest of a result: column count, row count and, as sums of their SHA-256, the bag of rows; with the
    place of each row if the order counts (the result is then numbered in one task, so it should be capped)."""
    rows = row_json(df)
    text = F.col("row_json")
    if ordered:
        rows = numbered(rows)
        text = F.concat("at", F.lit(":"), "row_json")
    digest = F.sha2(text, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha256(repr((len(df.columns), *found)).encode()).hexdigest()


def numbered(df: DataFrame) -> DataFrame:
    """Rows with their place ``at`` in the result, from 1. All go through one task, so this is for results
    under a row cap."""
    return df.withColumn("at", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def json_rows(result: Result, ordered: bool) -> list[str] | None:
    """The rows of a result as JSON arrays, bytes as {"bytes_hex": ...}, sorted unless the order counts."""
    if result.rows is None:
        return None

    def plain(v: object) -> object:
        return {"bytes_hex": bytes(v).hex()} if isinstance(v, (bytes, bytearray)) else v

    rows = [json.dumps([plain(v) for v in r], ensure_ascii=False, default=str) for r in result.rows]
    return rows if ordered else sorted(rows)


def decoded_rows(rows: Iterable[str] | None) -> list[tuple] | None:
    """The cells of rows written by json_rows: bytes again as bytes, nested values as tagged JSON text; None if
    a row is no JSON."""
    out = []
    for text in rows if rows is not None else ():
        try:
            values = json.loads(text)
        except (TypeError, json.JSONDecodeError):
            return None
        cells = []
        for v in values if isinstance(values, list) else [values]:
            if isinstance(v, dict) and list(v) == ["bytes_hex"] and _is_hex(v["bytes_hex"]):
                v = bytes.fromhex(v["bytes_hex"])
            elif isinstance(v, (dict, list)):
                v = ("json", json.dumps(v, sort_keys=True, ensure_ascii=False))
            cells.append(v)
        out.append(tuple(cells))
    return None if rows is None else out


def _is_hex(x: object) -> bool:
    return isinstance(x, str) and len(x) % 2 == 0 and set(x.lower()) <= set("0123456789abcdef")


class GoldCache:
    """Results of reference statements, kept by database, statement and order flag; the least used of
    ``most`` go first."""

    def __init__(self, spark: SparkSession, seconds: float = EVAL_SECONDS, most: int = 1_000) -> None:
        self.spark, self.seconds, self.most, self.known = spark, seconds, most, {}

    def get(self, sql: str, ordered: bool = False, db: str = "") -> Result:
        key = (db, sql, ordered)
        found = self.known.pop(key, None) or run(self.spark, sql, EVAL_ROWS, self.seconds)
        self.known[key] = found  # the last one is the one used last
        if len(self.known) > self.most:
            self.known.pop(next(iter(self.known)))
        return found


#: A sentence for each category of error (fixed values).
MESSAGES = {
    "unknown_column": "The query used a column that does not exist in this database.",
    "unknown_table": "The query used a table that does not exist in this database.",
    "ambiguous_column": "The query used a column name that exists in several tables.",
    "unknown_function": "The query used a function that is not available.",
    "syntax_error": "The query is not valid SQL.",
    "aggregate_misuse": "The query mixed grouped and ungrouped columns.",
    "non_sql_or_unsafe": "Only read-only queries are allowed.",
    "timeout": "The query took too long.",
    "too_many_rows": "The query returned too many rows.",
}


def humanize(category: str) -> str:
    return MESSAGES.get(category, "The query could not be run.")


__all__ = ["ASK_ROWS", "EVAL_ROWS", "GoldCache", "Result", "cell_text", "confined", "decoded_rows", "gate", "guarded", "humanize", "is_read_only", "json_rows", "numbered", "result_signature", "row_json", "run", "validate", "validate_many", "validate_synthetic"]
