"""Readers: Parquet with checks, JSON lines, CSV logs, statement lists, parallel files, catalogs."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def annotations(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """db_id, question and query, trimmed; an empty field or a wrong number of rows is an error."""
    df = spark.read.parquet(path).select(*(F.trim(c).alias(c) for c in ("db_id", "question", "query")))
    bad = F.count_if(F.exists(F.array("db_id", "question", "query"), lambda x: F.coalesce(x, F.lit("")) == ""))
    found = df.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).first()
    if found["bad"] or (rows is not None and found["n"] != rows):
        raise ValueError(f"{path}: {found['n']} rows, {found['bad']} with an empty field")
    return df


def parquet_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, which must be there."""
    df = spark.read.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df.select(*columns)


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """The rows, if labels are 0 and 1 and equally frequent."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(4).collect()}
    if set(counts) != {0, 1} or counts[0] != counts[1]:
        raise ValueError(f"labels are not balanced: {counts}")
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of small files, such as configurations: a broken line is an error that names its number."""
    lines = numbered_lines(spark, path).filter("trim(value) <> ''")
    parsed = lines.select("at", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), F.try_parse_json("value").alias("v"))
    bad = parsed.filter("v is null or is_variant_null(v) or schema_of_variant(v) not like 'OBJECT%'").orderBy("at").select("at").first()
    if bad:
        raise ValueError(f"{path}: line {bad['at'] + 1} is no JSON object")
    return parsed.orderBy("at").select("r.*")


def statement_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``statement<TAB>name`` as split (the file's name), query and db_id."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    cut = r"^(.*)\t([^\t]*)$"
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("split"), F.regexp_extract("value", cut, 1).alias("query"), F.trim(F.regexp_extract("value", cut, 2)).alias("db_id"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): lines of a file, or of the files of a folder in order of their names, by their place from 0.

    Files are split over tasks as any text. Spark numbers rows by task, in the order of the file; the sizes
    of the tasks, a number for each, reach the driver and become the places where they begin.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("__f"), F.input_file_block_start().alias("__s"), F.monotonically_increasing_id().alias("__n"), "value")
    blocks = lines.groupBy("__f", "__s").agg(F.count(F.lit(1)).alias("n"), F.min("__n").alias("first")).orderBy("__f", "__s").collect()
    rows, before = [], 0
    for r in blocks:
        rows.append((r["__f"], r["__s"], r["first"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "__f string, __s long, __first long, __before long")
    return lines.join(F.broadcast(starts), ["__f", "__s"]).select((F.col("__n") - F.col("__first") + F.col("__before")).alias("at"), "value")


def zipped(left: DataFrame, right: DataFrame, at: str = "at") -> DataFrame:
    """Rows of two numbered inputs side by side; both must have the same places."""
    both = left.join(right, at, "full")
    if n := both.filter(F.coalesce(*(F.col(c) for c in left.columns if c != at)).isNull() | F.coalesce(*(F.col(c) for c in right.columns if c != at)).isNull()).count():
        raise ValueError(f"{n} rows have no partner")
    return both


def scores_csv(spark: SparkSession, path: str, scores: Sequence[str]) -> DataFrame:
    """A CSV file with header; rows whose scores are missing or pending are left out, the rest cast."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast("double") for c in scores}).dropna(subset=list(scores))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """step, loss, learning_rate and grad_norm of the entries of a nested JSON log that have a loss."""
    schema = "log_history array<struct<step:long,loss:double,learning_rate:double,grad_norm:double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("log_history").alias("e")).select("e.*").filter("loss is not null")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """db_id and path of the tables ``<name>.parquet`` (files or folders) below a folder. A name that stands in two
    places, and a folder without any, are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder).select("path")
    tables = files.select(F.regexp_extract("path", r"^(.*?/([^/]+)\.parquet)(?:/|$)", 1).alias("path")).distinct()
    found = tables.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("db_id"), "path")
    report = found.groupBy("db_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("names"), F.max("n").alias("most")).first()
    if not report["names"]:
        raise ValueError(f"{folder} holds no tables")
    if report["most"] > 1:
        raise ValueError(f"{folder} holds tables of one name in several places")
    return found


def resolve(stored: str | None, fallbacks: Sequence[str], exists: set[str]) -> str:
    """The stored path if it exists, else the first fallback that does; a fallback may be a pattern (``*``), which
    stands for its first match in order of name."""
    for path in [stored, *fallbacks]:
        if path and path in exists:
            return path
        if path and "*" in path and (found := sorted(fnmatch.filter(exists, path))):
            return found[0]
    raise KeyError(f"none of {[stored, *fallbacks]}; there are {sorted(exists)}")


def registry(found: DataFrame, db_id: str, suffixes: Sequence[str] = (".parquet",)) -> str:
    """The path of a database by name among discovered ones (db_id, path), by the order of suffixes; an unknown one
    is a KeyError that names those there are (the first 50)."""
    rows = {r["path"]: r["db_id"] for r in found.filter(F.col("db_id") == db_id).collect()}
    for suffix in suffixes:
        for path in sorted(rows):
            if path.endswith(suffix):
                return path
    there = [r["db_id"] for r in found.select("db_id").distinct().orderBy("db_id").limit(50).collect()]
    raise KeyError(f"there is no {db_id}; there are {', '.join(there)}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The digests of files, if they are those of a manifest (name, bytes, sha256); a file that is missing, is not
    named there or differs is an error."""
    found = file_digests(spark, path).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    both = found.join(manifest.select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s")), "name", "full")
    bad = both.filter(~(F.col("bytes").eqNullSafe(F.col("b")) & F.col("sha256").eqNullSafe(F.col("s")))).select("name").limit(5).collect()
    if bad:
        raise ValueError(f"files differ from the manifest: {', '.join(r['name'] for r in bad)}")
    return found


def resume(rows: DataFrame, spark: SparkSession, done_path: str, schema: str, id: str = "id") -> DataFrame:
    """Rows whose id is not in the JSON lines written before; all rows if nothing was written yet. Output that
    cannot be read is an error, it would be done again otherwise."""
    path = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return rows
    done = spark.read.schema(schema).option("mode", "FAILFAST").json(done_path).select(id).distinct()
    return rows.join(done, id, "left_anti")
