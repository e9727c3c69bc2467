"""Writers: JSON lines, CSV, manifests and the column export, through Spark's atomic committers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, expect: int | None = None, mode: str = "overwrite") -> int:
    """Writes with sorted keys and returns the number of rows; fewer than expected is an error."""
    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    n = seen.get["n"]
    if expect is not None and n != expect:
        raise ValueError(f"{n} rows were written, {expect} were expected")
    return n


def append_json_lines(df: DataFrame, path: str) -> int:
    return write_json_lines(df, path, mode="append")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One CSV file with a header; meant for reports. ``columns`` picks and orders them: others are left out, those
    that are not there stay empty. Without rows the file has no header either."""
    names = columns or df.columns
    out = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names))
    out.coalesce(1).write.mode("overwrite").option("header", bool(df.limit(1).count())).csv(path)


def to_json(record: dict) -> str:
    return json.dumps(record, indent=2, sort_keys=True, ensure_ascii=False)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """A small record as an indented JSON file with sorted keys: written beside its place, then moved there, so a
    reader never meets half of it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, part = fs_path(path), fs_path(path + ".tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    try:
        stream.write(bytearray((to_json(record) + "\n").encode()))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")


def comparison(df: DataFrame, columns: list[str], memory: str = "cuda_peak.max_allocated_gib") -> DataFrame:
    """Fixed columns, with the peak memory lifted out of its struct."""
    return df.select(*columns, F.col(memory).alias("max_allocated_gib"))


def write_comparison(df: DataFrame, columns: list[str], path: str, memory: str = "cuda_peak.max_allocated_gib") -> None:
    """A comparison as JSON lines and as CSV, below ``path``."""
    out = comparison(df, columns, memory)
    write_json_lines(out, f"{path}/json")
    write_csv(out, f"{path}/csv")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of the files written below a path, in order of name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter(~F.col("name").startswith("_")).orderBy("name")


def official_columns(columns: DataFrame) -> DataFrame:
    """Global column ids from 0 (for *), by table and place."""
    return columns.withColumn("column_id", F.row_number().over(Window.orderBy("table_name", "cid")))


def official_lines(df: DataFrame, sql: str = "sql", db: str = "db_id", gold: bool = True) -> DataFrame:
    """value: one statement a line, gold ones with a tab and the database name."""
    from ..functions.text import one_line

    return df.select((F.concat(one_line(F.col(sql)), F.lit("\t"), F.col(db)) if gold else one_line(F.col(sql))).alias("value"))
