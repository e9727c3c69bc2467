"""Schema introspection, rendering and profiling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PRIVATE

#: Types by text in the declared type, the first that fits (fixed values).
KINDS = (("number", "int|real|float|double|decimal|num"), ("time", "date|time|year"), ("boolean", "bool"))
#: Above this many characters a schema is rendered as plain DDL.
MOST_CHARS = 10_000


@dataclass(frozen=True)
class Key:
    """A declared foreign key; Spark itself knows none."""

    table: str
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class Keys:
    """What a catalog of another system declares and Spark does not keep: primary keys by table, foreign keys, and
    columns (table, column) that must not be null."""

    primary: Mapping[str, Sequence[str]] = field(default_factory=dict)
    foreign: Sequence[Key] = ()
    required: frozenset[tuple[str, str]] = frozenset()


#: Keys of the star schema and the corpus (fixed values).
FOREIGN_KEYS = (
    Key("nation", "n_regionkey", "region", "r_regionkey"),
    Key("supplier", "s_nationkey", "nation", "n_nationkey"),
    Key("customer", "c_nationkey", "nation", "n_nationkey"),
    Key("orders", "o_custkey", "customer", "c_custkey"),
    Key("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Key("lineitem", "l_partkey", "part", "p_partkey"),
    Key("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Key("labels", "doc_id", "documents", "doc_id"),
)
PRIMARY_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "documents": ["doc_id"]}
STAR = Keys(PRIMARY_KEYS, FOREIGN_KEYS)


def columns(spark: SparkSession, tables: Sequence[str], keys: Keys = STAR) -> DataFrame:
    """table_name, cid, column_name, data_type and is_pk of every column, from the catalog only."""
    rows = [(t, k, c, kind.upper(), c in keys.primary.get(t, [])) for t in sorted(tables, key=str.lower) for k, (c, kind) in enumerate(spark.table(t).dtypes)]
    return spark.createDataFrame(rows, "table_name string, cid int, column_name string, data_type string, is_pk boolean")


def found_keys(spark: SparkSession, tables: Sequence[str]) -> Keys:
    """Keys that the data itself shows, for tables that come without declarations: of each table the first column
    without nulls or repeats, and columns of another table whose name ends alike and whose values all occur
    there. One aggregation for each table, one anti join for each pair of names that fits."""
    primary, required = {}, set()
    for t in sorted(tables, key=str.lower):
        df = spark.table(t)
        plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct"))]
        row = df.agg(F.count(F.lit(1)).alias("n"), *(x for k, c in enumerate(plain) for x in (F.count(column_of(c)).alias(f"c{k}"), F.approx_count_distinct(column_of(c)).alias(f"d{k}")))).first()
        full = [c for k, c in enumerate(plain) if row[f"c{k}"] == row["n"]]
        required |= {(t, c) for c in full}
        for k, c in enumerate(plain):
            # The estimate only spares the exact count where it could not be a key.
            if c in full and row["n"] and row[f"d{k}"] >= 0.8 * row["n"] and not df.groupBy(column_of(c)).count().filter("count > 1").limit(1).count():
                primary[t] = [c]
                break
    foreign = []
    for t in sorted(tables, key=str.lower):
        for c in spark.table(t).columns:
            for other, (key,) in primary.items():
                if (t, c) != (other, key) and _tail(c) == _tail(key) and _fits(spark, t, c, other, key):
                    foreign.append(Key(t, c, other, key))
    return Keys(primary, tuple(foreign), frozenset(required))


def column_of(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _tail(name: str) -> str:
    """A column's name without a short prefix of its table."""
    head, _, rest = name.lower().partition("_")
    return rest if len(head) <= 2 and rest else name.lower()


def _fits(spark: SparkSession, table: str, c: str, other: str, key: str) -> bool:
    a = spark.table(table).select(column_of(c).alias("k")).filter("k is not null").distinct()
    b = spark.table(other).select(column_of(key).alias("k"))
    return a.limit(1).count() == 1 and not a.join(b, "k", "left_anti").limit(1).count()


def quoted(name: str, mark: str = '"') -> str:
    """A name in quotes, with quotes inside it doubled."""
    return mark + name.replace(mark, mark + mark) + mark


def kind_of(declared: Column) -> Column:
    out = F.lit("text")
    for kind, pattern in reversed(KINDS):
        out = F.when(F.lower(declared).rlike(pattern), kind).otherwise(out)
    return out


def profile(df: DataFrame, name: str) -> DataFrame:
    """A row for each column: rows, distinct values, nulls, null percent, cardinality ratio.

    One aggregation over the whole table, then turned into rows; the scan reads every column once. (Counting
    cells as rows of column and value took twice as long: the values had to become text.)
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "array"))]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(plain):
        aggs += [F.count_distinct(column_of(c)).alias(f"d{k}"), F.count(column_of(c)).alias(f"c{k}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"d{k}").alias("distinct_count"), (F.col("n") - F.col(f"c{k}")).alias("null_count")) for k, c in enumerate(plain)))
    out = df.agg(*aggs).select("n", F.explode(rows).alias("r")).select(F.lit(name).alias("table_name"), "r.column_name", F.col("n").alias("row_count"), "r.distinct_count", "r.null_count")
    return out.withColumn("null_pct", F.coalesce(F.bround(100.0 * F.col("null_count") / F.nullif("row_count", F.lit(0)), 2), F.lit(0.0))).withColumn("cardinality_ratio", F.coalesce(F.bround(F.col("distinct_count") / F.nullif("row_count", F.lit(0)), 4), F.lit(0.0)))


def profile_tables(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """The profile of every table that can be read; one that cannot is left out."""
    found = []
    for t in tables:
        try:
            found.append(profile(spark.table(t), t))
        except AnalysisException:
            continue
    if not found:
        raise ValueError("none of the tables can be read")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ddl(spark: SparkSession, tables: Sequence[str], keys: Keys = STAR) -> DataFrame:
    """table_name and its CREATE TABLE text, with declared keys."""
    out = []
    for t in sorted(tables, key=str.lower):
        pk = list(keys.primary.get(t, []))
        lines = [f"    {quoted(c)} {kind.upper() or 'ANY'}" + (" NOT NULL" if (t, c) in keys.required else "") + (" PRIMARY KEY" if pk == [c] else "") for c, kind in spark.table(t).dtypes]
        if len(pk) > 1:
            lines.append("    PRIMARY KEY (" + ", ".join(map(quoted, pk)) + ")")
        lines += [f"    FOREIGN KEY ({quoted(k.column)}) REFERENCES {quoted(k.ref_table)} ({quoted(k.ref_column)})" for k in keys.foreign if k.table == t]
        out.append((t, f"CREATE TABLE {quoted(t)} (\n" + ",\n".join(lines) + "\n);"))
    return spark.createDataFrame(out, "table_name string, ddl string")


def compact_ddl(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    rows = [(t, f"CREATE TABLE {t} ({', '.join(spark.table(t).columns)});") for t in sorted(tables, key=str.lower)]
    return spark.createDataFrame(rows, "table_name string, ddl string")


def examples(df: DataFrame, k: int = 5) -> dict[str, list[str]]:
    """Up to k sample values of each column, the smallest distinct ones: none if one is over 50 characters
    long or looks private, one if one is over 20 or a date. k passes, each of which finds the next value of
    all columns, without a shuffle of the rows."""
    kinds = {c: kind for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary", "variant"))}
    found: dict[str, list] = {c: [] for c in kinds}
    for _ in range(k):
        open_ = [c for c in kinds if found[c] is not None and (not found[c] or found[c][-1] is not None)]
        if not open_:
            break
        nexts = []
        for n, c in enumerate(open_):
            x = column_of(c)
            usable = x.isNotNull() & (x.cast("string") != "")
            nexts.append(F.min(F.when(usable & (x > found[c][-1] if found[c] else F.lit(True)), x)).alias(f"v{n}"))
        row = df.agg(*nexts).first()
        for n, c in enumerate(open_):
            found[c].append(row[f"v{n}"])
    out = {c: [] for c in df.columns}
    for c, kind in kinds.items():
        values = [str(v).lower() if isinstance(v, bool) else str(v) for v in found[c] if v is not None]
        longest = max(map(len, values), default=0)
        private = any(re.search(PRIVATE, v) for v in values)
        out[c] = values[: 0 if private or longest > 50 else 1 if longest > 20 or "date" in kind or "timestamp" in kind else k]
    return out


def mschema(spark: SparkSession, db: str, tables: Sequence[str], k: int = 3, keys: Keys = STAR) -> str:
    """The compact schema text with types, keys and sample values; plain DDL if that is too long."""
    lines = [f"【DB_ID】 {db}", "【Schema】"]
    for t in sorted(tables, key=str.lower):
        df = spark.table(t)
        samples = examples(df, k)
        rows = [f"({c}:{kind.split('(')[0].upper()}" + (", Primary Key" if c in keys.primary.get(t, []) else "") + (f", Examples: [{', '.join(samples[c])}]" if samples[c] else "") + ")" for c, kind in df.dtypes]
        lines += [f"# Table: {t}", "[", ",\n".join(rows), "]"]
    named = [f"{k.table}.{k.column}={k.ref_table}.{k.ref_column}" for k in keys.foreign if k.table in tables and k.ref_table in tables]
    text = "\n".join([*lines, "【Foreign keys】", *named])
    return text if len(text) <= MOST_CHARS else "\n".join(r["ddl"] for r in compact_ddl(spark, tables).collect())


def schema_terms(spark: SparkSession, tables: Sequence[str]) -> list[str]:
    """Tables, columns and table.column, in order."""
    out = []
    for t in sorted(tables):
        out.append(t)
        for c in spark.table(t).columns:
            out += [c, f"{t}.{c}"]
    return out


def global_columns(spark: SparkSession, tables: Sequence[str], keys: Keys = STAR) -> DataFrame:
    """Global column ids from 1 (0 stands for *): column_id, table_name, column_name, kind."""
    rows, n = [(0, None, "*", "text")], 0
    for t, _, c, declared, _ in (tuple(r) for r in columns(spark, tables, keys).orderBy("table_name", "cid").collect()):
        n += 1
        kind = next((k for k, p in KINDS if any(x in declared.lower() for x in p.split("|"))), "text")
        rows.append((n, t, c, kind))
    return spark.createDataFrame(rows, "column_id int, table_name string, column_name string, kind string")


def global_keys(spark: SparkSession, tables: Sequence[str], keys: Keys = STAR) -> DataFrame:
    """Keys by global column ids: kind ("primary" or "foreign"), column_id, and ref_id of foreign ones."""
    ids = global_columns(spark, tables, keys)
    at = {(r["table_name"], r["column_name"]): r["column_id"] for r in ids.collect()}
    rows = [("primary", at[t, c], None) for t in sorted(tables, key=str.lower) for c in keys.primary.get(t, []) if (t, c) in at]
    rows += [("foreign", at[k.table, k.column], at[k.ref_table, k.ref_column]) for k in keys.foreign if (k.table, k.column) in at and (k.ref_table, k.ref_column) in at]
    return spark.createDataFrame(rows, "kind string, column_id int, ref_id int")


def fk_coverage(spark: SparkSession, tables: Sequence[str], keys: Keys = STAR) -> DataFrame:
    """One row: tables, tables that a key touches, and their share."""
    touched = {x for k in keys.foreign if k.table in tables and k.ref_table in tables for x in (k.table, k.ref_table)}
    return spark.createDataFrame([(len(tables), len(touched), round(100 * len(touched) / max(1, len(tables)), 1))], "n_tables int, n_touched int, coverage_pct double")


def sentences(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """A sentence for each table that names its columns."""
    rows = [(t, f"Table {t} has the columns " + ", ".join(f"{c} ({kind})" for c, kind in spark.table(t).dtypes) + ".") for t in sorted(tables)]
    return spark.createDataFrame(rows, "table_name string, sentence string")
