"""Queries on tables that are large, tied or untidy in ways the driver's small ones are not."""

import hashlib
import os

import duckdb
import pytest

from quernstone import queries as catalogue
from quernstone.functions import sqlfeatures as sf
from quernstone.operators import dataset, evaluate, vote
from test_catalogue import cells

SQL = catalogue.oracle_sql()


def write(folder, name, *parts):
    """A table of several files; columns of an SQL statement each."""
    os.makedirs(folder / f"{name}.parquet")
    for k, sql in enumerate(parts):
        duckdb.connect().sql(f"COPY ({sql}) TO '{folder}/{name}.parquet/part-{k:03d}.parquet'")


def equal_to_sql(spark, folder, name):
    """In one thread DuckDB reads the files in order, so ties that the SQL leaves open go to the first row."""
    con = duckdb.connect()
    con.sql("SET threads = 1")
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}/*.parquet')")
    df = catalogue.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    return cells(df.select(columns).collect()) == cells(con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())


#: Two files; each row of the first has one of equal order, line and part in the second, which is larger, so Spark
#: reads it first.
TIED = [
    f"SELECT (i // 3)::BIGINT AS l_orderkey, (1 + i % 3)::INTEGER AS l_linenumber, CASE WHEN i % 11 = 0 THEN NULL ELSE i % 5 END::BIGINT AS l_partkey, {quantity} AS l_quantity, {flag} AS l_returnflag, {status} AS l_linestatus FROM range({n}) AS r(i)"
    for n, quantity, flag, status in ((300, "1.0 + i % 40", "substr('ANR', 1 + (i % 3)::INTEGER, 1)", "'F'"), (9000, "1.0 + i * 7 % 50", "substr('RAN', 1 + (i * 7 % 3)::INTEGER, 1)", "'O'"))
]


@pytest.mark.parametrize("name", ["published_vote", "rescore_candidates"])
def test_ties_go_to_the_first_row(spark, tmp_path, name):
    write(tmp_path, "lineitem", *TIED)
    assert equal_to_sql(spark, tmp_path, name)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_statements_of_many_candidates_need_no_shuffle(spark):
    """The results of statements go to every task; by a join on the text, all candidates of one would meet in a task."""
    rows = [(k, i, f"SELECT DISTINCT {'ab'[(k + i) % 2]} FROM t") for k in range(6) for i in range(3)]
    candidates = spark.createDataFrame(rows, "example int, idx int, sql string")
    results = spark.createDataFrame([("SELECT  a FROM t", "A", False, False)], "sql string, signature string, is_empty boolean, is_zero boolean")
    out = vote.reselect(candidates, results)
    assert {r.example: (r.chosen_idx, r.votes) for r in out.collect()} == {k: (k % 2, 2 - k % 2) for k in range(6)}
    assert "strategy=broadcast" in plan_of(out)


def test_few_known_names_need_no_shuffle(spark):
    refs = spark.createDataFrame([(k, k % 2 == 0, "table", "ab"[k % 2]) for k in range(6)], "id int, correct boolean, kind string, name string")
    known = spark.createDataFrame([("table", "A")], "kind string, name string")
    for out in (evaluate.linking_precision(refs, known), evaluate.reference_precision(refs, known)):
        assert "strategy=broadcast" in plan_of(out)
    assert {r.correct: (r.n, r.fully_grounded) for r in evaluate.linking_precision(refs, known).collect()} == {True: (3, 3), False: (3, 0)}


def test_many_statements_are_not_broadcast(spark):
    assert "strategy=broadcast" not in plan_of(spark.range(9).join(dataset.small_if(spark.range(9), 8), "id"))


def test_fingerprint_without_rows_on_the_driver(spark):
    """Ids in several tasks and pieces, repeated ones and a null; made without a job that returns them."""
    ids = [f"{k * 7919 % 1000}" for k in range(5000)]
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        out = dataset.fingerprint(rows, "id")
        assert "MapInArrow" in plan_of(out)
        assert out.first() == (hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest(), 5001)
        assert dataset.fingerprint(rows.filter("id = 'x'"), "id").first() == (hashlib.sha256(b"").hexdigest(), 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_features_are_computed_once_for_a_row(spark):
    """The features as steps of their own are the same as the expressions."""
    rows = spark.createDataFrame([(1, "SELECT count(*) FROM a JOIN b ON a.x = b.x WHERE a.y IN (SELECT 1)"), (2, None)], "id int, sql string").coalesce(1)
    old, new = rows.select("id", *(c.alias(k) for k, c in sf.query_features(rows["sql"]).items())), sf.with_features(rows, rows["sql"]).drop("sql")
    assert old.collect() == new.select(old.columns).collect()


def test_features_of_a_part_file_are_spread(spark, tmp_path):
    write(tmp_path, "part", "SELECT i AS p_partkey FROM range(2000) AS r(i)")
    out = catalogue.queries()["feature_counts_exploded"](spark, str(tmp_path))
    assert "Repartition" in plan_of(out)
    assert equal_to_sql(spark, tmp_path, "feature_counts_exploded")


def test_first_items_meet_by_order(spark, tmp_path):
    """Rows are sorted where they meet, in parts of fixed number, and not a whole split of the file at once before."""
    write(tmp_path, "lineitem", *TIED)
    for name in ("reselect_candidates", "published_vote"):
        out = catalogue.queries()[name](spark, str(tmp_path))
        assert "RepartitionByExpression" in plan_of(out)
        assert equal_to_sql(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["schema_columns", "type_histogram"])
def test_tables_of_the_folder_are_listed(spark, tmp_path, name):
    """Every table that is there, whatever its name and types, and none that is not."""
    write(tmp_path, "nation", "SELECT 1::INTEGER AS n_nationkey, 'a' AS n_name")
    write(tmp_path, "pictures", "SELECT true AS seen, DATE '2020-01-02' AS taken, 'x'::BLOB AS body, ['a'] AS tags, [1.5::FLOAT] AS v, 1.25::DECIMAL(9, 2) AS price")
    assert equal_to_sql(spark, tmp_path, name)
