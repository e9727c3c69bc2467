"""The read-only gate, execution statuses, signatures, text extraction and comparison on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import sqlfeatures as sf
from quernstone.functions import text as tx
from quernstone.operators import compare, execute
from quernstone.plans import parsed


@pytest.fixture(scope="module")
def db(spark):
    spark.sql("SELECT * FROM VALUES (1L, 'Ada', 36L), (2L, 'Lin', 29L) AS t(id, name, age)").createOrReplaceTempView("person")
    spark.sql("SELECT 1L AS id, 1L AS parent_id").createOrReplaceTempView("child")
    return spark


@pytest.mark.parametrize(
    ("sql", "status"),
    [
        ("SELECT name FROM person", "ok"),
        ("  with a as (select 1) select * from a", "ok"),
        ("SELECT p.name FROM person p JOIN child c ON p.id = c.parent_id", "ok"),
        ("SELECT 1;", "ok"),
        ("SELECT * FROM person WHERE id IN (SELECT id FROM child) OR EXISTS (SELECT 1)", "ok"),
        ("SELECT x, row_number() OVER (ORDER BY x) FROM VALUES (1), (2) AS t(x)", "ok"),
        ("DELETE FROM person", "unsafe"),
        ("WITH a AS (SELECT 1) INSERT INTO person SELECT * FROM a", "unsafe"),
        ("DROP TABLE person", "unsafe"),
        ("FROM person INSERT INTO x SELECT *", "unsafe"),
        ("EXPLAIN SELECT 1", "unsafe"),
        ("SELECT TRANSFORM(name) USING 'cat' FROM person", "unsafe"),
        ("", "unsafe"),
        ("SELECT 1; DROP TABLE person", "error"),
        ("SELECT FROM WHERE", "error"),
        ("SELECT nope FROM person", "error"),
        ("SELECT 1 / 0", "error"),
        ("SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "unsafe"),
        ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "unsafe"),
        ("SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM person", "unsafe"),
        ("SELECT * FROM text.`/etc/hostname`", "unsafe"),
        ("WITH a AS (SELECT * FROM parquet.`/tmp`) SELECT * FROM a", "unsafe"),
        ("SELECT name FROM person WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)", "unsafe"),
        ("SELECT name, input_file_name() FROM person", "unsafe"),
        ("SELECT elsewhere.f(name) FROM person", "unsafe"),
        ("SELECT no_such_function(name) FROM person", "unsafe"),
        ("SELECT * FROM other_catalog.db.person", "unsafe"),
        ("SELECT * FROM sql_keywords()", "unsafe"),
        ("SELECT * FROM posexplode(array(1, 2))", "ok"),
        ("SELECT upper(name), count(*) FROM person GROUP BY upper(name)", "ok"),
    ],
)
def test_gate(db, sql, status):
    assert execute.run(db, sql, seconds=60).status == status


def test_caps(db):
    assert execute.run(db, "SELECT * FROM range(10)", rows=10, seconds=60).status == "ok"
    over = execute.run(db, "SELECT * FROM range(11)", rows=10, seconds=60)
    assert (over.status, over.rows) == ("too_many_rows", None)
    slow = execute.run(db, "SELECT count(*) FROM range(100000000) a CROSS JOIN range(100000) b", seconds=1)
    assert slow.status == "timeout"


def test_validation(db):
    asked = ["SELECT 1", "SELECT nope FROM person", "SELECT 1", "DELETE FROM person"]
    assert [r.status for r in execute.validate_many(db, asked, 2)] == ["ok", "error", "ok", "unsafe"]
    assert execute.validate_synthetic(db, {"p": "SELECT 1 AS a"}, "SELECT a FROM p", 60) == "accepted"
    assert execute.validate_synthetic(db, {"p": "SELECT 1 AS a"}, "SELECT b FROM p", 60) == "target_execution_error"
    assert execute.validate_synthetic(db, {"p": "SELEC"}, "SELECT b FROM p") == "context_execution_error"
    assert execute.validate_synthetic(db, {}, "SELECT 1") == "empty_schema"
    cache = execute.GoldCache(db, 60, most=2)
    assert cache.get("SELECT 1") is cache.get("SELECT 1") is not cache.get("SELECT 1", db="other")
    cache.get("SELECT 2")
    assert len(cache.known) == 2


def test_confined_session(db):
    own = execute.confined(db, {"person": db.table("person")})
    assert execute.run(own, 'SELECT "name" FROM person ORDER BY id', seconds=60).rows == [("Ada",), ("Lin",)]
    assert execute.run(own, "SELECT * FROM child", seconds=60).status == "error"
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        own.sql("SELECT * FROM text.`/etc/hostname`")


def test_scores_of_predictions(db):
    score = lambda gold, sql: tuple(compare.score(db, gold, sql, 60).values())
    assert score("SELECT name FROM person", "SELECT name FROM person ORDER BY name DESC") == ("ok", "ok", True, True)
    assert score("SELECT name FROM person ORDER BY name", "SELECT name FROM person ORDER BY name DESC") == ("ok", "ok", False, False)
    assert score("SELECT name, age FROM person", "SELECT DISTINCT age, name FROM person WHERE age > = 1") == ("ok", "error", False, True)
    assert score("SELECT name FROM person", "DROP TABLE person") == ("ok", "unsafe", False, False)


def test_rows_as_json():
    result = execute.Result("ok", ["a", "b"], [(2, b"\x01"), (1, None)])
    rows = execute.json_rows(result, ordered=False)
    assert rows == ['[1, null]', '[2, {"bytes_hex": "01"}]']
    assert execute.decoded_rows(rows) == [(1, None), (2, b"\x01")]
    assert execute.json_rows(result, ordered=True)[0].startswith("[2")
    assert execute.decoded_rows(['[{"b": 1, "a": [2]}]', "3"]) == [(("json", '{"a": [2], "b": 1}'),), (3,)]
    assert execute.decoded_rows(["{"]) is None and execute.decoded_rows(None) is None
    assert execute.json_rows(execute.Result("error"), False) is None


def test_comparison(db):
    q = db.sql
    by_id, by_name = q("SELECT name FROM person ORDER BY id"), q("SELECT name FROM person ORDER BY id DESC")
    assert compare.strict_equal(by_id, by_name) and not compare.strict_equal(by_id, by_name, ordered=True)
    a, b = q("SELECT name, age FROM person"), q("SELECT age, name FROM person")
    assert not compare.strict_equal(a, b) and compare.compatible_equal(a, b)
    assert compare.compatible_equal(q("SELECT 1970"), q("SELECT 1970.0")) and not compare.strict_equal(q("SELECT 1970"), q("SELECT 1970.0D"))
    assert compare.compatible_equal(q("SELECT 1 WHERE false"), q("SELECT 1, 2 WHERE false"))
    assert not compare.compatible_equal(q("SELECT * FROM VALUES (1, 2), (2, 1)"), q("SELECT * FROM VALUES (1, 1), (2, 2)"))
    assert not compare.rows_match(q("SELECT 1 UNION ALL SELECT 1"), q("SELECT 1"))
    assert compare.rows_match(q("SELECT NULL, 1"), q("SELECT NULL, 1"))
    assert execute.result_signature(by_id) == execute.result_signature(by_name) != execute.result_signature(a)


def test_comparison_has_no_cap_on_column_orders(db):
    q = db.sql
    same = q("SELECT " + ", ".join(f"id % 3 AS x{k}" for k in range(7)) + " FROM range(6)")
    nulls = q("SELECT " + ", ".join(f"CAST(NULL AS INT) AS x{k}" for k in range(7)))
    pairs = q("SELECT " + ", ".join(f"id * {k // 2 + 1} AS x{k}" for k in range(14)) + " FROM range(4)")
    for x in (same, nulls, pairs):
        assert compare.compatible_equal(x, x.select(*reversed(x.columns)))
    assert compare.compatible_equal(same, same, ordered=True)
    # Seven columns of equal bags, all of them different; then one of them is swapped in two rows.
    turned = q("SELECT " + ", ".join(f"(id + {k * k}) % 29 AS x{k}" for k in range(7)) + " FROM range(29)")
    assert compare.compatible_equal(turned, turned.select(*(f"x{k}" for k in (3, 6, 0, 5, 1, 4, 2))))
    other = q("SELECT " + ", ".join(f"(CASE id WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE id END + {k * k}) % 29 AS x{k}" if k == 4 else f"(id + {k * k}) % 29 AS x{k}" for k in range(7)) + " FROM range(29)")
    assert not compare.compatible_equal(turned, other)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column).first()[0]


def test_extraction(spark):
    f = lambda fn, s: one(spark, fn(F.col("s")), s=s)
    assert f(tx.extract_sql, "Sure:\n```sql\nSELECT name FROM person;\n```") == "SELECT name FROM person"
    assert f(tx.extract_sql, "<think>no, SELECT bad</think> SELECT good") == "SELECT good"
    assert f(tx.extract_sql_strict, "people with the most") == ""
    assert f(tx.extract_sql_strict, "<think>SELECT bad</think>\nSELECT 1") == "SELECT 1"
    assert f(tx.extract_sql_strict, "```\nno statement, SELECT is a word\n```") == ""
    assert f(tx.extract_fence, "a ```sql\nSELECT 1\n``` b") == "SELECT 1" and f(tx.extract_fence, " x ") == "x"
    assert f(tx.has_order_by, "SELECT a FROM (SELECT b FROM c order  by d)") and not f(tx.has_order_by, "SELECT 1")
    assert f(tx.first_verb_is_safe, "SELECT 1") and not f(tx.first_verb_is_safe, "  drop table x")
    assert f(tx.dialect, "SELECT [a b], \"c\", '[x] \"y\" LIKE IIF(' FROM t WHERE x NOT like 'a' AND STRFTIME('%Y-%m', d) = IIF(a, 'b', 'c')") == "SELECT `a b`, `c`, '[x] \"y\" LIKE IIF(' FROM t WHERE x NOT ILIKE 'a' AND DATE_FORMAT(d, 'yyyy-MM') = IF(a, 'b', 'c')"
    assert one(spark, tx.strip_trailing_name(F.col("s"), F.lit("db1")), s="SELECT 1 db1 ") == "SELECT 1"
    assert one(spark, tx.schema_from_prompt(F.col("s"), F.lit("z")), s="Database Schema:\nt(a)\n\nQuestion: q") == "t(a)"
    assert one(spark, tx.schema_from_prompt(F.col("s"), F.lit("z")), s="q") == "z"
    assert f(tx.extract_sql_strict, "Well: WITH a AS (SELECT 1) SELECT * FROM a; SELECT 2") == "WITH a AS (SELECT 1) SELECT * FROM a"
    assert f(tx.extract_sql_traced, "SELECT 1") == "" and f(tx.extract_sql_traced, "x</think>SELECT 1") == "SELECT 1"
    assert f(tx.strip_distinct, "SELECT DISTINCT 'distinct', \"distinct\", [distinct], 'it''s distinct' FROM t") == "SELECT  'distinct', \"distinct\", [distinct], 'it''s distinct' FROM t"
    assert f(tx.repair_operators, "a > = 1 and b ! = 2 and c < = 3") == "a >= 1 and b != 2 and c <= 3"
    assert f(tx.normalize_sql, "  SELECT\n 1 ;; ") == "SELECT 1"
    assert f(tx.one_line, " \r\n ") == "SELECT 1"
    assert f(tx.split_identifier, "customerId_old.TheName") == ["customer", "id", "old", "the", "name"]
    assert f(tx.question_from_prompt, "Question: a Question: b ") == "b"


def test_features(spark):
    sql = "SELECT p.name, count(*), max(c.x) FROM person p JOIN child c ON p.id = c.parent_id GROUP BY p.name HAVING count(*) > 1"
    f = {k: one(spark, c, s=sql) for k, c in sf.query_features(F.col("s")).items()}
    assert f["join_count"] == 1 and f["has_group_by"] and f["has_having"] and f["aggregate_count"] >= 2 and f["complexity_proxy"] == "complex"
    assert one(spark, sf.subquery_locations(F.col("s")), s="SELECT a FROM t WHERE x IN (SELECT 1) AND y = (SELECT 2)") == ["WHERE", "AND"]
    assert one(spark, sf.table_refs(F.col("s")), s="SELECT 1 FROM Tab JOIN b ON 1 = 1 JOIN TAB ON 2 = 2") == ["Tab", "b"]
    assert one(spark, F.array_join(sf.where_operators(F.col("s")), " "), s="SELECT 1 FROM t WHERE a <> 3") == "< !=/<>"
    g = {k: one(spark, c, s="SELECT a FROM b JOIN c ON d = e WHERE f IN ( SELECT 1)") for k, c in sf.gold_features(F.col("s")).items()}
    assert (g["has_join"], g["multiple_joins"], g["has_subquery"], g["join_and_subquery"], g["long_sql"], g["join_count"]) == (True, False, True, True, False, 1)
    assert one(spark, sf.missing_name(F.col("s"))["column"], s="[UNRESOLVED_COLUMN.WITH_SUGGESTION] A column with name `t`.`x` cannot be resolved") == "t.x"
    assert one(spark, sf.join_conditions(F.col("s")), s="x JOIN y ON a.b  = c.d") == ["a.b=c.d"]


def test_plans(db):
    gold = "SELECT p.name FROM person p JOIN x ON p.id = x.id WHERE x.kind = 'dog'"
    labels = parsed.structural_mismatches(db, gold, "SELECT name FROM person WHERE age = 5")
    assert {"table_selection_mismatch", "column_reference_mismatch", "join_structure_mismatch", "literal_or_value_mismatch"} <= set(labels)
    assert parsed.structural_mismatches(db, gold, "SELEC") == []
    assert parsed.structural_mismatches(db, gold, gold) == ["other_semantic_mismatch"]
    assert parsed.canonical_sql(db, "select  name from person") == parsed.canonical_sql(db, "SELECT name\nFROM person")
    assert parsed.canonical_sql(db, "SELECT 1; SELECT 2").startswith("error:")
    assert parsed.references(db, "WITH a AS (SELECT id FROM person) SELECT A.Id FROM a") == ({"person", "a"}, {"id"})
    schema = {"person": ["id", "name"], "child": ["id", "parent_id"]}
    assert parsed.grounding(db, "SELECT name FROM person", schema) == {"tables_grounded": True, "columns_grounded": True}
    assert parsed.grounding(db, "SELECT 1", schema)["tables_grounded"] is None
    assert parsed.repair_column(db, "SELECT c.name FROM person p JOIN child c ON p.id = c.parent_id", "c.name", schema) == "SELECT p.name FROM person p JOIN child c ON p.id = c.parent_id"
    assert parsed.repair_column(db, "SELECT c.id FROM child c", "c.id", schema) is None
    assert "sorted by" in parsed.explain_sql(db, "SELECT name FROM person ORDER BY name LIMIT 2")
