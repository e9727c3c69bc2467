"""Voting, dataset building, evaluation, questions, readers and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import ask, dataset, evaluate, schema, vote
from quernstone.sources import readers, writers
from quernstone.streaming import events


def candidates(spark, rows):
    return spark.createDataFrame(rows, "example int, idx int, signature string, is_empty boolean, is_zero boolean")


def test_consensus(spark):
    rows = [(1, 0, "Lin", False, False), (1, 1, "Ada", False, False), (1, 2, None, False, False), (1, 3, "Ada", False, False), (2, 0, None, False, False), (3, 0, "b", False, False), (3, 1, "a", False, False)]
    got = {r.example: (r.chosen_idx, r.votes) for r in vote.consensus(candidates(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (0, 0), 3: (0, 1)}


def test_value_aware(spark):
    rows = [(1, 0, "", True, False), (1, 1, "", True, False), (1, 2, "0", False, True), (1, 3, "0", False, True), (1, 4, "Ada", False, False), (2, 0, "0", False, True), (2, 1, "", True, False)]
    got = {r.example: (r.chosen_idx, r.votes) for r in vote.value_aware(candidates(spark, rows)).collect()}
    assert got[1] == (4, 1) and got[2] == (0, 1)
    cells = spark.createDataFrame([(["0", "0.0%"],), (["0", "x"],), ([],)], "c array<string>")
    assert [r[0] for r in cells.select(vote.all_zero(F.col("c"))).collect()] == [True, False, False]
    sig = spark.sql("SELECT array(array('b', 'a'), array('a', 'b'), array('c')) AS r")
    assert sig.select(vote.value_signature(F.col("r"))).first()[0] == "a|b;c"
    marks = spark.sql("SELECT array(array('a|b')) AS x, array(array('a', 'b')) AS y, array(array('a;b'), array('c')) AS z")
    assert len(set(marks.select(*(vote.value_signature(F.col(c)) for c in "xyz")).first())) == 3
    published = spark.createDataFrame([("0",), ("0%;+0.0",), ("a|0",), ("0;5",), ("",), ("0;x",)], "s string")
    assert [r[0] for r in published.select(vote.published_all_zero(F.col("s"))).collect()] == [True, True, False, False, False, True]
    rows = spark.createDataFrame([(1, 0, []), (1, 1, []), (1, 2, [["0"]]), (1, 3, [["Ada", None]]), (2, 0, None), (3, 0, [["0"]]), (3, 1, [])], "example int, idx int, rows array<array<string>>")
    assert {r.example: (r.chosen_idx, r.votes) for r in vote.published_vote(rows).collect()} == {1: (3, 1), 2: (0, 0), 3: (0, 1)}


def test_routing_and_pool(spark):
    pool = spark.createDataFrame([(1, "a", 2, 0, False), (1, "b", 1, 1, True), (2, "a", 1, 0, True)], "example int, signature string, base_votes int, core_votes int, correct boolean")
    scores = vote.weighted_pool(pool, spark.createDataFrame([(0,), (1,), (2,)], "weight int"))
    assert {r.weight: r.n_correct for r in scores.collect()} == {0: 1, 1: 2, 2: 2}
    assert vote.best_weight(scores).first().weight == 1
    groups = spark.createDataFrame([(1, "x", "S 1"), (1, "x", "S 1"), (1, "x", "S"), (1, "y", "T")], "example int, signature string, sql string")
    top = vote.candidate_groups(groups).filter("rank = 1").first()
    assert (top.votes, top.distinct_sqls, top.representative) == (3, 2, "S 1")
    failed = spark.createDataFrame([(1, "x", "S"), (1, None, "F"), (2, None, "F"), (2, None, "G")], "example int, signature string, sql string")
    assert {(r.example, r.signature, r.votes) for r in vote.candidate_groups(failed).collect()} == {(1, "x", 1), (2, None, 2)}
    core = spark.createDataFrame([(1, "d", 0, False), (2, "d", 1, True)], "example int, db string, core_votes int, core_correct boolean")
    other = spark.createDataFrame([(1, "d", "ok", True), (2, "e", "ok", False)], "example int, db string, other_status string, other_correct boolean")
    assert {r.example: r.source for r in vote.with_fallback(core, other).collect()} == {1: "other", 2: "core"}
    with pytest.raises(ValueError):
        vote.with_fallback(core, other, same="db")
    with pytest.raises(ValueError):
        vote.with_fallback(core, other.limit(1))
    picked = vote.verifier_pick(spark.createDataFrame([(1, 0.5, 1, 0), (1, 0.5, 1, 1), (1, 0.1, 9, 2)], "example int, margin double, votes int, idx int"))
    assert picked.first().idx == 0


def test_sampling(spark):
    rows = spark.createDataFrame([(k, f"t{k // 2}") for k in range(40)], "id long, template string")
    a = dataset.weighted_sample(rows, 10, 17, "id", F.lit(1.0), F.col("template"), 1)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in dataset.weighted_sample(rows.repartition(5), 10, 17, "id", F.lit(1.0), F.col("template"), 1).collect())
    assert a.select("template").distinct().count() == 10
    with pytest.raises(ValueError):
        dataset.weighted_sample(rows, 21, 17, "id", F.lit(1.0), F.col("template"), 1)
    spread = dataset.length_stratified(rows.withColumn("n", F.col("id")), 5, "n", "id")
    assert sorted(r.id for r in spread.collect()) == [0, 10, 20, 29, 39]
    with pytest.raises(ValueError):
        dataset.check_policy(0.5, 0, {})
    tags = spark.createDataFrame([(["join", "subquery"],), ([],)], "f array<string>")
    assert [r[0] for r in tags.select(dataset.priority_multiplier(F.col("f"), {"join": 2.0, "subquery": 2.5})).collect()] == [2.5, 1.0]
    with pytest.raises(Exception, match="unknown feature"):
        tags.select(dataset.priority_multiplier(F.col("f"), {"join": 2.0})).collect()
    assert dataset.sample_budget(25, 0.5) == 12
    parts = spark.createDataFrame([("validation",)] * 10 + [("train",)] * 90, "part string")
    assert dataset.check_share(parts, 12) == 10.0
    with pytest.raises(ValueError):
        dataset.check_share(parts, 20)
    with pytest.raises(ValueError):
        dataset.small(parts, 99)


def test_alignment(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    r = dataset.alignment(a, b, "id").first()
    assert (r.missing, r.extra, r.aligned, r.repeated) == (1, 1, 1, 1)
    with pytest.raises(ValueError):
        dataset.check_aligned(a, b, "id")
    with pytest.raises(ValueError):
        dataset.check_disjoint(a, b, "id")
    good, bad = dataset.split_usable(spark.createDataFrame([("ok",), ("error",), (None,)], "status string"))
    assert (good.count(), bad.count()) == (1, 2)


def test_checks_between_parts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, q string"), spark.createDataFrame([(3, "x")], "id int, q string")
    assert dataset.leakage(a, b, ["id", "q"]).first().asDict() == {"id_overlap": 0, "q_overlap": 1, "exact_overlap": 0}
    assert dataset.check_leakage(a, b, ["id", "q"], ["id_overlap", "exact_overlap"])["q_overlap"] == 1
    with pytest.raises(ValueError):
        dataset.check_leakage(a, b, ["id", "q"], ["q_overlap"])
    dataset.check_split(a.union(b), [a, b], "id")
    with pytest.raises(ValueError):
        dataset.check_split(a, [a, b], "id")
    with pytest.raises(ValueError):
        dataset.check_split(a.union(b), [a, b], "q")
    with pytest.raises(ValueError):
        dataset.align_models({"m": a, "n": b}, "id", "q")
    assert dataset.align_models({"m": a, "n": a}, "id", "q").columns == ["id", "m", "n"]
    counted = dataset.with_key_count(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), F.col("k"))
    assert sorted(r.key_count for r in counted.collect()) == [1, 2, 2]
    assert dataset.drop_long_groups(spark.createDataFrame([("a", 1), ("a", 9), ("b", 2), (None, 3)], "g string, n int"), "g", F.col("n"), 5).count() == 2


def test_places_of_an_order(spark):
    rows = spark.createDataFrame([(k, k * 7919 % 101 if k % 3 else 50) for k in range(500)], "id long, n long").repartition(7)
    want = sorted((n, i) for i, n in ((r.id, r.n) for r in rows.collect()))
    got = {r.at: (r.n, r.id) for r in evaluate.ranked_at(rows, "n", [0, 7, 250, 251, 499], "id").collect()}
    assert got == {k: want[k] for k in (0, 7, 250, 251, 499)}
    assert evaluate.ranked_at(rows.limit(0), "n", [0], "id").count() == 0
    assert {r.fraction: r.value for r in evaluate.lower_percentiles(rows, "n", [0.0, 0.5, 0.99, 1.0]).collect()} == {0.0: want[0][0], 0.5: want[249][0], 0.99: want[494][0], 1.0: want[499][0]}
    one = evaluate.length_summary(rows, "n", "id", 90).first()
    assert (one.p95, one.p99) == (want[474][0], want[494][0])


def test_source_rules(spark):
    kind = "id string, split string, status string, sql string, messages array<struct<role:string,content:string>>"
    talk = [("system", "s"), ("user", "u"), ("assistant", "SELECT 1")]
    rows = [("a", "train", "ok", "SELECT 1;", talk), ("b", "dev", "ok", "SELECT 1", talk), ("c", "train", "ok", "SELECT 1", talk[:2]), ("d", "train", "ok", "hello", [*talk[:2], ("assistant", "hello")])]
    got = {(r.id, r.violation) for r in dataset.source_violations(spark.createDataFrame(rows, kind), "train").collect()}
    assert ("b", "wrong_split") in got and ("c", "wrong_roles") in got and ("d", "not_a_query") in got
    assert not [x for x in got if x[0] == "a"]


def test_evaluation(spark):
    assert evaluate.exact_mcnemar(0, 0) == 1.0
    assert evaluate.exact_mcnemar(1, 9) == pytest.approx(0.021484375)
    assert evaluate.exact_mcnemar(5, 5) == 1.0
    rows = spark.createDataFrame([("SELECT 1", True), (" select  1; ", False), ("SELECT 2", True)], "sql string, ok boolean")
    from quernstone.functions.text import normalize_sql

    r = evaluate.macro_accuracy(rows, normalize_sql(F.col("sql"), fold=True), F.col("ok")).first()
    assert (r.n_unique, r.macro_pct) == (2, 75.0)
    flags = spark.createDataFrame([("a", True, 2.0), ("a", None, None), (None, False, 4.0)], "complexity string, execution_match boolean, generation_ms_per_example double")
    got = {r.complexity: (r.examples, r.execution_match_count, r.execution_match_pct, r.mean_latency) for r in evaluate.summarize(flags, flags=("execution_match",)).collect()}
    assert got == {"a": (2, 1, 50.0, 2.0), "unknown": (1, 0, 0.0, 4.0), "all": (3, 1, 33.333, 3.0)}
    none = evaluate.distribution(spark.createDataFrame([("a", None)], "g string, x int"), ["g"], F.col("x")).first()
    assert (none.n, none.min, none.median, none.p95, none.max) == (0, 0, 0, 0, 0)
    picks = spark.createDataFrame([(k, "o1" if k < 6 else "o2", f"m{k % 2}", 0, 10 - k) for k in range(10)], "id int, o string, m string, rank int, tokens int")
    found = [r["id"] for r in evaluate.representatives(picks, "o", "rank", "tokens", "id", "m", n=6)]
    assert found == [0, 1, 2, 7, 3, 4]  # o1 three times, m0 and m1 twice each, then filled up in order
    assert evaluate.markdown_table(spark.createDataFrame([("a|b\nc", None)], "x string, y int")) == "| x | y |\n| --- | --- |\n| a\\|b c |  |"
    refs = spark.createDataFrame([("table", "A"), ("table", "b"), ("column", "x")], "kind string, name string")
    known = spark.createDataFrame([("table", "a"), ("column", "X")], "kind string, name string")
    assert {r.kind: r.precision_pct for r in evaluate.reference_precision(refs, known).collect()} == {"table": 50.0, "column": 100.0}


def test_questions(spark):
    spark.sql("SELECT * FROM VALUES (1L, 'Ada', 'FR'), (2L, 'Lin', 'DE') AS t(SingerId, Name, Country)").createOrReplaceTempView("singer")
    terms = schema.schema_terms(spark, ["singer"])
    assert terms[0] == "singer" and "singer.Country" in terms
    assert "singer" in ask.matched_terms("how many singers", terms)
    assert "Country" in ask.matched_terms("list contry names", terms)
    assert ask.matched_terms("the moon", terms) == []
    assert ask.variants("countries") == {"countries", "country", "countrie"} and ask.variants("gas") == {"gas", "gass"} and ask.variants("the") == set()
    assert ask.assess("how many singers are there, return only SQL.", terms) == ask.assess("how many singers are there", terms)
    assert ask.assess("what about the overall performance then", terms).needed
    assert ask.clarification_helps("by country", terms) and not ask.clarification_helps(" ", terms)
    assert "Clarification" in ask.compose("q", "note") and ask.compose("q") == "q" and "safest" in ask.compose("q", None, True)
    assert [r.y for r in ask.coerce_for_chart(spark.createDataFrame([("1",), ("x",)], "y string"), "y").collect()] == [1.0]
    assert ask.assess("show", terms).needed and not ask.assess("how many singers are there", terms).needed
    found = ask.ask(spark, "how many singers are there", ["singer"])
    assert (found.status, found.chart.kind, found.result.rows) == ("ok", "metric", [(2,)])
    assert ask.ask(spark, "what about the distant moon", ["singer"], skipped=True).status == "ungrounded"
    assert ask.ask(spark, "how many singers are there", ["singer"], generate=lambda q, t: "DELETE FROM singer").status == "unsafe"
    prompts = [("write_intent", "delete all singers"), ("nonsensical", "")]
    assert ask.robustness(spark, prompts, ["singer"]).filter("safe < total").count() == 0
    keys = schema.Keys({"singer": ["SingerId", "Name"]}, (schema.Key("singer", "Country", "land", 'od"d'),), frozenset([("singer", "Name")]))
    text = schema.ddl(spark, ["singer"], keys).first().ddl
    assert '"Name" STRING NOT NULL' in text and 'PRIMARY KEY ("SingerId", "Name")' in text and 'REFERENCES "land" ("od""d")' in text
    spark.sql("SELECT * FROM VALUES (1L, 'a@b.cd', repeat('x', 60), date'2020-01-01'), (2L, 'plain', 'y', date'2020-01-02') AS t(k, mail, wide, day)").createOrReplaceTempView("odd")
    assert schema.examples(spark.table("odd")) == {"k": ["1", "2"], "mail": [], "wide": [], "day": ["2020-01-01"]}
    assert schema.sentences(spark, ["odd"]).first().sentence.startswith("Table odd has the columns k")
    found = schema.found_keys(spark, ["singer", "odd"])
    assert found.primary == {"singer": ["SingerId"], "odd": ["k"]}
    assert "# Table: singer" in schema.mschema(spark, "db", ["singer"]) and "Examples: [DE, FR]" in schema.mschema(spark, "db", ["singer"])


def test_charts():
    bar = ask.choose_chart(["name", "n"], [("a", 1), ("b", 2)])
    assert (bar.kind, bar.x, bar.y) == ("bar", "name", "n")
    assert ask.choose_chart(["day", "n"], [("2024-01-01", 1)]).kind == "line"
    assert ask.choose_chart(["a", "b"], [(1, 2), (3, 4)]).kind == "scatter"
    assert ask.choose_chart(["name", "n"], [(str(k), k) for k in range(26)]).kind == "table"
    assert ask.choose_chart(["id", "n"], [(1, 2)], "bar").y == "n"
    assert ask.choose_chart(["name"], [("a",)], "line").kind == "table"
    assert ask.choose_chart(None, None).kind == "table"


def test_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "q", None), ("2", "r", 3)], "id string, question string, n int")
    assert writers.write_json_lines(rows, f"{tmp_path}/a", 2) == 2
    with pytest.raises(ValueError):
        writers.write_json_lines(rows, f"{tmp_path}/b", 3)
    back = readers.json_lines(spark, f"{tmp_path}/a", "id string, question string, n int")
    assert sorted(back.collect()) == sorted(rows.collect())
    assert [r.id for r in readers.resume(rows, spark, f"{tmp_path}/none", "id string").orderBy("id").collect()] == ["1", "2"]
    writers.append_json_lines(rows.limit(0), f"{tmp_path}/a")
    assert readers.resume(rows, spark, f"{tmp_path}/a", "id string").count() == 0
    (tmp_path / "dev.sql").write_text("SELECT 'a\tb'\tdb1\n\nSELECT 2\tdb2\n")
    got = [tuple(r) for r in readers.statement_list(spark, f"{tmp_path}/dev.sql").collect()]
    assert sorted(got) == [("dev", "SELECT 'a\tb'", "db1"), ("dev", "SELECT 2", "db2")]
    (tmp_path / "x.txt").write_text("a\nb\n")
    lines = readers.numbered_lines(spark, f"{tmp_path}/x.txt")
    (tmp_path / "long.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.minPartitionNum", "9")
    try:
        split = readers.numbered_lines(spark, f"{tmp_path}/long.txt")
        assert split.rdd.getNumPartitions() > 3
        assert {r.at: r.value for r in split.collect()} == {k: f"line {k}" for k in range(5000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    (tmp_path / "bad.json").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(ValueError, match="line 3"):
        readers.checked_json_lines(spark, f"{tmp_path}/bad.json", "a int")
    (tmp_path / "good.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.checked_json_lines(spark, f"{tmp_path}/good.json", "a int").collect()] == [1, 2]
    with pytest.raises(Exception):  # noqa: B017 - what can't be read is not "nothing done yet"
        readers.resume(rows, spark, f"{tmp_path}/bad.json", "id string").collect()
    assert readers.zipped(lines, lines.withColumnRenamed("value", "other")).count() == 2
    with pytest.raises(ValueError):
        readers.zipped(lines, lines.withColumnRenamed("value", "other").limit(1))
    (tmp_path / "s.csv").write_text("m,score\na,1.5\nb,pending\nc,\n")
    assert [r.score for r in readers.scores_csv(spark, f"{tmp_path}/s.csv", ["score"]).collect()] == [1.5]
    (tmp_path / "log.json").write_text('{"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval": 1}]}')
    assert [r.step for r in readers.training_log(spark, f"{tmp_path}/log.json").collect()] == [1]
    for name in ("x/one.parquet", "y/two.parquet"):
        spark.range(3).write.parquet(f"{tmp_path}/dbs/{name}")
    found = readers.discover(spark, f"{tmp_path}/dbs")
    assert sorted(r.db_id for r in found.collect()) == ["one", "two"]
    assert readers.registry(found, "two").endswith("y/two.parquet")
    with pytest.raises(KeyError, match="one, two"):
        readers.registry(found, "three")
    spark.range(3).write.parquet(f"{tmp_path}/dbs/z/two.parquet")
    with pytest.raises(ValueError):
        readers.discover(spark, f"{tmp_path}/dbs")
    assert readers.resolve(None, ["/a/b.x", "/a/*.y"], {"/a/d.y", "/a/c.y"}) == "/a/c.y"
    with pytest.raises(KeyError):
        readers.resolve("q", [], {"r"})
    assert readers.parquet_columns(spark, f"{tmp_path}/dbs/x/one.parquet", ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        readers.parquet_columns(spark, f"{tmp_path}/dbs/x/one.parquet", ["no"])
    kept = writers.manifest(spark, f"{tmp_path}/a")
    assert readers.verified(spark, f"{tmp_path}/a/*.json", kept).count() == kept.count() > 0
    with pytest.raises(ValueError, match="differ"):
        readers.verified(spark, f"{tmp_path}/a/*.json", kept.withColumn("sha256", F.lit("0")))
    writers.write_json(spark, {"b": 1, "a": [2]}, f"{tmp_path}/record.json")
    writers.write_json(spark, {"b": 2}, f"{tmp_path}/record.json")
    assert (tmp_path / "record.json").read_text() == '{\n  "b": 2\n}\n'
    writers.write_csv(rows.select("id", "n"), f"{tmp_path}/csv", ["n", "id", "more"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["n", "id", "more"]
    writers.write_csv(rows.limit(0), f"{tmp_path}/empty")
    assert "".join(p.read_text() for p in (tmp_path / "empty").glob("*.csv")) == ""
    peak = spark.sql("SELECT 'm' AS model, named_struct('max_allocated_gib', 9.5D) AS cuda_peak")
    writers.write_comparison(peak, ["model"], f"{tmp_path}/cmp")
    assert spark.read.option("header", True).csv(f"{tmp_path}/cmp/csv").first().max_allocated_gib == "9.5"
    with pytest.raises(ValueError):
        readers.balanced(spark.createDataFrame([(0,), (0,), (1,)], "label int"))
    spark.createDataFrame([(" d ", "q", "SELECT 1")], "db_id string, question string, query string").write.parquet(f"{tmp_path}/p.parquet")
    assert readers.annotations(spark, f"{tmp_path}/p.parquet", 1).first().db_id == "d"


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10, 0) AS ts, id % 2 AS user_id, 'view' AS event_type, 1.0D AS value, '' AS props FROM range(6)")
    rows.write.parquet(f"{tmp_path}/in/events.parquet")
    batch = events.tumbling(spark.read.parquet(f"{tmp_path}/in/events.parquet"), "30 minutes")
    assert sorted(r.n for r in batch.collect()) == [3, 3]
    assert [r.n for r in events.sessions(spark.read.parquet(f"{tmp_path}/in/events.parquet"), "25 minutes").collect()] == [3, 3]
    stream = events.event_stream(spark, f"{tmp_path}/in/events.parquet").select("event_id")
    for _ in range(2):  # the second run finds nothing new
        events.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_records(spark):
    from quernstone.operators import records

    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, db_id string")
    with pytest.raises(ValueError):
        records.keep_present(rows, spark.createDataFrame([("3",)], "id string"))
    assert records.keep_present(rows, spark.createDataFrame([("2",)], "id string")).first().id == "2"
    with pytest.raises(ValueError):
        records.join_consistent(rows, spark.createDataFrame([("1", "x"), ("2", "b")], "id string, db_id string"), "id", "db_id")
    assert records.join_consistent(rows, rows.withColumn("z", F.lit(1)), "id", "db_id").columns == ["id", "db_id", "z"]
    numbered = spark.createDataFrame([(0, "a"), (1, "b")], "at int, q string")
    assert records.positional(numbered, numbered.withColumn("z", F.lit(1)), ("q",)).columns == ["at", "q", "z"]
    with pytest.raises(ValueError):
        records.positional(numbered, numbered.withColumn("q", F.lit("a")), ("q",))
    with pytest.raises(ValueError):
        records.positional(numbered, numbered.limit(1), ("q",))
    assert records.valid_gold(spark.createDataFrame([("ok",), ("error",), (None,)], "gold_status string")).count() == 1
    with pytest.raises(ValueError):
        records.join_small(rows, spark.createDataFrame([("a", 1)], "db_id string, n int"), "db_id")
    assert records.join_small(rows, spark.createDataFrame([("a", 1), ("b", 2)], "db_id string, n int"), "db_id", most=1).count() == 2
    groups = spark.sql("SELECT array(named_struct('sql', 'x', 'audit_gold', true)) AS candidate_groups")
    assert records.without_audit(groups).first().candidate_groups[0].asDict() == {"sql": "x"}
    records.demo(spark)
    assert records.resolve_gold(spark, "SELECT 1 FROM singer WHERE concert_singer concert_singer", "concert_singer").endswith("WHERE concert_singer")
