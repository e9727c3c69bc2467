"""Records of examples, predictions and trials: projections, checks, consistent joins and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import execute

#: A small database for demonstrations: singers and their concerts (fixed values).
DEMO = {
    "singer": "SELECT * FROM VALUES (1, 'Ana', 'France', 31), (2, 'Bo', 'Chile', 45), (3, 'Cy', 'France', 27) AS t(Singer_ID, Name, Country, Age)",
    "concert": "SELECT * FROM VALUES (1, 'Opening', 'Free choice', 1), (2, 'Summer', 'Open air', 2), (3, 'Winter', 'Indoor', 1), (4, 'Closing', 'Party', 3) AS t(concert_ID, concert_Name, Theme, Singer_ID)",
}


def demo(spark: SparkSession) -> list[str]:
    """Registers the demonstration tables and returns their names."""
    for name, sql in DEMO.items():
        spark.sql(sql).createOrReplaceTempView(name)
    return list(DEMO)


def training_record(examples: DataFrame, system: str, copy: int = 0) -> DataFrame:
    """id (with a suffix for copies), db_id and the three messages of an example."""
    talk = F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit(system)), ("user", F.concat(F.lit("Database Schema:\n"), F.col("schema"), F.lit("\n\nQuestion: "), F.col("question"))), ("assistant", F.col("sql")))))
    return examples.select((F.concat("id", F.lit(f"::hard-{copy}")) if copy else F.col("id")).alias("id"), "db_id", talk.alias("messages"))


def validation_record(examples: DataFrame, fields: tuple[str, ...] = ("id", "db_id", "schema", "question", "sql")) -> DataFrame:
    """What an evaluation needs of an example, the reference statement as ``gold_sql`` and no target message."""
    return examples.select(*(F.col(c).alias("gold_sql" if c == "sql" else c) for c in fields))


def valid_gold(rows: DataFrame, status: str = "gold_status") -> DataFrame:
    """The rows whose reference statement ran."""
    return rows.filter(F.col(status) == "ok")


def positional(left: DataFrame, right: DataFrame, same: tuple[str, ...], at: str = "at") -> DataFrame:
    """Rows of two numbered inputs side by side; places that only one has, and rows that differ in a column of
    ``same``, are an error."""
    both = left.join(right.select(at, *(F.col(c).alias(f"__{c}") for c in same), *(c for c in right.columns if c != at and c not in same), F.lit(True).alias("__there")), at, "full")
    differs = F.coalesce("__there", F.lit(False)) == F.lit(False)
    for c in same:
        differs |= ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if both.filter(differs).limit(1).count():
        raise ValueError(f"rows without a partner, or that differ in {', '.join(same)}")
    return both.drop("__there", *(f"__{c}" for c in same))


def without_audit(groups: DataFrame, column: str = "candidate_groups", prefix: str = "audit_") -> DataFrame:
    """An array of structs without the fields that only an audit may see."""
    fields = [f.name for f in groups.schema[column].dataType.elementType.fields if f.name.startswith(prefix)]
    return groups.withColumn(column, F.transform(column, lambda g: g.dropFields(*fields))) if fields else groups


def prediction_faults(predictions: DataFrame, candidates: int, id: str = "id") -> DataFrame:
    """(id, fault) of predictions that have no id, no SQL, a wrong number of candidates, or an id used before."""
    rules = {
        "no_id": F.col(id).isNull(),
        "no_sql": F.coalesce(F.col("predicted_sql"), F.lit("")) == "",
        "wrong_candidates": F.coalesce(F.size("candidates"), F.lit(0)) != candidates,
        "repeated_id": F.count(F.lit(1)).over(Window.partitionBy(id)) > 1,
    }
    found = predictions.withColumn("fault", F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items()))))
    return found.select(id, F.explode("fault").alias("fault"))


def keep_present(rows: DataFrame, wanted: DataFrame, id: str = "id") -> DataFrame:
    """The rows whose id is wanted; a wanted id without a row is an error."""
    if n := wanted.join(rows.select(id), id, "left_anti").limit(1).count():
        raise ValueError(f"at least {n} wanted ids have no row")
    return rows.join(wanted.select(id).distinct(), id, "left_semi")


def join_consistent(left: DataFrame, right: DataFrame, on: str, same: str) -> DataFrame:
    """An inner join on a key whose sides must agree in another column; keys without a partner are an error."""
    both = left.join(right.withColumnRenamed(same, "__same"), on, "left")
    bad = both.filter(F.col("__same").isNull() | (F.col("__same") != F.col(same)))
    if bad.limit(1).count():
        raise ValueError(f"rows without a partner, or whose {same} differs")
    return both.drop("__same")


def join_small(rows: DataFrame, small: DataFrame, on: str, most: int = 32 << 20) -> DataFrame:
    """A join with a table of checked size, broadcast up to ``most`` bytes (of its rows as text); beyond that it is a
    plain join. Missing keys are an error."""
    size = small.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(small) if size <= most else small
    if rows.join(side, on, "left_anti").limit(1).count():
        raise ValueError(f"values of {on} are missing")
    return rows.join(side, on)


def override(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left rows whose shared columns take the right side's value where it has one."""
    shared = [c for c in right.columns if c != on and c in left.columns]
    both = left.join(right.select(on, *(F.col(c).alias(f"__{c}") for c in shared), *(c for c in right.columns if c != on and c not in left.columns)), on, "left")
    return both.withColumns({c: F.coalesce(f"__{c}", c) for c in shared}).drop(*(f"__{c}" for c in shared))


def resolve_gold(spark: SparkSession, sql: str, db: str) -> str:
    """The statement if it is valid, else without a database name at its end if that is; never dropped."""
    cut = sql.strip()
    if execute.gate(spark, sql)[0] == "ok" or not cut.endswith(db):
        return sql
    cut = cut[: -len(db)].rstrip()
    return cut if execute.gate(spark, cut)[0] == "ok" else sql


def latest(trials: DataFrame, label: str, order: str, *columns: str) -> DataFrame:
    """The last record of each label."""
    last = F.max_by(F.struct(*columns), F.col(order))
    return trials.groupBy(label).agg(last.alias("l")).select(label, "l.*")


def type_histogram(columns: DataFrame) -> DataFrame:
    """How many columns have each type, and in how many tables it occurs."""
    return columns.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"), F.count_distinct("table_name").alias("n_tables"))


def transition_ids(pairs: DataFrame, id: str, before: str, after: str) -> DataFrame:
    """(transition, id): corrected and regressed rows, a row each."""
    kind = F.when(~F.col(before) & F.col(after), "corrected").when(F.col(before) & ~F.col(after), "regressed")
    return pairs.select(kind.alias("transition"), id).filter("transition is not null")


def group_sizes(groups: DataFrame, example: str, group: str) -> DataFrame:
    """min, mean and max of distinct groups by example."""
    each = groups.groupBy(example).agg(F.count_distinct(group).alias("n"))
    return each.agg(F.min("n").alias("least"), F.bround(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"))
