"""Voting over candidates as grouped aggregation, with every tie broken by an explicit column.

A candidate row has an example, an order ``idx`` and a signature (null if it failed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dataset import small, small_if


def clusters(candidates: DataFrame, example: str = "example", idx: str = "idx", signature: str = "signature") -> DataFrame:
    """(example, signature, votes, first_idx) of candidates that did not fail."""
    return candidates.filter(F.col(signature).isNotNull()).groupBy(example, signature).agg(F.count(F.lit(1)).alias("votes"), F.min(idx).alias("first_idx"))


def consensus(candidates: DataFrame, example: str = "example", idx: str = "idx", signature: str = "signature") -> DataFrame:
    """The earliest member of the largest cluster of each example; equal clusters: the one seen first.
    An example whose candidates all failed has chosen_idx and votes 0."""
    best = clusters(candidates, example, idx, signature).groupBy(example).agg(F.max(F.struct(F.col("votes"), (-F.col("first_idx")).alias("k"))).alias("b"))
    every = candidates.select(example).distinct()
    return every.join(best, example, "left").select(example, F.coalesce(-F.col("b.k"), F.lit(0)).cast("long").alias("chosen_idx"), F.coalesce("b.votes", F.lit(0)).cast("long").alias("votes"))


def all_zero(cells: Column) -> Column:
    """Whether an array of cell texts holds numbers only (a percent sign may follow), all zero; not if empty."""
    number = F.transform(cells, lambda x: F.regexp_replace(x, "%$", "").try_cast("double"))
    return (F.size(cells) > 0) & F.forall(number, lambda x: F.coalesce(F.abs(x) < 1e-12, F.lit(False)))


def _escaped(cell: Column) -> Column:
    """A cell in which the marks between cells and rows are told apart from text."""
    return F.regexp_replace(F.coalesce(cell, F.lit("None")), r"([\\|;])", r"\\$1")


def value_signature(rows: Column) -> Column:
    """The set of rows, each an array of cell texts, whatever the order of its cells, as one text. Marks inside
    cells are escaped, so different sets have different texts; null (no result) stays null."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda r: F.array_join(F.array_sort(F.transform(r, _escaped)), "|")))), ";")


def published_signature(rows: Column) -> Column:
    """The set of rows without escapes, cut after 200 characters, as published."""
    plain = F.transform(rows, lambda r: F.array_join(F.array_sort(F.transform(r, lambda x: F.coalesce(x, F.lit("None")))), "|"))
    return F.substring(F.array_join(F.array_sort(F.array_distinct(plain)), ";"), 1, 200)


def published_all_zero(signature: Column) -> Column:
    """Whether the rows of a published signature that are one number each (a percent sign may follow) are all zero;
    other rows don't count, and there must be one that does."""
    values = F.filter(F.transform(F.split(signature, ";"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.transform(values, lambda x: F.trim(F.regexp_replace(x, "%$", "")))
    numbers = F.filter(plain, lambda x: x.rlike(r"^[\s+-]?\d+(\.\d+)?$"))
    return (F.size(numbers) > 0) & F.forall(numbers, lambda x: F.coalesce(F.abs(F.trim(x).try_cast("double")) < 1e-12, F.lit(False)))


def value_aware(candidates: DataFrame, example: str = "example", idx: str = "idx", signature: str = "signature", empty: str = "is_empty", zero: str = "is_zero") -> DataFrame:
    """Like consensus, but results that are neither empty nor all zero win over others, and ties go to
    the greatest signature."""
    plain = F.max((~F.col(empty) & ~F.col(zero)).cast("int")).alias("plain")
    found = candidates.filter(F.col(signature).isNotNull()).groupBy(example, signature).agg(F.count(F.lit(1)).alias("votes"), F.min(idx).alias("first_idx"), plain)
    best = found.groupBy(example).agg(F.max(F.struct("plain", "votes", signature, "first_idx")).alias("b"))
    every = candidates.select(example).distinct()
    return every.join(best, example, "left").select(example, F.coalesce("b.first_idx", F.lit(0)).cast("long").alias("chosen_idx"), F.coalesce("b.votes", F.lit(0)).cast("long").alias("votes"))


def published_vote(candidates: DataFrame, example: str = "example", idx: str = "idx", rows: str = "rows") -> DataFrame:
    """The published vote: candidates (``rows`` an array of rows of cell texts, null if it failed) by their published
    signature; empty and all-zero ones only if there is no other, ties to the greatest signature."""
    signature = published_signature(F.col(rows))
    known = candidates.select(example, idx, signature.alias("signature"))
    known = known.withColumns({"is_empty": F.col("signature") == "", "is_zero": published_all_zero(F.col("signature"))})
    return value_aware(known, example, idx)


def reselect(candidates: DataFrame, results: DataFrame, by_value: bool = True) -> DataFrame:
    """A new choice among stored candidates (example, idx, sql): each is judged by the result (sql, signature,
    is_empty, is_zero) of its statement without DISTINCT; those without a result failed."""
    from ..functions.text import repair_operators, strip_distinct

    keyed = candidates.withColumn("__sql", strip_distinct(repair_operators(F.col("sql"))))
    # Few statements, each of very many candidates, must not meet in a task each.
    known = keyed.join(small_if(results.withColumnRenamed("sql", "__sql")), "__sql", "left")
    return value_aware(known) if by_value else consensus(known)


def rescore(candidates: DataFrame, before: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: what a new choice changes. candidates: example, idx, correct; before and chosen: example, chosen_idx."""
    flag = candidates.select("example", F.col("idx").cast("long").alias("chosen_idx"), "correct")
    old = before.select("example", F.col("chosen_idx").cast("long").alias("chosen_idx")).join(flag, ["example", "chosen_idx"], "left").select("example", F.coalesce("correct", F.lit(False)).alias("old"))
    new = chosen.select("example", F.col("chosen_idx").cast("long").alias("chosen_idx")).join(flag, ["example", "chosen_idx"], "left").select("example", F.coalesce("correct", F.lit(False)).alias("new"))
    oracle = candidates.groupBy("example").agg(F.coalesce(F.bool_or("correct"), F.lit(False)).alias("oracle"))
    both = old.join(new, "example").join(oracle, "example")
    count = lambda c: F.count_if(c)
    o, n = F.col("old"), F.col("new")
    return both.agg(F.count(F.lit(1)).alias("n"), count(o).alias("before"), count(n).alias("after"), count(~o & n).alias("corrected"), count(o & ~n).alias("regressed"), count(F.col("oracle")).alias("oracle"))


def winner_runner_up(candidates: DataFrame, example: str = "example", idx: str = "idx", signature: str = "signature") -> DataFrame:
    """The two largest clusters of each example by (votes, signature) and the margin between them."""
    order = Window.partitionBy(example).orderBy(F.desc("votes"), F.desc(signature))
    ranked = clusters(candidates, example, idx, signature).withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    first, second = (F.max(F.when(F.col("rank") == k, F.struct("votes", signature))) for k in (1, 2))
    out = ranked.groupBy(example).agg(first.alias("w"), second.alias("r"))
    return out.select(example, F.col(f"w.{signature}").alias("winner"), F.col("w.votes").alias("votes"), F.coalesce("r.votes", F.lit(0)).cast("long").alias("runner_up_votes"), (F.col("w.votes") - F.coalesce("r.votes", F.lit(0))).cast("long").alias("margin"))


def ensemble_report(chosen: DataFrame, baseline: DataFrame, example: str = "example", correct: str = "correct") -> DataFrame:
    """One row: an ensemble against one model: n, correct, baseline_correct, corrected, regressed, oracle."""
    both = chosen.select(example, F.col(correct).alias("c"), "oracle_match").join(baseline.select(example, F.col(correct).alias("b")), example)
    c, b = F.coalesce("c", F.lit(False)), F.coalesce("b", F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(c).alias("correct"), F.count_if(b).alias("baseline_correct"), F.count_if(c & ~b).alias("corrected"), F.count_if(~c & b).alias("regressed"), F.count_if("oracle_match").alias("oracle"))


def priority_ensemble(answers: DataFrame, example: str = "example", model: str = "model", priority: str = "priority", signature: str = "signature", correct: str = "correct") -> DataFrame:
    """The answer most models agree on, ties to the model of highest priority (the least number)."""
    votes = Window.partitionBy(example, signature)
    order = F.struct(F.col("votes"), (-F.col(priority)).alias("p"), F.col(model).alias("m"), F.col(correct).alias("c"))
    scored = answers.withColumn("votes", F.when(F.col(signature).isNotNull(), F.count(F.lit(1)).over(votes)).otherwise(0))
    out = scored.groupBy(example).agg(F.max(order).alias("b"), F.max(F.col(correct).cast("int")).alias("oracle"))
    return out.select(example, F.col("b.m").alias("selected"), F.col("b.votes").cast("long").alias("votes"), F.col("b.c").alias("correct"), (F.col("oracle") == 1).alias("oracle_match"))


def weighted_pool(pool: DataFrame, weights: DataFrame, example: str = "example", signature: str = "signature", base: str = "base_votes", core: str = "core_votes", correct: str = "correct") -> DataFrame:
    """For each weight (column ``weight`` of a small table) the number of examples whose best cluster,
    by base + weight * core votes and then signature, is correct."""
    scored = pool.join(small(weights, 1_000)).withColumn("score", F.col(base) + F.col("weight") * F.col(core))
    best = scored.groupBy("weight", example).agg(F.max(F.struct("score", signature, F.col(correct).cast("int").alias("ok"))).alias("b"))
    return best.groupBy("weight").agg(F.sum("b.ok").cast("long").alias("n_correct"), F.count(F.lit(1)).alias("n"))


def best_weight(scores: DataFrame) -> DataFrame:
    """The weight of the highest score, the smallest of equals."""
    return scores.orderBy(F.desc("n_correct"), "weight").limit(1)


def leave_one_group_out(scores: DataFrame, group: str = "grp", setting: str = "setting", value: str = "n_correct") -> DataFrame:
    """For each group the setting that is best on all others (ties: the smallest), and its score here.
    scores has a row for each group and setting."""
    total = Window.partitionBy(setting)
    rest = scores.withColumn("elsewhere", F.sum(value).over(total) - F.col(value))
    order = Window.partitionBy(group).orderBy(F.desc("elsewhere"), setting)
    return rest.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select(group, F.col(setting), F.col(value).alias("held_out"), "elsewhere")


def route(agree: Column, core_votes: Column, other_votes: Column, margin: Column, least: Column, most: Column, close: Column) -> Column:
    """Whether the core answer replaces the other one."""
    return ~agree & (core_votes >= least) & (other_votes <= most) & (margin <= close)


def routing_grid(examples: DataFrame, settings: DataFrame) -> DataFrame:
    """The correct answers under each routing setting (a, b, c). settings is a small table of parameters; examples
    are counted by their distinct facts first, so the settings meet these and not every example."""
    facts = ["agree", "core_votes", "other_votes", "margin", "core_correct", "other_correct"]
    counted = examples.groupBy(*facts).agg(F.count(F.lit(1)).alias("n"))
    use = route(F.col("agree"), F.col("core_votes"), F.col("other_votes"), F.col("margin"), F.col("a"), F.col("b"), F.col("c"))
    right = F.when(use, F.col("core_correct")).otherwise(F.col("other_correct")).cast("int")
    return counted.join(small(settings)).groupBy("a", "b", "c").agg(F.sum(right * F.col("n")).cast("long").alias("n_correct"), F.sum(use.cast("int") * F.col("n")).cast("long").alias("n_routed"))


def best_setting(grid: DataFrame) -> DataFrame:
    """The highest score, ties to the greatest parameters."""
    return grid.orderBy(F.desc("n_correct"), F.desc("a"), F.desc("b"), F.desc("c")).limit(1)


def with_fallback(core: DataFrame, other: DataFrame, on: Sequence[str] = ("example",), same: str | None = None) -> DataFrame:
    """The core answer, but for examples without core votes whose other answer ran. Both sides must have the same
    examples, each once, and agree in the column ``same`` if one is named; else it is an error."""
    from .dataset import alignment

    key = F.to_json(F.struct(*on)).alias("k")
    report = alignment(core.select(key), other.select(key), "k").first()
    if report["missing"] or report["extra"] or report["repeated"]:
        raise ValueError(f"examples differ: {report.asDict()}")
    both = core.join(other.withColumnRenamed(same, "__same") if same else other, list(on))
    if same and both.filter(~F.col(same).eqNullSafe(F.col("__same"))).limit(1).count():
        raise ValueError(f"rows differ in {same}")
    use = (F.col("core_votes") == 0) & (F.col("other_status") == "ok")
    return both.select(*on, F.when(use, "other").otherwise("core").alias("source"), F.when(use, F.col("other_correct")).otherwise(F.col("core_correct")).alias("correct"))


def candidate_groups(candidates: DataFrame, example: str = "example", sql: str = "sql", keys: Sequence[str] = ("signature",)) -> DataFrame:
    """Candidates with equal keys as one group: votes, number of texts, and the text that stands for it
    (most frequent, then shortest, then greatest); rank by (votes, text) descending. Failed candidates (a
    null key) are in no group, unless all of an example failed: then they are its one group."""
    failed = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    alive = Window.partitionBy(example)
    candidates = candidates.withColumn("__failed", failed).withColumn("__all", F.min("__failed").over(alive)).filter((F.col("__failed") == 0) | (F.col("__all") == 1))
    texts = candidates.groupBy(example, *keys, sql).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.length(sql)).alias("short"), F.col(sql).alias("text"))).alias("b")
    grouped = texts.groupBy(example, *keys).agg(F.sum("n").alias("votes"), F.count(F.lit(1)).alias("distinct_sqls"), best).withColumn("representative", F.col("b.text")).drop("b")
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy(example).orderBy(F.desc("votes"), F.desc("representative"))))


def verifier_pick(groups: DataFrame, example: str = "example", margin: str = "margin", votes: str = "votes", index: str = "idx") -> DataFrame:
    """The group of highest verifier margin, then votes, then earliest."""
    order = Window.partitionBy(example).orderBy(F.desc(margin), F.desc(votes), F.asc(index))
    return groups.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
