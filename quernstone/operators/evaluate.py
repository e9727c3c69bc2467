"""Evaluation analytics: slices, histograms, distributions, bins, paired tests, disagreement, pivots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percentage


def accuracy_by(df: DataFrame, group: Sequence[str], correct: Column) -> DataFrame:
    """support, correct and accuracy_pct of each group."""
    out = df.groupBy(*group).agg(F.count(F.lit(1)).alias("support"), F.count_if(correct).alias("correct"))
    return out.withColumn("accuracy_pct", percentage(F.col("correct"), F.col("support")))


def accuracy_with_total(df: DataFrame, group: str, correct: Column, total: str = "all") -> DataFrame:
    """The same for each group and over all, in one pass (grouping sets)."""
    out = df.rollup(group).agg(F.grouping(group).alias("g"), F.count(F.lit(1)).alias("support"), F.count_if(correct).alias("correct"))
    return out.select(F.when(F.col("g") == 1, total).otherwise(F.col(group)).alias(group), "support", "correct", percentage(F.col("correct"), F.col("support")).alias("accuracy_pct"))


def two_metrics(df: DataFrame, group: Sequence[str], strict: Column, compatible: Column) -> DataFrame:
    """Both metrics and the promotions, rows that only the lenient one accepts."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("support"), F.count_if(strict).alias("strict"), F.count_if(compatible).alias("compatible"), F.count_if(compatible & ~strict).alias("promotions"))


def macro_accuracy(df: DataFrame, key: Column, correct: Column) -> DataFrame:
    """Over distinct keys: their number, the mean of their accuracies, and how many are all or partly correct."""
    each = df.groupBy(key.alias("k")).agg(F.avg(correct.cast("double")).alias("a"), F.bool_and(correct).alias("every"), F.bool_or(correct).alias("some"))
    return each.agg(F.count(F.lit(1)).alias("n_unique"), F.bround(100 * F.avg("a"), 3).alias("macro_pct"), F.count_if("every").alias("all_correct"), F.count_if("some").alias("any_correct"))


def histogram(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, n and rank: the most frequent first, equals in order of first sight. The ranking is over the
    distinct values, so this is for statuses and labels, not for keys."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")))


def nested_histogram(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """For each outer value how often each inner one occurs, and its share in percent, one decimal."""
    counted = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(outer)), 1))


#: The flags of a prediction that a summary counts (fixed values).
FLAGS = ("raw_exact_match", "normalized_exact_match", "canonical_exact_match", "syntax_valid", "execution_match", "format_compliant", "input_truncated", "candidate_oracle_match")


def summarize(predictions: DataFrame, slice: str = "complexity", latency: str = "generation_ms_per_example", flags: Sequence[str] = FLAGS) -> DataFrame:
    """For each slice and over all ("all"): examples, the count and percentage of each flag, and the mean latency
    of those that have one. Null flags count as false, null slices as ``unknown``. One pass."""
    known = predictions.select(F.coalesce(F.col(slice).cast("string"), F.lit("unknown")).alias(slice), latency, *flags)
    counts = [F.count_if(F.coalesce(F.col(k).cast("boolean"), F.lit(False))).alias(f"{k}_count") for k in flags]
    out = known.rollup(slice).agg(F.grouping(slice).alias("__g"), F.count(F.lit(1)).alias("examples"), *counts, F.bround(F.avg(latency), 3).alias("mean_latency"))
    pcts = [percentage(F.col(f"{k}_count"), F.col("examples")).alias(f"{k}_pct") for k in flags]
    return out.select(F.when(F.col("__g") == 1, "all").otherwise(F.col(slice)).alias(slice), "examples", *(f"{k}_count" for k in flags), *pcts, "mean_latency")


def subset_accuracy(df: DataFrame, correct: Column, usable: Column) -> DataFrame:
    """One row: accuracy over all rows, and over those whose reference ran."""
    ok = F.coalesce(usable, F.lit(False))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("correct"), F.count_if(ok).alias("usable"), F.count_if(ok & correct).alias("usable_correct"))
    return out.withColumns({"accuracy_pct": percentage(F.col("correct"), F.col("n")), "usable_accuracy_pct": percentage(F.col("usable_correct"), F.col("usable"))})


def distribution(df: DataFrame, group: Sequence[str], x: Column) -> DataFrame:
    """count, min, median, p95 and max; percentiles are interpolated. All are 0 where there is no value."""
    p = lambda q: F.bround(F.percentile(x.cast("double"), F.lit(q)), 3)
    parts = {"min": F.min(x), "median": p(0.5), "p95": p(0.95), "max": F.max(x)}
    return df.groupBy(*group).agg(F.count(x).alias("n"), *(F.coalesce(c, F.lit(0)).alias(k) for k, c in parts.items()))


def _buckets(df: DataFrame, x: str, n: int = 64) -> Column:
    """The number of the range of values that a row's x falls in, from approximate quantiles: about n ranges of
    equal size, each value in one of them, nulls in the first."""
    bounds = sorted(set(df.select(F.col(x).cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.005)))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.coalesce(F.col(x).cast("double"), F.lit(-math.inf))))


def ranked_at(df: DataFrame, x: str, places: Sequence[int], *ties: str) -> DataFrame:
    """The rows at the given places (from 0) of the order by x and ties, with the place as ``at``. Rows are dealt
    by ranges of x; the sizes of the ranges, some numbers, reach the driver, and only ranges that hold a
    place are sorted, each in a task of its own."""
    dealt = df.withColumn("__b", _buckets(df, x))
    sizes = {r["__b"]: r["n"] for r in dealt.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, first = 0, {}
    for b in sorted(sizes):
        if any(before <= k < before + sizes[b] for k in places):
            first[b] = before
        before += sizes[b]
    if not first:
        return df.limit(0).withColumn("at", F.lit(0).cast("long"))
    start = F.create_map(*(F.lit(v) for b in first.items() for v in b))
    ranked = dealt.filter(F.col("__b").isin(*first)).withColumn("at", F.row_number().over(Window.partitionBy("__b").orderBy(x, *ties)) - 1 + start[F.col("__b")])
    return ranked.filter(F.col("at").isin(*places)).drop("__b")


def lower_percentiles(df: DataFrame, x: str, fractions: Sequence[float]) -> DataFrame:
    """For each fraction the value at place floor((n - 1) * f) of the sorted values, without interpolation."""
    n = df.count()
    at = [(float(f), math.floor((n - 1) * f)) for f in fractions]
    found = ranked_at(df.select(x), x, sorted({k for _, k in at}))
    asked = df.sparkSession.createDataFrame(at, "fraction double, place long")
    return found.join(F.broadcast(asked), F.col("at") == F.col("place")).select("fraction", F.col(x).alias("value"))


def length_summary(df: DataFrame, x: str, id: str, limit: int) -> DataFrame:
    """min, whole median, p95 and p99 (lower places, as lower_percentiles), max, total, rows over the limit, and
    the id of the longest (the first of equals). An empty table gives a row of nulls and zeros."""
    longest = F.max(F.struct(F.col(x).alias("x"), (-F.col(id)).alias("i")))
    one = df.agg(F.min(x).alias("min"), F.floor(F.percentile(F.col(x), F.lit(0.5))).cast("long").alias("median"), F.max(x).alias("max"), F.coalesce(F.sum(x), F.lit(0)).alias("total"), F.count_if(F.col(x) > limit).alias("over_limit"), (-longest["i"]).alias("longest_id"))
    high = lower_percentiles(df, x, [0.95, 0.99]).agg(F.max(F.when(F.col("fraction") == 0.95, F.col("value"))).alias("p95"), F.max(F.when(F.col("fraction") == 0.99, F.col("value"))).alias("p99"))
    return one.join(F.broadcast(high)).select("min", "median", "p95", "p99", "max", "total", "over_limit", "longest_id")


def simple_stats(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """min, max, mean with two decimals, and median of each group."""
    return df.groupBy(*group).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.bround(F.avg(x), 2).alias("mean"), F.percentile(F.col(x).cast("double"), F.lit(0.5)).alias("median"))


def latency_summary(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count(x).alias("n"), F.bround(F.avg(x), 6).alias("mean"), F.bround(F.median(x), 6).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.bround(F.stddev_samp(x), 6).alias("stdev"))


def exploded_accuracy(df: DataFrame, features: str, correct: Column) -> DataFrame:
    """Accuracy of the rows of each feature; a row counts for all its features."""
    return accuracy_by(df.withColumn("feature", F.explode(features)), ["feature"], correct)


def with_and_without(df: DataFrame, features: dict[str, Column], correct: Column) -> DataFrame:
    """For each feature: rows with and without it and the accuracy of both in percent, three decimals (null where
    there are none). One pass over the rows."""
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), F.coalesce(c, F.lit(False)).alias("has")) for k, c in features.items()))
    each = df.select(F.explode(rows).alias("f"), correct.cast("int").alias("ok")).select("f.feature", "f.has", "ok")

    def part(has: bool) -> tuple[Column, Column]:
        own = F.col("has") if has else ~F.col("has")
        return F.count_if(own), F.bround(100 * F.avg(F.when(own, F.col("ok"))), 3)

    n, a = part(True)
    m, b = part(False)
    return each.groupBy("feature").agg(n.alias("n_with"), a.alias("with_pct"), m.alias("n_without"), b.alias("without_pct"))


def hardest(df: DataFrame, group: str, correct: Column, least: int = 20, n: int = 5) -> DataFrame:
    """The groups of lowest accuracy among those with enough support."""
    return accuracy_by(df, [group], correct).filter(F.col("support") >= least).orderBy("accuracy_pct", F.desc("support"), group).limit(n)


def bins(x: Column, uppers: Sequence[tuple[float, str]], last: str) -> Column:
    """The label of the first bin whose upper end, included, reaches the value."""
    out = F.lit(last)
    for upper, label in reversed(uppers):
        out = F.when(x <= upper, label).otherwise(out)
    return out


def binned_accuracy(df: DataFrame, dimensions: dict[str, Column], correct: Column) -> DataFrame:
    """Accuracy by bin for several dimensions at once, each a column of labels; one pass over the rows."""
    labels = F.array(*(F.struct(F.lit(k).alias("dimension"), c.alias("bin")) for k, c in dimensions.items()))
    each = df.select(F.explode(labels).alias("d"), correct.alias("ok")).select("d.dimension", "d.bin", "ok")
    return accuracy_by(each, ["dimension", "bin"], F.col("ok"))


#: Below each accuracy in percent, how often a feature's examples may be drawn at most (fixed values).
MULTIPLIERS = ((50, 3.0), (60, 2.5), (70, 2.0), (80, 1.5))


def priorities(df: DataFrame, group: str, correct: Column) -> DataFrame:
    """Groups by impact, failures * log2(support + 1) with two decimals, the greatest first, and how often the
    examples of a group may be drawn at most, by its accuracy."""
    out = accuracy_by(df, [group], correct)
    impact = F.bround((F.col("support") - F.col("correct")) * F.log2(F.col("support") + 1), 2)
    multiplier = F.lit(1.0)
    for below, value in reversed(MULTIPLIERS):
        multiplier = F.when(F.col("accuracy_pct") < below, value).otherwise(multiplier)
    return out.withColumns({"impact": impact, "multiplier": multiplier}).orderBy(F.desc("impact"), group)


def paired(df: DataFrame, group: Sequence[str], before: Column, after: Column) -> DataFrame:
    """Transitions between two metrics of the same rows, with the net change in points."""
    out = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(~before & after).alias("corrected"), F.count_if(before & ~after).alias("regressed"), F.count_if(before & after).alias("both_correct"), F.count_if(~before & ~after).alias("both_wrong"))
    return out.withColumn("net", F.col("corrected") - F.col("regressed")).withColumn("net_pp", F.coalesce(F.bround(100.0 * F.col("net") / F.col("n"), 3), F.lit(0.0)))


def exact_mcnemar(corrected: int, regressed: int) -> float:
    """The two-sided exact binomial p value of discordant pairs; 1 without any."""
    n = corrected + regressed
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(min(corrected, regressed) + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, log)))


def mcnemar_by(df: DataFrame, group: str, before: Column, after: Column) -> DataFrame:
    """The paired table of each group with its p value; as many rows as groups reach the driver."""
    rows = [(*r, exact_mcnemar(r["corrected"], r["regressed"])) for r in paired(df, [group], before, after).collect()]
    return df.sparkSession.createDataFrame(rows, f"{group} string, n long, corrected long, regressed long, both_correct long, both_wrong long, net long, net_pp double, p_value double")


def disagreement(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """How often each set of models (boolean columns, in order of priority) is right together."""
    names = F.array_join(F.array_compact(F.array(*(F.when(F.col(m), m) for m in models))), " + ")
    return df.groupBy(F.coalesce(F.nullif(names, F.lit("")), F.lit("none")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def crosstab_share(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """Counts of pairs and their share of the row, one decimal."""
    counted = df.groupBy(row.alias("row_key"), column.alias("col_key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("row_key")), 1))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence[str], x: str, fill: float | None = None) -> DataFrame:
    """The mean of x for each row key, a column for each given value; ``fill`` where there is none."""
    out = df.groupBy(row).pivot(column, list(values)).agg(F.bround(F.avg(x), 3))
    return out if fill is None else out.fillna(fill, subset=list(values))


def pair_cooccurrence(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Unordered pairs of distinct items of one basket, and in how many baskets they meet.

    Baskets are gathered as sets and the pairs built within each row, so there is no self-join.
    """
    sets = df.groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", "n")


def fk_alignment(conditions: DataFrame, keys: DataFrame) -> DataFrame:
    """Join conditions (l, r), each side ``table.column``, that are declared keys in either direction, or that name
    the same two columns as one, whatever the tables (as aliases do): n, aligned, by_column and percent."""
    from .dataset import small_if

    def pair(a: Column, b: Column) -> Column:
        return F.array_join(F.array_sort(F.array(F.lower(a), F.lower(b))), "=")

    def columns(a: Column, b: Column) -> Column:
        return pair(F.substring_index(a, ".", -1), F.substring_index(b, ".", -1))

    l, r = F.col("l"), F.col("r")
    whole = keys.select(pair(l, r).alias("k")).distinct().withColumn("hit", F.lit(1))
    named = keys.select(columns(l, r).alias("ck")).distinct().withColumn("column_hit", F.lit(1))
    joined = conditions.withColumns({"k": pair(l, r), "ck": columns(l, r)}).join(small_if(whole), "k", "left").join(small_if(named), "ck", "left")
    out = joined.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("aligned"), F.count_if(F.col("hit").isNull() & F.col("column_hit").isNotNull()).alias("by_column"))
    either = F.col("aligned") + F.col("by_column")
    return out.withColumn("aligned_pct", F.coalesce(F.bround(100.0 * either / F.nullif(F.col("n"), F.lit(0)), 1), F.lit(0.0)))


def reference_precision(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Micro-averaged precision of exploded references (kind, name) against known names (kind, name)."""
    out = _grounded(refs, known).groupBy("kind").agg(F.count(F.lit(1)).alias("refs"), F.count("hit").alias("grounded"))
    return out.withColumn("precision_pct", percentage(F.col("grounded"), F.col("refs")))


def _grounded(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Known names go to every task if they are few, so the references of a frequent name need not meet in one."""
    from .dataset import small_if

    names = known.select("kind", F.lower("name").alias("k")).distinct().withColumn("hit", F.lit(1))
    return refs.withColumn("k", F.lower("name")).join(small_if(names), ["kind", "k"], "left")


def linking_precision(refs: DataFrame, known: DataFrame, id: str = "id", correct: str = "correct") -> DataFrame:
    """For correct and wrong predictions: how many there are, how many have all their references grounded, and the
    micro-averaged precision of tables and columns. refs: id, correct, kind ("table" or "column"), name."""
    count = lambda kind, hit: F.count_if((F.col("kind") == kind) & (F.col("hit").isNotNull() if hit else F.lit(True)))
    parts = {f"{kind}_{what}": count(kind, what == "grounded") for kind in ("table", "column") for what in ("refs", "grounded")}
    each = _grounded(refs, known).groupBy(id, correct).agg(F.bool_and(F.col("hit").isNotNull()).alias("every"), *(c.alias(k) for k, c in parts.items()))
    out = each.groupBy(correct).agg(F.count(F.lit(1)).alias("n"), F.count_if("every").alias("fully_grounded"), *(F.sum(k).alias(k) for k in parts))
    return out.withColumns({f"{kind}_precision_pct": percentage(F.col(f"{kind}_grounded"), F.col(f"{kind}_refs")) for kind in ("table", "column")})


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    rows = [list(map(cell, r)) for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def representatives(df: DataFrame, outcome: str, rank: str, tokens: str, id: str, mismatch: str, n: int = 20, per_outcome: int = 3, per_mismatch: int = 2, scan: int = 10_000) -> list[dict]:
    """The ``n`` most telling rows: by complexity rank, longest first, then id; at most ``per_outcome`` of one outcome
    and ``per_mismatch`` of one mismatch, filled up in the same order if too few are left. The caps bear on
    each other, so the choice is made on the driver, over the first ``scan`` rows of the order at most."""
    rows = [r.asDict() for r in df.orderBy(rank, F.desc(tokens), id).limit(scan).collect()]
    met: dict[tuple, int] = {}
    chosen, others = [], []
    for r in rows:
        keys = (("outcome", r[outcome]), ("mismatch", r[mismatch]))
        room = all(met.get(k, 0) < most for k, most in zip(keys, (per_outcome, per_mismatch), strict=True))
        (chosen if room and len(chosen) < n else others).append(r)
        if room and len(chosen) <= n:
            for k in keys:
                met[k] = met.get(k, 0) + 1
    return (chosen + others)[:n]


def split_report(rows: DataFrame, sql: str, split: str = "split") -> DataFrame:
    """For each split and all of them: statements, the share in percent of each clause, and how many fall in each
    complexity tier and hardness. One pass with a rollup."""
    from ..functions import sqlfeatures as sf

    flags, tier, hard = sf.clause_flags(F.col(sql)), sf.complexity_tier(F.col(sql)), sf.hardness(F.col(sql))
    known = rows.select(split, *(c.alias(k) for k, c in flags.items()), tier.alias("__tier"), hard.alias("__hard"))
    shares = [percentage(F.count_if(F.col(k)), F.count(F.lit(1))).alias(f"{k}_pct") for k in flags]
    tiers = [F.count_if(F.col("__tier") == t).alias(f"tier_{t}") for t in ("simple", "moderate", "complex", "extra")]
    hards = [F.count_if(F.col("__hard") == h).alias(f"hardness_{h.replace(' ', '_')}") for h in ("easy", "medium", "hard", "extra hard")]
    out = known.rollup(split).agg(F.grouping(split).alias("__g"), F.count(F.lit(1)).alias("n"), *shares, *tiers, *hards)
    return out.withColumn(split, F.when(F.col("__g") == 1, "all").otherwise(F.col(split))).drop("__g")


def dataset_report(rows: DataFrame, split: str = "split", db: str = "db_id", question: str = "question", sql: str = "sql", status: str = "status") -> DataFrame:
    """For each split: examples, usable ones (that ran or were not run), databases, distinct questions and statements,
    rows whose statement repeats, and the distributions of question words and statement tokens. Distinct
    texts are counted by their hash."""
    from ..functions import text as tx

    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    known = rows.select(
        split, db, status,
        F.sha2(tx.normalize_question(F.col(question)), 256).alias("__q"),
        F.sha2(tx.normalize_sql(F.col(sql)), 256).alias("__s"),
        words(F.col(question)).alias("__qw"),
        words(tx.normalize_sql(F.col(sql))).alias("__st"),
    )
    p = lambda c, q: F.bround(F.percentile(F.col(c).cast("double"), F.lit(q)), 3)
    spread = [f.alias(f"{name}_{k}") for name, c in (("question_words", "__qw"), ("sql_tokens", "__st")) for k, f in (("min", F.min(c)), ("median", p(c, 0.5)), ("p95", p(c, 0.95)), ("max", F.max(c)))]
    out = known.groupBy(split).agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(F.col(status).isin("ok", "not_run")).alias("usable_examples"), F.count_distinct(db).alias("databases"),
        F.count_distinct("__q").alias("unique_questions"), F.count_distinct("__s").alias("unique_sql"), *spread,
    )
    return out.withColumn("duplicate_sql_rows", F.col("examples") - F.col("unique_sql"))
