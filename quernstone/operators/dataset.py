"""Dataset construction: checks, deduplication, leakage, sampling, quotas and splits.

Seeded choices use a SHA-256 of seed and key instead of a random stream, so they don't depend on the
order or partitioning of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_fraction, is_read_only, normalize_sql, stable_hash
from .evaluate import ranked_at


def keep_first(df: DataFrame, key: Column | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key, an expression or some columns."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def cap_per_key(df: DataFrame, key: Column, most: int, *order: Column | str) -> DataFrame:
    """At most ``most`` rows of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__rank") <= most).drop("__rank")


def with_key_count(df: DataFrame, key: Column, name: str = "key_count") -> DataFrame:
    """How often each row's key occurs. Counts are summed before the shuffle and joined back, so the rows of a hot
    key need not meet in one task."""
    keyed = df.withColumn("__key", key)
    counts = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("__key", "__of")
    return keyed.join(counts, F.col("__key").eqNullSafe(F.col("__of"))).drop("__key", "__of")


def round_robin(df: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    """n rows: the first of every group, then the second of every group, and so on."""
    ranked = df.withColumn("group_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("group_rank", group).limit(n)


def length_stratified(df: DataFrame, n: int, length: str, id: str) -> DataFrame:
    """n rows at evenly spaced ranks of length; the shortest and the longest are among them."""
    total = df.count()
    if n >= total:
        return df
    places = sorted({round(k * (total - 1) / (n - 1)) if n > 1 else 0 for k in range(n)})
    return ranked_at(df, length, places, id).drop("at")


def weighted_key(seed: int, id: str, weight: Column) -> Column:
    """The key of weighted sampling without replacement: -ln(u) / weight, smallest first."""
    return -F.ln(F.greatest(hash_fraction(seed, F.col(id)), F.lit(2.0**-33))) / weight


def sample_budget(rows: int, fraction: float) -> int:
    """How many rows a fraction of them is, rounded half to even."""
    return round(rows * fraction)


def weighted_sample(df: DataFrame, n: int, seed: int, id: str, weight: Column, template: Column | None = None, cap: int = 1) -> DataFrame:
    """n rows by weight without replacement, at most ``cap`` for each template; fewer rows than n is an error."""
    keyed = df.withColumn("sample_key", weighted_key(seed, id, weight))
    if template is not None:
        keyed = cap_per_key(keyed, template, cap, "sample_key", id)
    out = keyed.orderBy("sample_key", id).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows can be chosen")
    return out


def check_policy(fraction: float, cap: int, multipliers: dict[str, float], combine: str = "maximum") -> None:
    """Raises ValueError for a sampling policy that makes no sense."""
    if combine != "maximum" or not 0 <= fraction <= 1 or cap < 1 or any(m < 1 for m in multipliers.values()):
        raise ValueError("the policy combines by maximum, with a fraction in [0, 1], a cap from 1 and multipliers from 1")


def priority_multiplier(features: Column, multipliers: dict[str, float]) -> Column:
    """The greatest multiplier among a row's features, at least 1; a feature the policy does not know is an error."""
    table = F.create_map(*(x for k, v in multipliers.items() for x in (F.lit(k), F.lit(float(v))))) if multipliers else F.create_map(F.lit(""), F.lit(1.0))

    def known(f: Column) -> Column:
        return F.coalesce(F.try_element_at(table, f), F.raise_error(F.concat(F.lit("unknown feature: "), f)).cast("double"))

    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(features, known)), F.lit(1.0)))


def quotas(groups: DataFrame, total: int, group: str = "grp", count: str = "n", ties_descending: bool = False) -> DataFrame:
    """Proportional whole quotas of a small table of groups; what is left goes to the largest remainders."""
    every = Window.partitionBy(F.lit(1))
    exact = F.lit(total) * F.col(count) / F.sum(count).over(every)
    tie = F.desc(group) if ties_descending else F.asc(group)
    out = groups.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact").cast("long"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.bround(F.col("__exact") - F.col("__floor"), 9)), tie))
    left = F.lit(total) - F.sum("__floor").over(every)
    return out.withColumn("__rank", rank).withColumn("quota", (F.col("__floor") + (F.col("__rank") <= left).cast("int")).cast("long")).drop("__exact", "__floor", "__rank")


def group_split(df: DataFrame, key: Column, percent: float, name: str = "part", seed: str = "split-v1") -> DataFrame:
    """Whole groups go to validation by a hash of their key, about ``percent`` of them."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % 1000
    return df.withColumn(name, F.when(bucket < percent * 10, "validation").otherwise("train"))


def check_share(parts: DataFrame, percent: float, name: str = "part", points: float = 3.0) -> float:
    """The share of validation rows in percent; over ``points`` away from the wanted one is an error."""
    found = parts.agg((100.0 * F.count_if(F.col(name) == "validation") / F.count(F.lit(1))).alias("p")).first()["p"]
    if found is None or abs(found - percent) > points:
        raise ValueError(f"{found} % of the rows are for validation, {percent} % were asked for")
    return found


#: The most rows of a table of groups or settings that is given to every task.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table to be broadcast, of checked size: more rows than ``most`` are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows, which is too much to give to every task")
    return F.broadcast(df)


def small_if(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table to be broadcast if it is small; if not, it is left to a join by its keys, of which there are many then."""
    return df if df.limit(most + 1).count() > most else F.broadcast(df)


def split_search(groups: DataFrame, chosen: int, trials: int = 50_000, seed: int = 17, group: str = "grp", label: str = "label", count: str = "n") -> DataFrame:
    """The best of ``trials`` choices of ``chosen`` whole groups for validation: trial, error, n_rows and groups.

    groups has a row for each group and label with its number of rows. A trial takes the groups of least
    hash of seed, trial and group. Its error is that of the row count plus the mean of those of the label
    counts, each relative to the target, the same share of rows as of groups; ties go to the groups that
    sort first. Groups and labels are few and their table's size is checked; trials are rows, so they are
    scored in parallel: a trial is one row of arrays, never a row for each group.
    """
    spark = groups.sparkSession
    table = small(groups.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("string"), F.col(count).cast("long")))).alias("of"), F.sum(count).alias("n")))
    names = [r[0] for r in groups.select(F.col(label).cast("string").alias("l")).distinct().orderBy("l").limit(SMALL_ROWS).collect()]
    every = table.agg(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), "of", "n")).alias("groups"), F.sum("n").alias("total"))
    key = lambda g: F.sha2(F.concat(F.lit(f"{seed}:"), F.col("trial").cast("string"), F.lit(":"), g["g"]), 256)
    tried = spark.range(trials).withColumnRenamed("id", "trial").join(F.broadcast(every))
    keys = F.slice(F.array_sort(F.transform("groups", lambda g: F.struct(key(g).alias("k"), g["g"].alias("g")))), 1, chosen)
    tried = tried.withColumn("names", F.array_sort(F.transform(keys, lambda x: x["g"])))
    own = F.filter("groups", lambda g: F.array_contains("names", g["g"]))
    share = F.lit(float(chosen)) / F.size("groups")
    rows = lambda gs: F.aggregate(gs, F.lit(0).cast("long"), lambda a, g: a + g["n"])

    def off(found: Column, target: Column) -> Column:
        return F.abs(found - target) / F.greatest(F.lit(1.0), target)

    def of_label(gs: Column, name: str) -> Column:
        return F.aggregate(gs, F.lit(0).cast("long"), lambda a, g: a + F.coalesce(F.try_element_at(g["of"], F.lit(name)), F.lit(0).cast("long")))

    labels = [off(of_label(F.col("own"), x), of_label(F.col("groups"), x) * share) for x in names]
    error = off(F.col("n_rows"), F.col("total") * share) + sum(labels, F.lit(0.0)) / max(1, len(labels))
    scored = tried.withColumn("own", own).withColumn("n_rows", rows(F.col("own"))).withColumn("error", F.bround(error, 9))
    return scored.select("trial", "error", "n_rows", F.array_join("names", ",").alias("groups")).orderBy("error", "groups").limit(1)


def drop_long_groups(df: DataFrame, group: str, length: Column, most: int) -> DataFrame:
    """Groups without any member over the limit. Only the keys of groups with one are shuffled against the rows."""
    long = df.filter(length > most).select(F.col(group).alias("__long")).distinct()
    return df.join(long, F.col(group).eqNullSafe(F.col("__long")), "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both, once each."""
    return left.select(key).intersect(right.select(key))


def leakage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many different values of each key, and how many whole combinations of all, are in both parts."""
    shared = [overlap(left.select(F.col(k).alias("k")), right.select(F.col(k).alias("k")), "k").agg(F.count(F.lit(1)).alias(f"{k}_overlap")) for k in keys]
    whole = left.select(*keys).intersect(right.select(*keys)).agg(F.count(F.lit(1)).alias("exact_overlap"))
    out = whole
    for one in shared:  # each a single row
        out = out.join(F.broadcast(one))
    return out


def check_leakage(left: DataFrame, right: DataFrame, keys: Sequence[str], fatal: Sequence[str]) -> dict[str, int]:
    """The counts of ``leakage``; one that must be 0 and is not is an error."""
    found = leakage(left, right, keys).first().asDict()
    if bad := {k: found[k] for k in fatal if found[k]}:
        raise ValueError(f"the parts overlap: {bad}")
    return found


def check_split(whole: DataFrame, parts: Sequence[DataFrame], key: str) -> None:
    """Raises ValueError unless the parts share no key and together hold all rows of the whole."""
    for k, left in enumerate(parts):
        for right in parts[k + 1 :]:
            check_disjoint(left, right, key)
    n, m = whole.count(), sum(p.count() for p in parts)
    if n != m:
        raise ValueError(f"the parts hold {m} rows, the whole {n}")


def supplemented(base: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows of a base and of supplements, as they are; ``origin`` tells the table (0 is the base) a row is from."""
    out = base.withColumn("origin", F.lit(0))
    for k, df in enumerate(more, 1):
        out = out.unionByName(df.withColumn("origin", F.lit(k)))
    return out


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an explicit order, for a smoke run; all if n is 0."""
    return df.orderBy(*order).limit(n) if n else df


def unused(catalog: DataFrame, used: Sequence[DataFrame], key: str = "db_id") -> DataFrame:
    """Names of a catalog that no part uses."""
    out = catalog.select(key).distinct()
    for df in used:
        out = out.join(df.select(key).distinct(), key, "left_anti")
    return out


def align_models(models: dict[str, DataFrame], id: str, value: str) -> DataFrame:
    """One row for each id with a column for each model; a model that lacks an id, has one too many, or has one
    twice is an error."""
    (first, base), *rest = models.items()
    for name, df in rest:
        report = alignment(base, df, id).first()
        if report["missing"] or report["extra"] or report["repeated"]:
            raise ValueError(f"{name} and {first} have different ids: {report.asDict()}")
    out = base.select(id, F.col(value).alias(first))
    for name, df in rest:
        out = out.join(df.select(id, F.col(value).alias(name)), id)
    return out


def check_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    if n := overlap(left, right, key).count():
        raise ValueError(f"{n} values of {key} are in both parts")


def check_aligned(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises ValueError unless both sides have the same keys, each once."""
    report = alignment(left, right, key).first()
    if report["missing"] or report["extra"] or report["repeated"]:
        raise ValueError(f"keys differ: {report.asDict()}")


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys missing on the right, extra on the right, on both sides, and repeated on a side."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("r").isNull()).alias("missing"),
        F.count_if(F.col("l").isNull()).alias("extra"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("aligned"),
        F.count_if((F.coalesce("l", F.lit(0)) > 1) | (F.coalesce("r", F.lit(0)) > 1)).alias("repeated"),
    )


def without_protected(df: DataFrame, protected: DataFrame, key: Column) -> DataFrame:
    """Rows whose normalised key does not occur in the protected table (column ``key``)."""
    return df.withColumn("__key", key).join(protected.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def label_sets(df: DataFrame, group: str, label: str, labels: Sequence[object]) -> DataFrame:
    """For each group whether it has every label."""
    return df.groupBy(group).agg((F.count_distinct(F.when(F.col(label).isin(*labels), F.col(label))) == len(labels)).alias("complete"), F.count(F.lit(1)).alias("n"))


def source_violations(rows: DataFrame, split: str) -> DataFrame:
    """Rows (id, violation) that break a rule on training examples: id, split, status, messages, target, sql."""
    repeated = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    target = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    rules = {
        "repeated_id": repeated,
        "wrong_split": F.col("split") != split,
        "not_validated": F.col("status") != "ok",
        "wrong_roles": F.transform("messages", lambda m: m["role"]) != F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
        "target_is_not_sql": normalize_sql(target) != normalize_sql(F.col("sql")),
        "not_a_query": ~is_read_only(F.col("sql")),
        "fenced": target.contains("```"),
    }
    found = rows.withColumn("violation", F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), name) for name, test in rules.items()))))
    return found.select("id", F.explode("violation").alias("violation"))


def fingerprint(df: DataFrame, id: str) -> DataFrame:
    """One digest of all ids as text, in order, a line each, and the number of rows; nulls have no line. The digest
    runs over one sequence: tasks sort the ids by ranges and pack each batch of them into one compressed piece, and
    one task digests the pieces in order. A row of two values is all that reaches the driver."""
    import hashlib

    def pack(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).drop_null().to_pylist()
            body = zlib.compress("\n".join(ids).encode(), 1) if ids else None
            yield pa.RecordBatch.from_pydict({"first": pa.array(ids[:1] or [None], pa.string()), "last": pa.array(ids[-1:] or [None], pa.string()), "body": pa.array([body], pa.binary()), "n": pa.array([batch.num_rows], pa.int64())})

    def digest(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        found, n, begun = hashlib.sha256(), 0, False
        for batch in batches:
            for body, rows in zip(batch.column(0), batch.column(1), strict=True):
                n += rows.as_py()
                if body.is_valid:
                    found.update((b"\n" if begun else b"") + zlib.decompress(body.as_py()))
                    begun = True
        yield pa.RecordBatch.from_pydict({"fingerprint": pa.array([found.hexdigest()], pa.string()), "n": pa.array([n], pa.int64())})

    pieces = df.select(F.col(id).cast("string").alias("i")).orderBy("i").mapInArrow(pack, "first string, last string, body binary, n long")
    # Pieces with the same first and last id hold that one id only, so these two order them.
    one = pieces.repartition(1).sortWithinPartitions("first", "last").select("body", "n").mapInArrow(digest, "fingerprint string, n long")
    return one.agg(F.coalesce(F.max("fingerprint"), F.lit(hashlib.sha256().hexdigest())).alias("fingerprint"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"))


def split_usable(rows: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Rows that ran or weren't run, and the others."""
    good = F.col(status).isin("ok", "not_run")
    return rows.filter(good), rows.filter(~F.coalesce(good, F.lit(False)))


def pending(rows: DataFrame, done: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is not in an output written before."""
    return rows.join(done.select(id).distinct(), id, "left_anti")


__all__ = [name for name in dir() if not name.startswith("_")] + ["stable_hash"]
