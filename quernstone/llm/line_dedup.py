"""Line deduplication with DataFrame functions only.

A document is split at ``\\n``. The key of a line is the line without white space at both ends and
with A-Z lower-cased. Pass one explodes the distinct key hashes of each document and counts them,
so a hash's count is its number of documents; partial sums are formed before the shuffle, which
keeps a very common line cheap. Pass two joins the positions of all lines with the hashes over the
threshold and gathers the positions to drop for each document. The frequent hashes are written first:
their size is then known, so they are broadcast only where it allows that, and else both sides of the
join come straight from their shuffles, where adaptive execution splits the places of a very common
line. The text itself is shuffled at most once, in the last join.

Defined results: each row is a document of its own, also where ids are null or repeat. A null text
counts as one empty line for the counts and stays null in ``kept``; an empty text is one empty line.
Lines whose key is shorter than ``min_chars`` code points are never dropped. A document that loses
all its lines keeps an empty text. An empty table gives an empty table. All input columns, whatever
their names, are kept; only a column named like ``out`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, column, lower_ascii


def _line_hashes(text: Column, min_chars: int) -> Column:
    """One MD5 for each line, null for lines that are never dropped."""

    def of(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(key) >= min_chars, F.md5(key))

    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1), of)


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The hashes (``line_hash``) of line keys found in at least ``min_docs`` rows, with ``n_docs``."""
    hashes = F.array_compact(F.array_distinct(_line_hashes(column(text), max(1, min_chars))))
    return (
        docs.select(F.explode(hashes).alias("line_hash"))
        .groupBy("line_hash")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs)
    )


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, out: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct ``out``: ``kept`` (the text of the remaining lines), ``n_lines``, ``n_dropped``."""
    names = [c for c in docs.columns if c != out]
    kept_columns = [f"__c{n}" for n in range(len(names))]
    docs = docs.select(column(id).alias("__id"), column(text).alias("__text"), *(column(c).alias(k) for c, k in zip(names, kept_columns, strict=True)))
    docs = docs.withColumns({"__k1": F.xxhash64("__text"), "__k2": F.xxhash64(F.lit(1), F.col("__text"))})
    # Written, so that its size is known: Spark broadcasts it only where it is small, and splits a hot line where not.
    frequent = Scratch(docs.sparkSession, "lines").keep(frequent_lines(docs, "__text", min_docs, min_chars)).select(F.col("line_hash").alias("__hash"))
    # A row is known by its id and two hashes of its text; rows equal in all of these lose the same lines.
    dropped = (
        docs.select("__id", "__k1", "__k2", F.posexplode(_line_hashes(F.col("__text"), max(1, min_chars))).alias("__pos", "__hash"))
        .filter(F.col("__hash").isNotNull())
        .join(frequent, "__hash")
        .groupBy(F.col("__id").alias("__rid"), F.col("__k1").alias("__r1"), F.col("__k2").alias("__r2"))
        .agg(F.collect_set("__pos").alias("__dropped"))
    )
    same = F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2"))
    both = docs.join(dropped, same, "left").withColumn("__lines", F.split(F.coalesce("__text", F.lit("")), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__dropped"))
    joined = F.array_join(F.transform(places, lambda p: F.element_at(F.col("__lines"), p + 1)), "\n")
    result = F.struct(
        F.when(F.col("__dropped").isNull(), F.col("__text")).otherwise(joined).alias("kept"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return both.select(*(F.col(k).alias(c) for c, k in zip(names, kept_columns, strict=True)), result.alias(out))
