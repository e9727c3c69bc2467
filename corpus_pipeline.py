"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes its
result as Parquet in the shared folder and reads it again for the next one, so a lost executor costs
no more than the tasks it ran. All but the last return the columns of ``documents``.

Defined results, the same in every stage: rows that repeat, and rows without an id, are handled as the
stage's operator states; an empty table gives an empty table; texts of any length are read whole; extra
columns, whatever their names, are kept by all stages but the last. What a null or empty text, a tie or
a repeated id means is stated at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.bpe import encode_decode
from quernstone.llm.common import Scratch, column, table
from quernstone.llm.decontaminate import remove_contaminated
from quernstone.llm.jaccard_join import keep_one_of_each
from quernstone.llm.language_id import keep_identified
from quernstone.llm.line_dedup import dedup_lines


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no language go: null and empty texts, and those without a letter. Of the others
    each keeps its ``lang``; where that is null the predicted language is put in."""
    return keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; the texts are what is left, with their length as ``n_chars``.
    Documents that lose all their lines stay, with an empty text; null texts stay null."""
    out = dedup_lines(docs).withColumn("text", F.col("line_dedup.kept"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id stays, one row of it. Texts without words
    are in no group, so all of them stay. Where an id repeats with several texts, each text is a document
    of its own; of those tied on the id, the one of the least hash stays. Rows without an id all stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go. Null and empty texts stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, as number and digest, and the digest of the text decoded from them. A null
    or empty text has no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(docs, path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: SQL cannot express stages 1 and 5; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
