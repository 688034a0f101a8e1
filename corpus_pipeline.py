"""From raw documents to packed sequences: five stages over the ``documents`` table.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  Null and empty texts fail the quality rules, so later stages only meet them
in tables that did not come through the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, packing, quality_rules, secrets, suffix_dedup
from quillspark.llm.common import Scratch, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id."""
    return jaccard_join.keep_one(docs)


#: Bytes of a string that counts as a repeated passage: passages of 50 words are 260 bytes
#: and more.  (The query of the operator alone is held to 400.)
PASSAGE, PASSAGE_GRAM = 240, 32


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text covered by strings of ``PASSAGE`` bytes that start elsewhere too is cut out, every
    copy of it, as the operator does; a document of which nothing is left stays as an empty one."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE, gram=PASSAGE_GRAM, carry=True, with_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*((new[c] if c in new else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def hidden_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; no document goes."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_by_cost(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("hidden_secrets", hidden_secrets),
    ("packed", packed),
]

#: Trees, byte strings and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)  # the stage before is read no more
    return STAGES[-1][1](spark, docs, sf_dir)
