"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before
kept; all but the last return the columns of ``documents``.  ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularlab.llm import bpe, linededup, mixing, quality, queries, simhash
from tabularlab.llm.common import SPACE_CLASS, Scratch
from tabularlab.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    kept = quality.apply_rules(docs)
    return kept.where(F.col(kept.columns[-1])).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines.  A document that loses all its words that way
    was said elsewhere before, and goes; n_chars follows the text."""
    rows = linededup.drop_lines(docs, short=linededup.SHORT_EDITS)
    dropped = F.col(rows.columns[-1])
    word = F.coalesce(F.col("text"), F.lit("")).rlike(f"[^{SPACE_CLASS}]")
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.where((dropped == 0) | word) \
        .withColumn("n_chars", F.when(dropped > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in a new global order."""
    return mixing.mix_sources(docs, with_keys=False)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row per copy."""
    return bpe.encode_digests(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", simhash_stage),
    ("source mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# Fingerprints, line edits and the tokenizer are not expressible in SQL; tests hold run()
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for i, (_, stage) in enumerate(STAGES):
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage{i}", keep=i == len(STAGES) - 1)
    return docs
