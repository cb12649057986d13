"""The registered queries of this subpackage: operator digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabularlab.llm import (bpe, cluster, conversation, linededup, lm, mixing, quality, search, sharding, simhash, sketch,
                            tokenfile, warc)
from tabularlab.sources.tables import table


def tokenizer(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file; executors have the same packages."""
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_quality_rules", quality.QUALITY_SQL)
def op1(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op2_simhash_groups")
def op2(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_bpe_round_trip")
def op6(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op8_token_files")
def op8(spark, sf_dir):
    return tokenfile.token_file_report(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op10_warc_salvage", warc.ARCHIVE_SQL)
def op10(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


@query("op9_lattice_scores")
def op9(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op3_poisson_mix", mixing.MIX_SQL)
def op3(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op4_histogram_shards")
def op4(spark, sf_dir):
    return sharding.shard_report(table(spark, sf_dir, "documents"))


@query("op5_line_dedup")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_lines(docs, short=linededup.SHORT_EDITS).select("doc_id", "n_lines", "n_dropped", "text")


@query("op7_bm25_top10", search.SEARCH_SQL)
def op7(spark, sf_dir):
    return search.every_fiftieth(table(spark, sf_dir, "documents"))


@query("op11_centroid_clusters", cluster.CLUSTER_SQL)
def op11(spark, sf_dir):
    return cluster.cluster_report(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    return conversation.damaged_report(table(spark, sf_dir, "conversations"))


@query("op13_document_fingerprints")
def op13(spark, sf_dir):
    return sketch.edited_report(table(spark, sf_dir, "documents"))
