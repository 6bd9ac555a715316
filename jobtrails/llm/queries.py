"""Registered queries of this folder: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrails.llm import (decontam, filter_audit, gru_lm, host_quality, langid, packing, pfp_dedup, sharding, simhash,
                           toxicity, url_trie, whitening, zstd_quality)
from jobtrails.llm.common import table
from jobtrails.llm.oracles import ORACLES  # noqa: F401

#: entries of the url lists: (host/path, verdict)
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f
    return add


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", "predicted", "evidence", "n_segments")


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_host_quality")
def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = host_quality.quality_filter(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_pack")
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query("op9_language_model")
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp_dedup.remove_repeats(table(spark, sf_dir, "documents"), 200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_filter_audit")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_compression_quality")
def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = zstd_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", "predicted", "n_bytes", "good_bytes", "bad_bytes")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    # a long by contract: null where the exact square sum is beyond one
    return d.withColumn("deviation", F.col("deviation").try_cast("bigint"))
