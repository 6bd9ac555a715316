"""The training-data pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtrails.llm import decontam, langid, packing, pfp_dedup, simhash
from jobtrails.llm.common import materialise, table
from jobtrails.llm.queries import tokenizer_path
from jobtrails.session import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language; those without letters or between two languages go."""
    checkpoint_dir(spark)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that with the smallest doc_id."""
    checkpoint_dir(spark)
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere; n_chars follows."""
    checkpoint_dir(spark)
    return pfp_dedup.cut_repeats(docs, 200)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in the sequences."""
    checkpoint_dir(spark)
    # a worker serves all the stages: a smaller memo than that of packing alone
    return packing.pack(docs, tokenizer_path(), 1024, memo=300_000)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: no SQL expresses the classifier, the fingerprints or the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
