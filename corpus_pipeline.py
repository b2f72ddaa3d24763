"""Document preparation: each stage works on all that the previous one kept.

Toxic documents go, repeated lines are cut, one document of each near-duplicate group stays, the rest is sampled to the
target mixture, and what is left is encoded.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, linededup, minmax, mixing, toxicity
from tidemark.llm.common import read_table
from tidemark.llm.queries import MIXTURE, REST_SHARE, SIZE, byte_bpe_of
from tidemark.session import scratch_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5; null and empty texts have the score of the bias alone, without labels nothing is rejected."""
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines of three-line windows that occur earlier; null texts stay null, repeated rows are cut alike."""
    return linededup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, and one of each doc_id; rows without words or with a null id stay."""
    return minmax.one_of_each(docs, percent=75)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by their cell's probability; null and unlisted sources and languages have a stated least share, rows without
    tokens stay where their cell has none."""
    return mixing.sample_mixture(docs, MIXTURE, size=SIZE, rest=REST_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    return bpe.digests(byte_bpe_of(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("minmax_near", drop_near_duplicates),
    ("mixture", sample_mixture),
    ("byte_bpe", encode),
]

#: A trained model, signatures and a tokenizer take part: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
