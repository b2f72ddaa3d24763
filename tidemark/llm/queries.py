"""Registered queries of the training-data operators and their DuckDB SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bitslice, bpe, covertree, linededup, minmax, mixing, quality, rules, runs, suffix, tokenbin, toxicity, trie
from tidemark.llm.common import read_table


def byte_bpe_of(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(byte_bpe_of(read_table(spark, sf_dir, "documents")))


#: Shares of the tokens.  src0 may hold a third of all documents; it gets a tenth.  English gives way to the other languages,
#: lists to articles and long texts.
MIXTURE = {
    "source": {"src0": 0.10, **{f"src{i}": 0.0473 for i in range(1, 20)}},
    "lang": {"en": 0.40, "de": 0.20, "fr": 0.20, "es": 0.18},
    "topic": {"note": 0.04, "article": 0.45, "longform": 0.06, "listing": 0.45},
}
#: The part of the tokens that the mixture keeps, whatever cells are scarce.
SIZE = 0.4
#: The least share of sources, languages and topics that the targets do not name, nulls among them.
REST_SHARE = 0.01


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_probability(read_table(spark, sf_dir, "documents"), MIXTURE, SIZE, REST_SHARE).select(
        "doc_id", "row.source", "row.lang", "topic", "n_tokens", "probability", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept_text", F.lit("")).cast("binary")).alias("kept_md5"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(read_table(spark, sf_dir, "documents"), length=100))


def op6_minmax_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read_table(spark, sf_dir, "documents"), percent=75)


def op7_covertree_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(read_table(spark, sf_dir, "embeddings"), least=0.93)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.rewritten(read_table(spark, sf_dir, "documents")), least=24, times=3))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(*trie.rebuilt_trie(read_table(spark, sf_dir, "conversations")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read_table(spark, sf_dir, "documents")).drop("lang", "source")


QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_shards": op4_token_shards,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op6_minmax_near": op6_minmax_near,
    "op7_covertree_near": op7_covertree_near,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_bitslice_topk": op10_bitslice_topk,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {
    "op1_mixture": mixing.mixture_sql(MIXTURE, SIZE, REST_SHARE),
    "op3_line_dedup": linededup.LINE_DEDUP_SQL,
    "op13_quality_rules": rules.QUALITY_RULES_SQL,
}
