"""The registered queries of this package and their DuckDB SQL.

Each query applies its operator with production parameters to the whole of its
tables and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load
from . import (bpe, chat, crf, decontam, divergence, linededup, packing, qda, simhash, suffix, tokens, toxicity,
               whitening)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(load(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(load(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(load(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return crf.quality_rules(docs, crf.train(docs, load(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.substring_dedup(load(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.event_log(messages.unionByName(chat.probe_conversation(spark)))
    return chat.digest(chat.format_chats(log))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decode(bpe.encode(load(spark, sf_dir, "documents"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(load(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(load(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_bpe": op11_bpe,
    "op12_source_divergence": op12_source_divergence,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op1_decontamination": decontam.ORACLE_SQL,
    "op4_line_dedup": linededup.ORACLE_SQL,
    "op9_chat_format": chat.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
}
