"""The corpus pipeline: quality rules, line dedup, near-duplicates,
decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet in the shared folder and reads it back for the next one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base, crf, decontam, linededup, packing, simhash
from quarry.sources.tables import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are.  A null or empty text has no
    words and goes; the field is trained on the labelled ones among ``docs``."""
    field = crf.train(docs, load(spark, sf_dir, "labels"))
    return crf.keep_quality(docs, field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that ten or more hold; n_chars follows the
    new text.  A document may be left empty; a null text becomes empty."""
    out = linededup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the least doc_id;
    texts without words are one group like any other."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, as they are."""
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its bin."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

# SQL cannot state the trained field of the first stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row for each packed piece."""
    def step(docs: DataFrame, stage) -> DataFrame:
        name, apply = stage
        return base.stored(apply(spark, docs, sf_dir), f"stage-{name}")

    return functools.reduce(step, STAGES, load(spark, sf_dir, "documents"))
