"""The stages of the corpus pipeline, each one of the operators applied to all that the stage before has kept.

Rows keep all their columns. A null text has no letters and goes with the first stage, as does a text without letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import decontamination, language_id, packing, personal_data, simhash

#: A document stays if its best language has at least this calibrated score.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without letters, or in no language that was learned, go."""
    return language_id.keep_identified(docs, LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group stays, the one with the least key."""
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Contaminated documents go; from the others the removal spans are cut."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.clean(docs, items)


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return personal_data.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their ids, sequence and place."""
    return packing.pack(docs)
