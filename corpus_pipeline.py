"""Cleaning and packing of the table ``documents``: language, near duplicates, benchmark passages, personal data, sequences.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; what it returns is written as Parquet to the shared folder
and read back as the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import stages
from docketry.llm.common import documents, stored

STAGES = [
    ("language_id", stages.identify_language),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.decontaminate),
    ("personal_data", stages.mask_personal_data),
    ("packing", stages.pack_sequences),
]

#: Models, fingerprints and token ids cannot be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
