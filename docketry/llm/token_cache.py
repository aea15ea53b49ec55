"""Token counts behind a cache of digests.

A content is known by the SHA-256 of its normalised form together with a digest of the tokenizer's file, so a
count is encoded once and read ever after, and a new tokenizer never meets counts of an old one.

Defined results: a null text is empty and has no tokens; repeated rows and copies get the same count from one
encoding; any row keeps its own line in the result; an empty table gives an empty result; columns other than
the key and the text are not read. Whole texts are encoded, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import encode
from docketry.llm.common import file_digest, releasing, run_borders, stored, texts_of

CACHE = "version string, digest binary, n_tokens long"


def version_of(name: str) -> str:
    """Digest of the vocabulary file and of the way contents are normalised."""
    return f"{file_digest(encode.vocabulary_path(name))}:{'blanks' if name == 'word_bpe_49k.json' else 'exact'}"


def content_digest(text: Column, name: str) -> Column:
    """Digest of what decides the count: a vocabulary that drops white space does not see how much there is."""
    seen = F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ")) if name == "word_bpe_49k.json" else text
    return F.unhex(F.sha2(seen, 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; a folder that is not there yet is an empty cache."""
    try:
        cache = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE)
    return cache.filter(F.col("version") == version).drop("version")


def _counter(name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encode.encoder(name)
        for batch in batches:
            texts = batch.column("text")
            counts = [coder.count(texts[start:end].to_pylist()) for start, end in run_borders(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.concat_arrays([pa.array(x, pa.int64()) for x in counts]) if counts else pa.array([], pa.int64())],
                ["digest", "n_tokens"])
    return count


def count_tokens(docs: DataFrame, name: str, cache: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; distinct contents missing in ``cache`` are encoded and appended to it.

    Keys and digests are aggregated before any text moves, so a content that a third of the rows share is
    encoded once, and only texts of one row per missing content are encoded.
    """
    spark = docs.sparkSession
    version = version_of(name)
    read = texts_of(docs).withColumn("digest", content_digest(F.col("text"), name))
    keyed = stored(read.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    # one row per content that the cache does not hold
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(read_cache(spark, cache, version), "digest", "left_anti")
    texts = read.join(missing.withColumnRenamed("digest", "key"),
                      (F.col("digest") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("digest", "text")
    encoded = texts.mapInArrow(releasing(_counter(name)), "digest binary, n_tokens long")
    encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")) \
        .select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # stored, so that the join has plain sides and a digest that very many rows share can be split
    counts = stored(read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
