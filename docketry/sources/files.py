"""File sources and sinks: JSON documents, label lines, text of unknown charset, index and stage tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import safe_stem

SCAN_PARTITIONS = "spark.docketry.scan.partitions"
CORRUPT = "_corrupt_record"


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows of a scan out before texts are parsed, if the session asks for it.

    A table written as one file with one row group is one split and leaves all other cores idle. Only whoever runs
    such a table sets ``spark.docketry.scan.partitions`` (bench.py does); unset, as on a cluster, no exchange is added.
    """
    parts = table.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return table.repartition(int(parts)) if parts else table


def scan_json_docs(spark: SparkSession, path: str, schema: str, glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """JSON documents below a prefix, without the ``.metadata.json`` companions.

    Unreadable documents stay, with ``unreadable`` = 1 and their raw text, so they can be counted
    and put aside. The name filter prunes files before they are opened.
    """
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line) \
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    docs = reader.json(path)
    return docs.filter(~F.col("_metadata.file_name").endswith(".metadata.json")) \
        .withColumn("file_path", F.col("_metadata.file_path")).withColumn("unreadable", F.col(CORRUPT).isNotNull().cast("int"))


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable documents and the unreadable rest, the latter with all columns (Spark refuses to read the raw text alone)."""
    good = docs.filter(F.col("unreadable") == 0).drop(CORRUPT, "unreadable")
    return good, docs.filter(F.col("unreadable") == 1).drop("unreadable")


def scan_jsonl_labels(spark: SparkSession, path: str, key: str, verdict: str, accepted: str, ground: str) -> DataFrame:
    """Truth lines as key, binary label and ground; blank lines are no records."""
    lines = spark.read.schema(f"`{key}` string, `{verdict}` string, `{ground}` string").json(path)
    return lines.select(F.col(key).alias("case_id"), F.when(F.col(verdict) == accepted, 1).otherwise(0).alias("label"),
                        F.col(ground).alias("ground"))


def scan_binary(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true") \
        .load(path).select("path", "content")


def _legacy_decoder():
    """Arrow UDF for what is not UTF-8. Built on use: declaring it needs a session; a closure travels by value."""
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(raw: bytes | None) -> tuple[str | None, str | None]:
            if raw is None:
                return None, None
            for charset in ("big5", "cp950"):
                try:
                    return raw.decode(charset), charset
                except UnicodeDecodeError:
                    continue
            return raw.decode("utf-8", errors="ignore"), "utf-8 (lossy)"

        for batch in batches:
            yield pd.DataFrame([one(raw) for raw in batch], columns=["text", "charset"])

    return F.pandas_udf(decode, "struct<text:string,charset:string>")


def decode_texts(files: DataFrame) -> DataFrame:
    """Text and charset of binary contents: UTF-8 on the JVM side, only the rest goes through Arrow."""
    as_text = F.col("content").cast("string")
    rest = [c for c in files.columns if c != "content"]
    # two branches over the same scan, so that rows which are UTF-8 never leave the JVM
    valid = F.coalesce(F.is_valid_utf8(as_text), F.lit(True))
    plain = files.filter(valid).select(*rest, as_text.alias("text"), F.when(as_text.isNotNull(), "utf-8").alias("charset"))
    legacy = files.filter(~valid).withColumn("legacy", _legacy_decoder()(F.col("content")))
    return plain.unionByName(legacy.select(*rest, "legacy.text", "legacy.charset"))


def encoding_audit(files: DataFrame) -> DataFrame:
    return decode_texts(files).groupBy("charset").agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


def index_docs(docs: DataFrame) -> DataFrame:
    """One document per route, kind and safe stem: the last one wins, ``n_copies`` reports the others.

    ``docs``: route, kind, stem, seq, text, metadata. Partial aggregation, so a stem that very many
    documents share does not gather in one task.
    """
    named = docs.withColumn("stem", safe_stem(F.col("stem")))
    return named.groupBy("route", "kind", "stem").agg(
        F.count("*").alias("n_copies"), F.max_by(F.struct("seq", "text", "metadata"), "seq").alias("doc"),
    ).select("route", "kind", "stem", "n_copies", "doc.seq", "doc.text", "doc.metadata")


def write_index_docs(docs: DataFrame, path: str) -> None:
    index_docs(docs).write.mode("overwrite").partitionBy("route", "kind").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


STAGES = ["input", "fields", "analysis", "findings", "draft", "verify", "result"]


def replace_partitions(table: DataFrame, path: str, partition: str) -> None:
    """Only the partitions that the rows bring are replaced, so a rerun leaves the same rows."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_stage(table: DataFrame, root: str, stage: str, partition: str) -> None:
    """One parquet folder per stage."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    replace_partitions(table, f"{root}/{stage}", partition)


def read_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stage}")
