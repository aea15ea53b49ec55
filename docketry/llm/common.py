"""Helpers shared by the operators: reading columns, working folders, groups within sorted batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import work_dir


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and whole text only, so that no other column of the input can clash; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stored(table: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs start from the files, whichever executor is lost."""
    spark = table.sparkSession
    path = work_dir(spark, purpose)
    table.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


#: Bytes of text that are handled at once; a longer text is handled by itself.
RUN_BYTES = 2_500_000


def releasing(run):
    """A function over Arrow batches that gives the memory it no longer needs back when its task ends.

    Workers live on for the tasks of later stages, and what Arrow keeps for reuse would be missing there.
    """
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return whole


def run_borders(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a column of texts into runs of whole texts of about ``run_bytes``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > run_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if len(sizes):
        yield start, len(sizes)


def text_runs(batches: Iterator[pa.RecordBatch], run_bytes: int = RUN_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of bounded size from Arrow batches with the columns doc_id and text."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for start, end in run_borders(texts, run_bytes):
            yield ids[start:end].to_pylist(), texts[start:end].to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never split a group, from batches whose rows are sorted by the integer column ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def file_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out
