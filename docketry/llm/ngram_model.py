"""Cross-entropy difference of documents under two matched bigram models.

Both models count tokens of one public vocabulary, with the same smoothing (interpolation with the unigram model by the
number of different continuations, add-one below). The score of a document is the mean, over its tokens, of the loss under
the target model minus the loss under the background model: the lower, the nearer to the target.

Texts are encoded once and stored as shards of token ids. A shard sends its distinct bigrams with their counts, cut into ranges of
a hash, and a range adds up what all shards sent and answers each with the counts over the whole corpus; so bigrams are combined
before they move, no bigram is hot, and a task holds one range or one shard. The number of ranges follows the
number of tokens. Only tables of one number for each id of the vocabulary (proven bound) are collected and broadcast.

Defined results: a document without tokens has score 0 and belongs nowhere; a null text is empty; with an empty target the target
model is the smoothed uniform one; repeated rows count and have a line each; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import encode
from docketry.llm.common import releasing, stored, text_runs, texts_of, whole_groups

SHARD_TOKENS = 2_000_000
#: Distinct bigrams of shards that meet in one range, about.
RANGE_BIGRAMS = 1_500_000

SHARDS = "shard long, target boolean, n_tokens long, doc_ids array<long>, doc_lengths array<long>, ids binary"
BLOCKS = "range long, shard long, target boolean, keys binary, counts binary"
_MIX = np.uint32(0x9E3779B1)


def _sharder(name: str, target: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encode.encoder(name), TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            # targets and background have shards of their own
            row = [(2 * part + target << 24) + number], [target], [held], [keys], [np.concatenate(lengths)], [np.concatenate(ids).astype("<u2").tobytes()]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in SHARDS.split(", ")])

        for some, texts in text_runs(batches):
            found, n = coder.encode(texts)
            keys += some
            lengths.append(n)
            ids.append(found)
            held += len(found)
            if held >= SHARD_TOKENS:
                yield flush()
                keys, lengths, ids, held, number = [], [], [], 0, number + 1
        if keys:
            yield flush()
    return run


def bigram_keys(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Previous and own id of every token in one number; ``start`` stands before the first token of a document."""
    before = np.empty(len(ids), np.uint32)
    before[1:] = ids[:-1]
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[first] = start
    return (before << np.uint32(16)) | ids.astype(np.uint32)


def _shard_arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<u2"), np.array(row["doc_lengths"], np.int64)


def _ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint32(8)).astype(np.int64) % ranges


def _sorted_distinct(ids: np.ndarray, lengths: np.ndarray, start: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams of a shard by range and key, their counts, and where each range begins."""
    keys, counts = np.unique(bigram_keys(ids, lengths, start), return_counts=True)
    place = _ranges_of(keys, ranges)
    order = np.argsort(place, kind="stable")
    return keys[order], counts[order], np.searchsorted(place[order], np.arange(ranges + 1))


def _sender(start: int, ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, counts, borders = _sorted_distinct(*_shard_arrays(row), start, ranges)
                used = np.flatnonzero(np.diff(borders))
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int64()), pa.array(np.full(len(used), row["shard"])), pa.array(np.full(len(used), row["target"])),
                    pa.array([keys[borders[i]:borders[i + 1]].astype("<u4").tobytes() for i in used], pa.binary()),
                    pa.array([counts[borders[i]:borders[i + 1]].astype("<u4").tobytes() for i in used], pa.binary())],
                    ["range", "shard", "target", "keys", "counts"])
    return send


def packed(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one of them needs more."""
    return counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    """``n`` counts, in as many bytes each as the data has."""
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u4").astype(np.uint64)


def sums_of_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of values, added up within the run, so that no other run has a part in its last digits."""
    total = np.zeros(len(lengths))
    filled = np.flatnonzero(lengths)
    if len(filled):
        total[filled] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[filled])
    return total


ANSWERS = "range long, shard long, target_counts binary, counts binary, context binary"
STATISTICS = ["target_word", "word", "target_context", "context", "target_kinds", "kinds"]


def _adder(size: int):
    """Adds up the bigrams of a range and answers every shard; a row without shard carries the sums for single ids."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(STATISTICS), size), np.int64)
        for table in whole_groups(batches, "range"):
            numbers = table.column("range").to_numpy()
            for group in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                rows = table.slice(int(group[0]), len(group)).to_pylist()
                keys = [np.frombuffer(row["keys"], "<u4") for row in rows]
                counts = [np.frombuffer(row["counts"], "<u4") for row in rows]
                all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
                is_target = np.repeat([row["target"] for row in rows], [len(x) for x in keys])
                total = np.concatenate(counts).astype(np.float64)
                own = [np.bincount(place, total * chosen, len(all_keys)).astype(np.int64) for chosen in (is_target, ~is_target)]
                before, word = (all_keys >> np.uint32(16)).astype(np.int64), (all_keys & np.uint32(0xFFFF)).astype(np.int64)
                for i, count in enumerate(own):
                    sums[i] += np.bincount(word, count, size).astype(np.int64)
                    sums[2 + i] += np.bincount(before, count, size).astype(np.int64)
                    sums[4 + i] += np.bincount(before, count > 0, size).astype(np.int64)
                asked = [i for i, row in enumerate(rows) if not row["target"]]
                ends = np.cumsum([len(x) for x in keys])
                parts = [place[ends[i] - len(keys[i]):ends[i]] for i in asked]
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[i]["range"] for i in asked], pa.int64()), pa.array([rows[i]["shard"] for i in asked], pa.int64()),
                    pa.array([packed(own[0][x]) for x in parts], pa.binary()),
                    pa.array([packed(own[1][x]) for x in parts], pa.binary()), pa.nulls(len(asked), pa.binary())],
                    ["range", "shard", "target_counts", "counts", "context"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()),
                                          pa.array([sums.astype("<i8").tobytes()], pa.binary())], ["range", "shard", "target_counts", "counts", "context"])
    return add


def _totals(size: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(STATISTICS), size), np.int64)
        for batch in batches:
            for data in batch.column("context").to_pylist():
                sums += np.frombuffer(data, "<i8").reshape(sums.shape)
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *(pa.array(x[seen]) for x in sums)], ["id", *STATISTICS])
    return add


class Smoothing:
    """What both models need besides the counts of a bigram: one number for each id."""

    def __init__(self, sums: np.ndarray):
        size = sums.shape[1]
        words = sums[0:2].astype(np.float64)
        # the marker before a document is no word, but one place is kept for words never seen
        self.word = np.log((words + 1) / (words.sum(axis=1, keepdims=True) + size))
        self.context, self.kinds = sums[2:4].astype(np.float64), sums[4:6].astype(np.float64)

    def losses(self, keys: np.ndarray, counts: np.ndarray, model: int) -> np.ndarray:
        """Negative log probability of each bigram; with an unknown context the unigram decides."""
        before, word = (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64)
        kinds, context = self.kinds[model][before], self.context[model][before]
        lower = np.exp(self.word[model][word])
        return -np.log(np.where(context > 0, (counts + kinds * lower) / np.maximum(context + kinds, 1), lower))


def _scorer(shared, start: int, ranges: int):
    """Rows of a shard come sorted by range: first (-1) its ids, then the answers of the ranges."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smoothing = shared.value
        for table in whole_groups(batches, "shard"):
            shard = table.column("shard").to_numpy()
            for group in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                rows = table.slice(int(group[0]), len(group)).to_pylist()
                ids, lengths = _shard_arrays(rows[0])
                keys, _, borders = _sorted_distinct(ids, lengths, start, ranges)
                sizes = np.diff(borders)
                counts = [np.concatenate([np.zeros(0, np.uint64), *(unpacked(row[name], sizes[row["range"]]) for row in rows[1:])]) for name in ("target_counts", "counts")]
                difference = smoothing.losses(keys, counts[0], 0) - smoothing.losses(keys, counts[1], 1)
                order = np.argsort(keys)
                each = difference[order][np.searchsorted(keys[order], bigram_keys(ids, lengths, start))]
                score = sums_of_runs(each, lengths) / np.maximum(lengths, 1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]["doc_ids"], pa.int64()), pa.array(lengths), pa.array(score)], ["doc_id", "n_tokens", "score"])
    return score


def score(docs: DataFrame, target: DataFrame, name: str = "byte_bpe_50k.json", size: int = 50_257) -> DataFrame:
    """doc_id, n_tokens and cross-entropy difference (nats a token) of every row of ``docs``, which is the background.

    ``target`` has texts in the columns doc_id and text; ``size`` is the number of ids of the vocabulary, below 65,535.
    """
    spark: SparkSession = docs.sparkSession
    start, width = size, size + 1
    shards = stored(texts_of(docs).mapInArrow(releasing(_sharder(name, False)), SHARDS).union(texts_of(target).mapInArrow(releasing(_sharder(name, True)), SHARDS)), "shards")
    total = shards.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    ranges = max(16, ceil(total / RANGE_BIGRAMS))
    blocks = shards.mapInArrow(releasing(_sender(start, ranges)), BLOCKS)
    answers = stored(blocks.repartition("range").sortWithinPartitions("range").mapInArrow(releasing(_adder(width)), ANSWERS), "bigram-counts")
    sums = np.zeros((len(STATISTICS), width), np.int64)
    per_id = answers.filter("range = -1").select("context").mapInArrow(releasing(_totals(width)), ", ".join(f"{x} long" for x in ["id", *STATISTICS]))
    for row in per_id.groupBy("id").agg(*[F.sum(x).alias(x) for x in STATISTICS]).collect():  # one row for each id of the vocabulary
        sums[:, row["id"]] = [row[x] for x in STATISTICS]
    shared = spark.sparkContext.broadcast(Smoothing(sums))
    empty = F.lit(None).cast("binary")
    own = shards.filter("not target").select("shard", F.lit(-1).cast("long").alias("range"), "doc_ids", "doc_lengths", "ids", empty.alias("target_counts"), empty.alias("counts"))
    heard = answers.filter("range >= 0").select(
        "shard", "range", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<long>").alias("doc_lengths"), empty.alias("ids"), "target_counts", "counts")
    return own.union(heard).repartition("shard").sortWithinPartitions("shard", "range") \
        .mapInArrow(releasing(_scorer(shared, start, ranges)), "doc_id long, n_tokens long, score double")
