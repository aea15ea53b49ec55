"""Importance resampling towards a target distribution, by bit-sliced aggregation.

Runs of one to ``longest`` words are hashed into buckets. The gain of a bucket is the log ratio of its share in the target to its share
in the source, floored to an integer. A document's counts are turned into bit planes over the buckets, the gains are planes of two's
complement; the population counts of ANDed planes, times the power of two of both planes, add up to the exact sum of gains. Gumbel noise
from a digest of the key makes the highest scores a weighted sample without replacement.

A source table is read twice, once for the counts of all its buckets (one row per bucket and task moves) and once for the weights.
The ranks come from a range sort over score, key and the row's place in the stored table, which no key or score can make uneven, and
the number of rows before each part.

Defined results: a null text has no words; a document without words has no features and weight 0; repeated rows have a line each and are
drawn each for themselves, the order between them is that of the stored table; a null key has the noise of the empty string after the
seed and comes last among equal scores; an empty target or source gives gains from the smoothing alone; an empty table an empty result.
Whole texts are read, however long, and no other column but the key and the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import releasing, stored, text_runs, texts_of

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Longest word, in bytes, whose checksum is joined by table.
_TABLED = 64
#: Documents whose planes are held at once.
_AT_ONCE = 128


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def _byte_table() -> np.ndarray:
    """State of the checksum after one zero byte, for each low byte (reflected polynomial of CRC-32)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


class Checksums:
    """CRC-32 of joined strings from those of their parts: the first part's, shifted by the second's length, XOR the second's."""

    def __init__(self):
        table = _byte_table()
        # shifted[n][k][b]: what byte k of a checksum, of value b, becomes behind n more bytes
        identity = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        self.shifted = np.empty((_TABLED + 1, 4, 256), np.uint32)
        self.shifted[0] = identity
        for n in range(1, _TABLED + 1):
            last = self.shifted[n - 1]
            self.shifted[n] = (last >> np.uint32(8)) ^ table[last & np.uint32(0xFF)]

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Checksums of first + second; ``length``: bytes of the second, at most ``_TABLED``."""
        out = second.copy()
        for k in range(4):
            out ^= self.shifted[length, k, (first >> np.uint32(8 * k)) & np.uint32(0xFF)]
        return out


class Features:
    """Buckets of all runs of one to ``longest`` words of some texts; ``count`` also tells how many words and runs each has."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.checksums = buckets, longest, Checksums()

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket) of every run as arrays, and the number of words of each text."""
        found = [words_of(text) for text in texts]
        n_words = np.fromiter(map(len, found), np.int64, len(found))
        place: dict[str, int] = {}
        codes = np.fromiter((place.setdefault(word, len(place)) for words in found for word in words), np.int64, int(n_words.sum()))
        encoded = [word.encode("utf-8", "surrogatepass") for word in place]
        begins = np.cumsum(n_words) - n_words
        own = np.fromiter(map(zlib.crc32, encoded), np.uint32, len(encoded))
        spaced = np.fromiter((zlib.crc32(b" " + word) for word in encoded), np.uint32, len(encoded))
        length = np.fromiter(map(len, encoded), np.int64, len(encoded))
        text = np.repeat(np.arange(len(found)), n_words)
        last, at = own[codes], np.arange(len(codes))
        owners, sums = [text], [last]
        for more in range(1, self.longest):
            at = at[:len(at) - 1]
            at = at[text[at] == text[at + more]] if len(at) else at
            follower = codes[at + more]
            state = np.zeros(len(codes), np.uint32)
            state[at] = self.checksums.joined(last[at], spaced[follower], np.minimum(length[follower] + 1, _TABLED))
            for i in np.flatnonzero(length[follower] >= _TABLED).tolist():
                first = at[i] - begins[text[at[i]]]
                state[at[i]] = zlib.crc32(" ".join(found[text[at[i]]][first:first + more + 1]).encode("utf-8", "surrogatepass"))
            last = state
            owners.append(text[at])
            sums.append(state[at])
        return np.concatenate(owners), (np.concatenate(sums) % np.uint32(self.buckets)).astype(np.int64), n_words


def _bucket_counter(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for _, texts in text_runs(batches):
            total += np.bincount(features.count(texts)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])
    return run


def bucket_counts(docs: DataFrame, buckets: int = 10_000, longest: int = 2) -> np.ndarray:
    """Number of features in each bucket, over all rows; as many numbers as buckets reach the driver."""
    counted = texts_of(docs).mapInArrow(releasing(_bucket_counter(buckets, longest)), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (all_source + n) / ((source + 1.0) * (all_target + n)))).astype(np.int64)


def bit_plane(values: np.ndarray, k: int) -> np.ndarray:
    """Bit ``k`` of the numbers of each row, 64 to a word; rows are as long as a multiple of 64."""
    return np.packbits((values >> k & 1).astype(np.uint8), axis=-1, bitorder="little").view(np.uint64)


class Gains:
    """Signed gains as bit planes; the last plane of two's complement counts negative."""

    def __init__(self, gains: np.ndarray):
        self.width = -(-len(gains) // 64) * 64
        padded = np.zeros(self.width, np.int64)
        padded[:len(gains)] = gains
        n = int(np.abs(padded).max()).bit_length() + 1
        self.planes = [(-(1 << k) if k == n - 1 else 1 << k, bit_plane(padded, k)) for k in range(n)]

    def weighted(self, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Sum over the features of each of ``n`` documents of their buckets' gains."""
        counts = np.bincount(owner * self.width + bucket, minlength=n * self.width).astype(np.int32).reshape(n, self.width)
        highest, total = counts.max(axis=1), np.zeros(n, np.int64)
        for j in range(int(highest.max(initial=0)).bit_length()):
            rows = np.flatnonzero(highest >> j)  # documents that reach this plane
            plane = bit_plane(counts[rows], j)
            for worth, gain in self.planes:
                total[rows] += (worth << j) * np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
        return total


def _weigher(gains: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, part, number = len(gains), TaskContext.get().partitionId(), 0
        features, sliced = Features(buckets, longest), Gains(gains)
        for ids, texts in text_runs(batches):
            owner, bucket, n_words = features.count(texts)
            n_features = np.bincount(owner, minlength=len(texts))
            order = np.argsort(owner, kind="stable")
            owner, bucket = owner[order], bucket[order]
            borders = np.searchsorted(owner, [*range(0, len(texts), _AT_ONCE), len(texts)])
            sums = [sliced.weighted(owner[a:b] - start, bucket[a:b], min(_AT_ONCE, len(texts) - start))
                    for start, a, b in zip(range(0, len(texts), _AT_ONCE), borders, borders[1:], strict=False)]
            weight = np.concatenate(sums) // np.maximum(n_features, 1)
            places = (part << 40) + number + np.arange(len(texts))
            number += len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, places))],
                ["doc_id", "n_words", "n_features", "weight", "place"])
    return run


def _numberer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part a row lies in and its number there, in the order of the rows."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(number + 1, number + n + 1))],
                                         [*batch.schema.names, "part", "inside"])
        number += n


def ranked(table: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The table with the place of each row (from 1) in the order of these columns, sorted in parts that Spark chooses by sampling."""
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in table.schema)
    sorted_parts = table.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(sorted_parts.mapInArrow(_numberer, f"{columns}, part long, inside long"), "ranks")
    before, total = [(-1, 0)], 0
    for part, n in sorted((row["part"], row["n"]) for row in numbered.groupBy("part").agg(F.max("inside").alias("n")).collect()):
        before.append((part, total))
        total += n
    # a row for each shuffle partition, so its size is bounded
    starts = F.broadcast(table.sparkSession.createDataFrame(before, "part long, before long"))
    return numbered.join(starts, "part").withColumn(name, F.col("inside") + F.col("before")).drop("part", "inside", "before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) with the highest scores are drawn,
    ties to the smaller key.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    weighed = texts_of(docs).mapInArrow(releasing(_weigher(gains, longest)), "doc_id long, n_words long, n_features long, weight long, place long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    able = F.col("n_words") >= least_words
    scored = stored(weighed.withColumn("score", F.col("weight") + noise).withColumn("able", able), "scores")
    drawn = scored.filter("able").count() * percent // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place").asc()]
    kept = F.when(F.col("able") & (F.col("place_in_order") <= drawn), F.col("place_in_order"))
    return ranked(scored, order, "place_in_order").select("doc_id", "n_features", "weight", "score", kept.alias("rank"))
