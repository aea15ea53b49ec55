"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only lengths decide a packing and there are at most ``capacity`` of them, so the plan is made from the
histogram of lengths: a pattern (so many pieces of each length) together with how often it is used. Every
piece then finds its sequence and place from its rank among the pieces of its length. The plan has at most
sum(capacity / length) + capacity steps (about 8,200 for 1,024) however many documents there are, since each
step leaves some length with fewer pieces than the step used of it.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows are packed each;
a longer document is cut into pieces of ``capacity`` of which the first may be shorter; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import encode
from docketry.llm.common import releasing, stored, text_runs, texts_of

#: Length and rank share one sort key: up to 2**44 pieces of a length, capacities below 2**19.
RANK_BITS = 44

PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long"


def _cutter(name: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encode.encoder(name), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this part
        for keys, texts in text_runs(batches):
            ids, lengths = coder.encode(texts)
            rows, at = [], 0
            for key, n in zip(keys, lengths.tolist(), strict=True):
                whole = np.append(ids[at:at + n], np.uint32(end_id))
                at += n
                start, size, piece = 0, len(whole) % capacity or capacity, 0
                while start < len(whole):
                    body = whole[start:start + size].astype("<u4").tobytes()
                    rows.append((key, piece, start, size, body, zlib.crc32(body), part, int(seen[size])))
                    seen[size] += 1
                    start, size, piece = start + size, capacity, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)],
                                             [x.split()[0] for x in PIECES.split(", ")])
    return cut


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(pattern, times) steps. A pattern lists (length, pieces of it) from the longest."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    sizes = np.arange(capacity + 1)
    steps = []
    while left.any():
        used: dict[int, int] = {}
        gap = capacity
        fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest length at hand up to each size
        while gap and (length := int(fits[gap])):
            take = min(int(left[length]), gap // length)
            used[length] = take
            gap -= take * length
            if take == left[length]:
                gone = left.copy()
                gone[list(used)] -= list(used.values())
                fits = np.maximum.accumulate(np.where(gone > 0, sizes, 0))
        if gap and used:
            _two_for_one(left, used, gap, sizes)
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        steps.append((sorted(used.items(), reverse=True), times))
    return steps


def _two_for_one(left: np.ndarray, used: dict[int, int], gap: int, sizes: np.ndarray) -> None:
    """Swap the smallest piece of a bin for the two unpacked pieces that fill its expanded gap best, if they fill more."""
    smallest = min(used)
    room = gap + smallest
    free = left.copy()
    free[list(used)] -= list(used.values())
    fits = np.maximum.accumulate(np.where(free > 0, sizes, 0))
    first = np.flatnonzero(free[:room] > 0)
    if not len(first):
        return
    second = fits[room - first]
    again = (second == first) & (free[first] < 2)  # the only piece of its length cannot be taken twice
    second = np.where(again, fits[np.maximum(first - 1, 0)], second)
    filled = np.where(second > 0, first + second, 0)
    best = int(filled.argmax())
    if filled[best] <= smallest:
        return
    used[smallest] -= 1
    if not used[smallest]:
        del used[smallest]
    for length in (int(first[best]), int(second[best])):
        used[length] = used.get(length, 0) + 1


def _places(steps: list) -> dict[str, np.ndarray]:
    """For each length, ordered: first rank, pieces in a sequence, first sequence, offset of the first of them."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in steps:
        offset = 0
        for length, n in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, n, sequence, offset))
            taken[length] = rank + n * times
            offset += n * length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "n", "sequence", "offset"), table.T, strict=True))


def _placer(places: dict[str, np.ndarray], names: list[str]):
    order = (places["length"] << RANK_BITS) | places["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(order, (length << RANK_BITS) | rank, side="right") - 1
            within = rank - places["rank"][at]
            sequence = places["sequence"][at] + within // places["n"][at]
            offset = places["offset"][at] + within % places["n"][at] * length
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
    return place


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id, offset of every piece.

    ``with_ids=False`` leaves the ids column out, so that it is not read again.
    """
    pieces = stored(texts_of(docs).mapInArrow(releasing(_cutter(name, end_id, capacity)), PIECES), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # rank among all pieces of a length = pieces of it in earlier parts + those earlier in the part
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(per_part.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-ranks")
    histogram = {row["length"]: row["n"] for row in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_packing(histogram, capacity))
    names = ["doc_id", "piece", "start", "length", *["ids"] * with_ids, "ids_crc32"]
    ranked = pieces.join(bases.drop("n"), ["length", "part"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    kinds = {x.split()[0]: x for x in PIECES.split(", ")}
    return ranked.mapInArrow(releasing(_placer(places, names)), ", ".join([*(kinds[x] for x in names), "sequence_id long", "offset long"]))
