"""Exact top-k search by inner product with a pivot-distance index.

Integer vectors get one more coordinate, sqrt(M2 - |v|2) with M2 the largest square norm (0 for a query), which turns the
largest inner product into the least distance. Every vector is keyed by its nearest pivot and its distance to it; in key order
the vectors are cut into blocks, each an annulus around its pivot, and the blocks are written as the index. A query block first
visits the annulus nearest to its own key, which gives each query k scores to beat. The least of them bounds, by the triangle
inequality, the interval of distances around every pivot that can hold a better vector: only annuli that meet these intervals
are visited, all others are stopped at. The bounds have slack for rounding, so the result is exact.

The pivots are centres of a sample of at most ``SAMPLE`` vectors (the smallest hashes of the ids); their number grows with the root of
the number of vectors up to ``MAX_PIVOTS``, which bounds what travels to the tasks. Every vector is indexed.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without id; of rows with the
same id the one with the least vector counts; vectors of other length than the query's are no candidates for it; an empty table gives
an empty result. Components beyond the range of a long, and scores beyond it, become the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import releasing, stored

SAMPLE = 4096
MAX_PIVOTS = 1024
BLOCK_ROWS = 2048
QUERY_ROWS = 256
ROUNDS = 4
SLACK = 1e-6

BLOCKS = "block string, dim int, cell int, low double, high double, ids binary, rows binary, width int"


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the vector with components floor(scale * x), one row for each id."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable) \
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v")) \
        .groupBy("vec_id").agg(F.min("v").alias("v"))


class Pivots:
    """Centres in the space with the added coordinate, for each length of vectors."""

    def __init__(self, sample: list[list[int]], largest: dict[int, float], count: int):
        self.largest = largest
        self.centres: dict[int, np.ndarray] = {}
        for dim in largest:
            own = [v for v in sample if len(v) == dim]
            rows = np.array(own, np.float64).reshape(len(own), dim)
            points = self.lifted(rows, dim) if len(rows) else np.zeros((1, dim + 1))
            centres = points[:count]
            for _ in range(ROUNDS):
                nearest = _distances(points, centres).argmin(axis=1)
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, points)
                n = np.bincount(nearest, minlength=len(centres))
                centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            self.centres[dim] = centres

    def lifted(self, rows: np.ndarray, dim: int) -> np.ndarray:
        rest = np.maximum(self.largest[dim] - (rows * rows).sum(axis=1), 0)
        return np.concatenate([rows, np.sqrt(rest)[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(values: list) -> np.ndarray:
    return np.array(values, np.int64).reshape(len(values), -1)


def _keyer(shared):
    """Adds the nearest pivot, the distance to it and a compact form of the vector."""
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            ids, values = batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
            lengths = np.array([len(v) for v in values])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                rows = _matrix([values[i] for i in at])
                distance = _distances(pivots.lifted(rows.astype(np.float64), int(dim)), pivots.centres[int(dim)])
                cell = distance.argmin(axis=1)
                width = next(w for w in (2, 4, 8) if w == 8 or not rows.size or max(-int(rows.min()), int(rows.max())) < 1 << (8 * w - 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(distance[np.arange(len(at)), cell]),
                    pa.array(ids[at]), pa.array([x.tobytes() for x in rows.astype(f"<i{width}")], pa.binary()), pa.array(np.full(len(at), width, np.int32))],
                    ["dim", "cell", "distance", "vec_id", "v", "width"])
    return key


def _cutter(size: int, mark: str):
    """Cuts rows in key order into blocks of one cell and width."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            row = [[f"{mark}{part}-{number}"], [held[0]["dim"]], [held[0]["cell"]], [min(x["distance"] for x in held)], [max(x["distance"] for x in held)],
                   [np.array([x["vec_id"] for x in held], "<i8").tobytes()], [b"".join(x["v"] for x in held)], [held[0]["width"]]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= size or any(row[x] != held[0][x] for x in ("dim", "cell", "width"))):
                    yield flush()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield flush()
    return cut


def build_index(vectors: DataFrame, size: int = BLOCK_ROWS, mark: str = "b") -> DataFrame:
    """Blocks of vectors in the order of (length, cell, distance); the id splits what is equal otherwise."""
    key = ["dim", "cell", "width", "distance", "vec_id"]
    return stored(vectors.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(releasing(_cutter(size, mark)), BLOCKS), "pivot-index")


def _block(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], "<i8")
    return ids, np.frombuffer(row[f"{side}_rows"], f"<i{row[f'{side}_width']}").reshape(len(ids), -1).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by floating point where that is exact; beyond a long the nearest long."""
    most = max(1, a.shape[1]) * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0)))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object) if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _visitor(k: int, bounds_only: bool):
    """Meets a query block with an annulus: the k best of each query that reach its threshold, or only its new threshold."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, queries = _block(row, "q")
                others, rows = _block(row, "d")
                score = products(queries, rows)
                least = np.iinfo(np.int64).min
                usable = ids[:, None] != others[None, :]
                if bounds_only:
                    count = usable.sum(axis=1)
                    best = np.sort(np.where(usable, score, least), axis=1)[:, ::-1]
                    bound = np.where(count >= k, best[:, k - 1] if len(others) >= k else least, least)
                    yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]]), pa.array([bound.astype("<i8").tobytes()], pa.binary())], ["q_block", "bounds"])
                    continue
                usable &= score >= np.frombuffer(row["bounds"], "<i8")[:, None]
                found = []
                for q in np.flatnonzero(usable.any(axis=1)):
                    at = np.flatnonzero(usable[q])
                    at = at if len(at) <= k else _best(score[q], others, at, k)
                    found.append((np.full(len(at), ids[q]), others[at], score[q, at]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])
    return visit


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of the places ``at`` with the highest scores, ties to smaller ids."""
    edge = np.partition(score[at], len(at) - k)[len(at) - k]
    above = at[score[at] > edge]
    tied = at[score[at] == edge]
    return np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")][:k - len(above)]])


def _interval_maker(shared):
    """For each query block: the intervals of distance around every pivot that can hold a vector to be found."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                _, queries = _block(row, "q")
                dim = queries.shape[1]
                points = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
                bounds = np.frombuffer(row["bounds"], "<i8").astype(np.float64)
                square = (points * points).sum(axis=1) + pivots.largest[dim]
                reach = np.where(bounds <= -2.0 ** 63, np.inf, np.sqrt(np.maximum(square - 2 * bounds, 0)) + SLACK * (1 + np.sqrt(square)))
                away = _distances(points, pivots.centres[dim])
                low, high = (away - reach[:, None]).min(axis=0), (away + reach[:, None]).max(axis=0)
                n = len(low)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["q_block"]] * n), pa.array(np.full(n, dim, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)],
                    ["q_block", "dim", "cell", "from", "to"])
    return make


def _side(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(*[F.col(x).alias(f"{side}_{x}") for x in ("block", "ids", "rows", "width")])


def search(table: DataFrame, asked: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose vec_id fulfils ``asked``."""
    spark = table.sparkSession
    vectors = stored(integer_vectors(table, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    norms = vectors.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("largest"), F.count("*").alias("n")).collect()
    n = sum(row["n"] for row in norms)
    sample = [row["v"] for row in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    pivots = spark.sparkContext.broadcast(Pivots(sample, {row["dim"]: row["largest"] for row in norms}, min(MAX_PIVOTS, max(1, ceil(sqrt(n) / 4)))))
    keyed = stored(vectors.mapInArrow(releasing(_keyer(pivots)), "dim int, cell int, distance double, vec_id long, v binary, width int"), "keyed-vectors")
    index = build_index(keyed)
    queries = build_index(keyed.filter(asked), QUERY_ROWS, "q")
    directory = index.select("block", "dim", "cell", "low", "high")
    asking = _side(queries, "q")
    # one annulus for each query block: the nearest of its own cell
    gap = F.abs((F.col("q.low") + F.col("q.high")) / 2 - (F.col("d.low") + F.col("d.high")) / 2)
    nearest = queries.select("block", "dim", "cell", "low", "high").alias("q") \
        .join(directory.alias("d"), (F.col("q.dim") == F.col("d.dim")) & (F.col("q.cell") == F.col("d.cell"))) \
        .groupBy(F.col("q.block").alias("q_block")).agg(F.min(F.struct(gap.alias("gap"), F.col("d.block").alias("d_block"))).alias("x")) \
        .select("q_block", "x.d_block")
    bounds = nearest.join(asking, "q_block").join(_side(index, "d"), "d_block").mapInArrow(releasing(_visitor(k, True)), "q_block string, bounds binary")
    bounded = stored(asking.join(bounds, "q_block"), "query-bounds")
    intervals = bounded.mapInArrow(releasing(_interval_maker(pivots)), "q_block string, dim int, cell int, from double, to double")
    visits = stored(intervals.alias("i").join(directory.alias("d"), (F.col("i.dim") == F.col("d.dim")) & (F.col("i.cell") == F.col("d.cell"))
                                              & (F.col("d.low") <= F.col("to")) & (F.col("d.high") >= F.col("from"))).select("q_block", F.col("block").alias("d_block")), "visits")
    found = visits.join(bounded, "q_block").join(_side(index, "d"), "d_block").mapInArrow(releasing(_visitor(k, False)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
