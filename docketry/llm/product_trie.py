"""Product quantisation with codebooks trained over lexicographic tries.

Every vector becomes integers and is cut into equal parts. The distinct parts of a run of vectors, with their counts, stand in
lexicographic order, which is a trie: a node of level k is a run of parts that agree in k + 1 components. A depth-first walk carries the
vector of accumulated squared distances to all entries of the codebook, so parts with a common prefix share its sum; at a leaf the
least one is the code, and count times part goes to the sums of that entry. All arithmetic is exact.

The tries are built where the vectors are read and written once to the shared folder; a round reads them, and only the sums of the entries
move. A walk holds a block of nodes for each level. The codebooks (entries times width numbers) are the only thing the driver holds.

Defined results: vectors that are null or hold null or non-finite components have no row, nor have vectors of another length than that
of the first vector (least key; among equal keys the least vector; null keys last). A length that 8 does not divide gives parts as equal as may be.
Fewer vectors than entries give fewer entries. Repeated rows and repeated keys count each and have a line each. Integers saturate at
2^62 in size, errors at the largest long. An empty table gives an empty result. Other columns than key, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import releasing, stored

#: Vectors whose parts form one trie for each part position.
RUN = 65_536
#: Nodes of a level whose distances are held at once.
BLOCK = 4096
_LARGEST = 1 << 62
_MOST = (1 << 63) - 1


def borders(width: int, parts: int) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * float(scale)), -float(_LARGEST), float(_LARGEST)).astype(np.int64)


def _exact(entries: np.ndarray, rows: np.ndarray) -> type:
    """64-bit integers where no sum of squared distances of some parts can leave them, else Python's."""
    largest = max((int(abs(x).max()) for x in (entries, rows) if x.size), default=0)
    return np.int64 if max(rows.shape[1], 1) * (2 * largest + 1) ** 2 < 1 << 54 else object


class Trie:
    """Distinct rows of integers in lexicographic order."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        changed = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        first = np.ones((min(len(rows), 1), rows.shape[1]), bool)
        changed = np.concatenate([first, changed])
        #: For each level the rows at which its nodes begin.
        self.nodes = [np.flatnonzero(changed[:, k]) for k in range(rows.shape[1])]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its nearest entry, the least of equally near ones, and the squared distance."""
        n, width = self.rows.shape
        kind = _exact(entries, self.rows)
        code, error = np.zeros(n, np.int64), np.zeros(n, kind)
        if not n or not width:
            return code, error
        entries = entries.astype(kind)
        # (level, first and last child, first parent, the parents' distances)
        stack = [(0, 0, len(self.nodes[0]), 0, np.zeros((1, len(entries)), kind))]
        while stack:
            level, start, end, parent, above = stack.pop()
            if end - start > BLOCK:
                stack.append((level, start + BLOCK, end, parent, above))
                end = start + BLOCK
            begins = self.nodes[level][start:end]
            own = np.zeros(len(begins), np.int64) if not level else np.searchsorted(self.nodes[level - 1], begins, side="right") - 1 - parent
            here = above[own] + (self.rows[begins, level].astype(kind)[:, None] - entries[:, level]) ** 2
            if level + 1 == width:
                best = here.argmin(axis=1)
                code[begins], error[begins] = best, here[np.arange(len(best)), best]
                continue
            below = self.nodes[level + 1]
            last = self.nodes[level][end] if end < len(self.nodes[level]) else n
            stack.append((level + 1, int(np.searchsorted(below, begins[0])), int(np.searchsorted(below, last)), start, here))
        return code, error


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows in lexicographic order, for each given row its place among them, and how often each occurs."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    ordered = rows[order]
    new = np.concatenate([[True] * min(len(rows), 1), (ordered[1:] != ordered[:-1]).any(axis=1)]).astype(bool)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, np.bincount(place, minlength=int(new.sum()))


def _vectors(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, RUN):
            run = batch.slice(start, RUN)
            yield run, integers(run.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(run.num_rows, width), scale)


def _builder(width: int, parts: int, scale: int):
    """Tries of all part positions: their rows and how often each occurs."""
    cuts = borders(width, parts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches):
            for _, vectors in _vectors(held, width, scale):
                found = [distinct_rows(vectors[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(parts), pa.int32()), pa.array([rows.astype("<i8").tobytes() for rows, _, _ in found], pa.binary()),
                    pa.array([counts.astype("<i8").tobytes() for _, _, counts in found], pa.binary())], ["part", "rows", "counts"])
    return build


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches joined to about a run each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= RUN:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()


def _summer(codebooks: list[np.ndarray], width: int):
    """Sums and numbers of the parts nearest to each entry, over the tries of a task: a row for each component of an entry."""
    cuts = borders(width, len(codebooks))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = [np.zeros(len(book), object) for book in codebooks]
        total = [np.zeros(book.shape, object) for book in codebooks]
        for batch in batches:
            for part, data, held in zip(batch.column("part").to_pylist(), batch.column("rows"), batch.column("counts"), strict=True):
                counts = np.frombuffer(held.as_buffer(), "<i8")
                rows = np.frombuffer(data.as_buffer(), "<i8").reshape(len(counts), cuts[part + 1] - cuts[part])
                code, _ = Trie(rows).nearest(codebooks[part])
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                kind = np.int64 if not rows.size or int(np.abs(rows).max()) * int(counts.sum()) < 1 << 62 else object
                used = code[order][starts]
                number[part][used] += np.add.reduceat(counts[order], starts)
                if rows.shape[1]:
                    total[part][used] += np.add.reduceat(rows[order].astype(kind) * counts[order].astype(kind)[:, None], starts, axis=0)
        place = [(part, e, i, number[part][e], total[part][e, i])
                 for part, book in enumerate(codebooks) for e in range(len(book)) if number[part][e] for i in range(book.shape[1])]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        columns = list(zip(*place, strict=True)) if place else [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(list(map(int, x)), kind) for x, kind in zip(columns[:4], kinds[:4], strict=True)),
                                          pa.array([Decimal(int(x)) for x in columns[4]], kinds[4])], ["part", "entry", "component", "n", "total"])
    return add


def _coder(codebooks: list[np.ndarray], width: int, scale: int):
    cuts = borders(width, len(codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _vectors(batches, width, scale):
            error, codes = np.zeros(len(vectors), np.int64), np.zeros((len(vectors), len(codebooks)), np.uint8)
            for part, book in enumerate(codebooks):
                rows, place, _ = distinct_rows(vectors[:, cuts[part]:cuts[part + 1]])
                code, distance = Trie(rows).nearest(book)
                codes[:, part] = code[place]
                error = error + distance[place]
            text = codes.tobytes().hex()
            step = 2 * len(codebooks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("group"), pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                 pa.array(error if error.dtype == np.int64 else [min(x, _MOST) for x in error], pa.int64())], ["vec_id", "group", "code", "error"])
    return run


def usable(vector: Column) -> Column:
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def train(vectors: DataFrame, width: int, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> list[np.ndarray]:
    """The codebook of each part position after all rounds. ``vectors``: vec_id and vector, all of one width."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = integers(np.array([row["vector"] for row in first], np.float64).reshape(len(first), width), scale)
    cuts = borders(width, parts)
    codebooks = [start[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)]
    tries = stored(vectors.select("vector").mapInArrow(releasing(_builder(width, parts, scale)), "part int, rows binary, counts binary"), "part-tries")
    for _ in range(rounds):
        sums = tries.mapInArrow(releasing(_summer(codebooks, width)), "part int, entry int, component int, n long, total decimal(38,0)")
        # a row for each number of the codebooks
        for row in sums.groupBy("part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            codebooks[row["part"]][row["entry"], row["component"]] = int(row["total"]) // row["n"]
    return codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    read = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("group"), F.col(vector).cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    least = read.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    width = least["n"] if least else 0
    read = read.filter(F.size("vector") == width)
    codebooks = train(read, width, parts, entries, rounds, scale) if least else [np.zeros((0, 0), np.int64)] * parts
    schema = T.StructType([T.StructField("vec_id", T.LongType()), read.schema["group"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = stored(read.select("vec_id", "group", "vector").mapInArrow(releasing(_coder(codebooks, width, scale)), schema), "vector-codes")
    summed = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    # stored, so that Spark sees how few labels there are, and can split a label that very many rows share where they are many
    by_label = stored(coded.groupBy(F.col("group").alias("other")).agg(summed.alias("label_error")), "label-errors")
    return coded.join(by_label, F.col("group").eqNullSafe(F.col("other"))) \
        .select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
