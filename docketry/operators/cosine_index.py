"""Exact top k by cosine over blocks of near vectors that a bound closes.

The vectors of a bucket are ordered by the nearest of some pivots and by how near it is, and cut into blocks. A block knows
its centre and between which cosines to the centre its vectors lie. For unit vectors q, x and centre c the Cauchy-Schwarz inequality on
the parts across c gives q.x <= (q.c)(c.x) + sqrt(1 - (q.c)^2) sqrt(1 - (c.x)^2), so the block has a highest score that any of its
vectors can reach. In a first round a query visits the blocks of the highest bounds until they hold k vectors; its k-th score
travels to the second round, which looks into every block whose bound reaches that score.

Neighbouring blocks form a group, whatever buckets they belong to. What moves are groups of blocks and packets of queries: a packet goes to
a group once, with those of its queries for which any block of the group is open and with all that they ask there (layers, buckets), and the task
that holds the group closes its blocks one by one. There are about ``SPOTS`` pairs of a group and a part of the queries, however many vectors there
are: as many groups as move the fewest numbers, and each group is copied for the parts of the queries. So a vector moves a fixed number of
times, until the groups hold ``HELD`` bytes or the parts ``SPLIT`` queries; from there on the number of pairs of such full tiles counts.
Vectors of single precision move and lie in memory as such, and are scored in double precision.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from docketry.session import stored

#: Vectors of a block, pivots that order them, queries of a packet, blocks of a page of the directory, copies of a page.
BLOCK, PIVOTS, PACKET, PAGE, SALTS = 2048, 256, 128, 4096, 32
#: Pairs of a group and a part of the queries, which are the tasks of the second round; groups at most, as long as none holds more than ``HELD`` bytes of vectors.
SPOTS, GRID, HELD = 24, 4, 1 << 26
#: Queries that a copy of the groups may serve.
SPLIT = 524_288
#: Pairs that are scored exactly at once.
PAIRS = 1 << 14
#: What rounding may add to a bound: the root of a number near zero has half its digits.
SLACK = 1e-7

_HITS = "query_id long, layer string, k int, doc_ids array<long>, scores array<double>"


def precision(table: DataFrame) -> str:
    """How the vectors of a table move: in single precision where the column has it, else in double."""
    return "f4" if isinstance(table.schema["vec"].dataType.elementType, FloatType) else "f8"


def _numbers(kind: str) -> str:
    return "array<float>" if kind == "f4" else "array<double>"


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(vectors: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of vectors as bytes, which move without a look at their numbers; ``sizes``: rows of each value."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * vectors.shape[1] * vectors.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("i4")), pa.py_buffer(np.ascontiguousarray(vectors))])


def unpacked(column: pa.Array, rows: int, kind: str) -> np.ndarray:
    """The vectors of ``packed``; ``rows``: how many all values hold."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1.0)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of the runs of rows that agree in all columns."""
    if not len(columns[0]):
        return
    new = np.logical_or.reduce([np.concatenate([[True], x[1:] != x[:-1]]) for x in columns])
    starts = np.flatnonzero(new).tolist()
    yield from zip(starts, [*starts[1:], len(columns[0])], strict=True)


def _by_width(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose vectors have one width."""
    dim = batch.column("dim").to_numpy(zero_copy_only=False)
    for n in np.unique(dim).tolist():
        yield batch.filter(pa.array(dim == n))


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each width unit vectors from a sample of ``PIVOTS`` rows, in an order in which the next one is the nearest of the rest.

    They only decide which vectors share a block: any pivots give the same hits.
    """
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("dim", "vec").limit(PIVOTS).collect()
    out = {}
    for dim in {row["dim"] for row in sample}:
        units = unit(np.array([row["vec"] for row in sample if row["dim"] == dim]))
        near, order = units @ units.T, [0]
        near[:, 0] = -np.inf
        while len(order) < len(units):
            order.append(int(near[order[-1]].argmax()))
            near[:, order[-1]] = -np.inf
        out[dim] = units[order]
    return out


def _placer(fixed: dict[int, np.ndarray]):
    """Adds the nearest pivot and the cosine to it."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_width(batch):
                vectors = unit(matrix(part.column("vec")).astype("f8"))
                near = vectors @ fixed.get(vectors.shape[1], np.zeros((1, vectors.shape[1]))).T
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.argmax(axis=1)), pa.array(near.max(axis=1))], [*part.schema.names, "cell", "near"])
    return place


def _packer(block_rows: int, columns: list[str]):
    """Cuts sorted rows into blocks; the first row of a block also describes it."""
    def described(rows: pa.Table, block: int) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        vectors = matrix(rows.column("vec"))
        exact, n = vectors.astype("f8"), rows.num_rows
        units = unit(exact)
        centre = unit(units.mean(axis=0))
        to_centre = units @ centre
        first = [n, centre.tolist(), float(to_centre.min()), float(to_centre.max()), float(np.linalg.norm(exact, axis=1).min())]
        kinds = [pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [rows.column("bucket"), rows.column("dim"), pa.array(np.full(n, block)), rows.column("doc_id"), packed(vectors, np.ones(n, int)),
             *(pa.array([value, *[None] * (n - 1)], kind) for value, kind in zip(first, kinds, strict=True))], columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, last = TaskContext.get().partitionId() << 24, [], 0, None
        for batch in batches:
            bucket, dim, cell = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "dim", "cell"))
            for start, end in _runs(bucket, dim, cell):
                own = bucket[start], dim[start], cell[start]
                # another bucket begins another block; another cell does once there are some rows
                if held and (own[:2] != last[:2] or own != last and size >= block_rows // 8):
                    yield described(pa.Table.from_batches(held), number)
                    number, held, size = number + 1, [], 0
                last = own
                while start < end:
                    part = batch.slice(start, min(end - start, block_rows - size))
                    held.append(part)
                    start, size = start + part.num_rows, size + part.num_rows
                    if size == block_rows:
                        yield described(pa.Table.from_batches(held), number)
                        number, held, size = number + 1, [], 0
        if held:
            yield described(pa.Table.from_batches(held), number)
    return pack


def build(corpus: DataFrame) -> DataFrame:
    """Blocks of the corpus (doc_id, vec, bucket), a row for each vector, written to the shared folder."""
    numbers = _numbers(precision(corpus))
    rows = corpus.filter("vec is not null and size(vec) > 0").select(F.col("bucket"), F.size("vec").alias("dim"), F.col("doc_id").cast("long"), F.col("vec").cast(numbers))
    placed = rows.mapInArrow(_placer(pivots(rows)), f"bucket string, dim int, doc_id long, vec {numbers}, cell long, near double")
    order = ["bucket", "dim", "cell", "near", "doc_id"]
    schema = "bucket string, dim int, block long, doc_id long, vec binary, n int, centre array<double>, low double, high double, least_norm double"
    columns = [x.split()[0] for x in schema.split(", ")]
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packer(BLOCK, columns), schema), "vector-blocks")


def directory(blocks: DataFrame, queries: int, kind: str) -> DataFrame:
    """A row for each block: what is known of it, its group, its seat (the finer group of the first round) and its page, which holds whole groups.

    Groups are cut by rows, over all buckets. The second round moves each of ``queries`` queries to every open group and each vector to
    ``SPOTS`` / groups parts: a query takes its hits along and weighs about twice as much as a vector.
    """
    width = F.lit(4 if kind == "f4" else 8)
    so_far = Window.partitionBy("dim").orderBy("block")
    known = blocks.filter("n is not null").select(
        "bucket", "dim", "block", "n", "centre", "low", "high", "least_norm",
        (F.sum("n").over(so_far) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("dim")).alias("total"))
    full = F.ceil(F.col("total") * F.col("dim") * width / HELD)
    few = F.least(F.lit(GRID), F.greatest(F.round(F.sqrt(F.lit(SPOTS / 2 / max(queries, 1)) * F.col("total"))), F.lit(1)))
    cut = known.withColumn("cuts", F.greatest(full, few).cast("long")) \
        .withColumn("group", F.floor(F.col("before") * F.col("cuts") / F.col("total")).cast("int")) \
        .withColumn("seat", F.floor(F.col("before") * F.greatest(F.col("cuts"), F.lit(SPOTS)) / F.col("total")).cast("int"))
    group = Window.partitionBy("dim", "group")
    # a page ends with a group
    paged = cut.withColumn("place", F.row_number().over(so_far)).withColumn("page", F.floor(F.min("place").over(group) / PAGE))
    return stored(paged.drop("before", "total", "cuts", "place"), "vector-directory")


def pages(listed: DataFrame) -> DataFrame:
    """The directory in rows of about ``PAGE`` blocks, or of one group; copied, since few widths would be few keys of a join."""
    columns = {"block": "blocks", "group": "groups", "n": "rows", "low": "lows", "high": "highs", "least_norm": "norms", "bucket": "buckets"}
    rows = listed.groupBy("dim", "page").agg(F.sort_array(F.collect_list(F.struct(*columns, "centre"))).alias("b"))
    return rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
                       *[F.col(f"b.{name}").alias(plural) for name, plural in columns.items()], F.flatten("b.centre").alias("centres"))


_ASKED = ["query_ids", "owners", "kind_nos", "kths", "kinds"]
_PACKET = "dim int, query_ids array<long>, owners array<int>, kind_nos array<int>, kths array<double>, kinds array<string>, vecs binary"
_VISIT = "dim int, group int, query_ids array<long>, owners array<int>, kind_nos array<int>, onlys array<long>, kths array<double>, kinds array<string>, vecs binary"


def _listed(values, kind: pa.DataType) -> pa.ListArray:
    """One value: the list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values.cast(kind))


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _grouper(size: int):
    """Queries of one width in packets of at most ``size``. What they ask is a flat list: whose it is, what kind, the k-th score so far."""
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.lexsort([_numpy(batch.column(x)) for x in ("near", "dim")])))
            for start, end in _runs(_numpy(batch.column("dim"))):
                for at in range(start, end, size):
                    part = batch.slice(at, min(size, end - at))
                    asks, vectors = part.column("asks"), matrix(part.column("vec"))
                    flat = asks.flatten()
                    kinds = flat.field("kind").dictionary_encode()
                    owners = np.repeat(np.arange(len(part)), pc.list_value_length(asks).to_numpy())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("dim").slice(0, 1), _listed(part.column("query_id"), pa.int64()), _listed(owners, pa.int32()), _listed(kinds.indices, pa.int32()),
                         _listed(flat.field("kth"), pa.float64()), _listed(kinds.dictionary, pa.string()), packed(vectors, np.array([len(part)]))],
                        ["dim", *_ASKED, "vecs"])
    return group


def packets(asked: DataFrame, kind: str) -> DataFrame:
    """Queries in packets, near ones together as far as a batch goes. ``asked``: query_id, vec, asks (kind, kth)."""
    rows = asked.filter("vec is not null and size(vec) > 0 and size(asks) > 0").select(
        F.size("vec").alias("dim"), F.element_at("vec", 1).cast("double").alias("near"), F.col("query_id").cast("long"), "asks", F.col("vec").cast(_numbers(kind)))
    return rows.mapInArrow(_grouper(PACKET), _PACKET)


def highest(queries: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The score that no vector of a block exceeds, for each query and block; scores are rounded and damped for tiny vectors."""
    own = unit(queries) @ centres.T
    nearest = np.clip(own, low, high)
    bound = own * nearest + np.sqrt(np.maximum(1 - own ** 2, 0)) * np.sqrt(np.maximum(1 - nearest ** 2, 0))
    product = np.linalg.norm(queries, axis=1)[:, None] * norms
    return np.where(bound >= 0, bound, bound * product / (product + 1e-9)) + SLACK


def _permitted(kinds: list[dict], nos: np.ndarray, buckets: list[str]) -> np.ndarray:
    """For each thing asked and each block: does the block lie in a bucket it may look into."""
    names, at = np.unique(np.array(buckets, object).astype(str), return_inverse=True)
    return np.array([np.isin(names, kind["buckets"]) for kind in kinds]).reshape(len(kinds), len(names))[nos][:, at]


def _chooser(closing: bool, kind: str):
    """The visits of packets: with ``closing`` to groups in which a block reaches the k-th score, else to the best blocks that hold k rows."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: _numpy(batch.column(name)[i].values) for name in ("query_ids", "owners", "kind_nos", "kths", "centres", "blocks", "groups", "rows", "lows", "highs", "norms")}
                dim = batch.column("dim")[i].as_py()
                queries = np.frombuffer(batch.column("vecs")[i].as_buffer(), kind).reshape(-1, dim)
                written = batch.column("kinds")[i].values
                kinds = [json.loads(x) for x in written.to_pylist()]
                owners, nos, blocks, groups, rows = (row[x] for x in ("owners", "kind_nos", "blocks", "groups", "rows"))
                bound = highest(queries.astype("f8"), row["centres"].reshape(-1, dim), row["lows"], row["highs"], row["norms"])[owners]
                permitted = _permitted(kinds, nos, batch.column("buckets")[i].as_py())
                if closing:
                    # a query without k hits so far has no k-th score; groups are runs of blocks
                    starts = np.array([start for start, _ in _runs(groups)])
                    asking, met = np.nonzero(np.logical_or.reduceat(permitted & ~(bound < row["kths"][:, None].astype(float)), starts, axis=1))
                    group, only = groups[starts[met]], np.full(len(met), -1)
                else:
                    order = np.argsort(np.where(permitted, -bound, np.inf), axis=1, kind="stable")
                    before = np.cumsum(rows[order], axis=1) - rows[order]
                    k = np.array([x["k"] for x in kinds])[nos]
                    asking, place = np.nonzero((before < k[:, None] + 1) & np.take_along_axis(permitted, order, axis=1))
                    met = order[asking, place]
                    group, only = groups[met], blocks[met]
                for g in np.unique(group).tolist():
                    some = np.flatnonzero(group == g)
                    own, place = np.unique(owners[asking[some]], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([g], pa.int32()), _listed(row["query_ids"][own], pa.int64()), _listed(place, pa.int32()), _listed(nos[asking[some]], pa.int32()),
                         _listed(only[some], pa.int64()), _listed(row["kths"][asking[some]].astype(float), pa.float64()), _listed(written, pa.string()), packed(queries[own], np.array([len(own)]))],
                        [x.split()[0] for x in _VISIT.split(", ")])
    return choose


def visits(asked: DataFrame, listed: DataFrame, closing: bool) -> DataFrame:
    """A row for each packet and group that it visits, with what its queries ask there (``onlys``: of one block). ``asked``: query_id, vec, asks."""
    kind = precision(asked)
    met = packets(asked, kind).withColumn("salt", F.pmod(F.xxhash64("query_ids"), F.lit(SALTS)).cast("int")).join(pages(listed), ["dim", "salt"])
    return met.mapInArrow(_chooser(closing, kind), _VISIT)


class _Group:
    """The blocks of a group, and the best k of each packet among them.

    Pairs are sifted by their cosines in single precision; whatever could reach the score asked for is scored in double precision.
    Vectors whose length is so small or large that this says nothing of their scores are scored in double precision at once.
    """

    def __init__(self, rows: list[pa.RecordBatch], kind: str):
        block = np.concatenate([_numpy(x.column("block")) for x in rows])
        ids = np.concatenate([_numpy(x.column("id")) for x in rows])
        order = np.lexsort((ids, block))
        self.ids, self.docs = ids[order], np.concatenate([unpacked(x.column("vecs"), len(x), kind) for x in rows])[order]
        self.norms, self.near = np.empty(len(ids)), np.empty(self.docs.shape, "f4")
        for at in range(0, len(ids), BLOCK):
            part = slice(at, at + BLOCK)
            exact = self.docs[part].astype("f8")
            self.norms[part], self.near[part] = np.linalg.norm(exact, axis=1), unit(exact)
        self.runs = list(_runs(block[order]))
        self.blocks = block[order][[start for start, _ in self.runs]]
        known = pa.Table.from_batches(rows).select(["block", "low", "high", "least_norm", "centre", "bucket"]).filter(pc.field("low").is_valid()).sort_by("block").combine_chunks()
        self.low, self.high, self.least = (known.column(x).to_numpy() for x in ("low", "high", "least_norm"))
        self.buckets = known.column("bucket").to_pylist()
        self.centres = matrix(known.column("centre").combine_chunks())
        self.tame = self._tame(self.norms)
        #: what single precision, damping and rounding may take from a score
        self.slack = 2e-5 + 2.4e-7 * self.docs.shape[1]

    @staticmethod
    def _tame(norms: np.ndarray) -> np.ndarray:
        return (norms >= 1e-2) & (norms <= 1e15)

    def answer(self, part: pa.RecordBatch, i: int, kind: str) -> pa.RecordBatch:
        """The best k of all that the packet ``i`` asks, a row for each query and layer."""
        ids, owners, nos, kths, only = (_numpy(part.column(x)[i].values) for x in ("query_ids", "owners", "kind_nos", "kths", "onlys"))
        kinds = [json.loads(x) for x in part.column("kinds")[i].values.to_pylist()]
        layers = np.array([x["layer"] for x in kinds], object)[nos]
        k, skip = (np.array([x[name] for x in kinds])[nos] for name in ("k", "skip_self"))
        queries = np.frombuffer(part.column("vecs")[i].as_buffer(), kind).reshape(len(ids), -1).astype("f8")
        floor = np.where(np.isnan(kths.astype(float)), -np.inf, kths.astype(float))
        permitted = _permitted(kinds, nos, self.buckets) & ((only[:, None] < 0) | (only[:, None] == self.blocks))
        # one block that is asked for is one thing asked: several of them for one query and layer give several rows
        row, at_doc, score = self._best(queries, owners, ids[owners], k, skip, floor, permitted)
        starts, ends = np.array(list(_runs(row)), int).reshape(-1, 2).T
        found, cuts = row[starts], pa.array([*starts.tolist(), len(row)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[owners[found]], pa.int64()), pa.array(layers[found], pa.string()), pa.array(k[found], pa.int32()),
             pa.ListArray.from_arrays(cuts, pa.array(self.ids[at_doc], pa.int64())), pa.ListArray.from_arrays(cuts, pa.array(score, pa.float64()))],
            ["query_id", "layer", "k", "doc_ids", "scores"])

    def _best(self, own_queries, owners, asked_by, k, skip, floor, permitted):
        """Number of what is asked, place and score of the best k of each in the blocks it may look into, as far as they reach ``floor``."""
        bound = highest(own_queries, self.centres, self.low, self.high, self.least)[owners]
        queries, norms = own_queries[owners], np.linalg.norm(own_queries, axis=1)[owners]
        near, tame, floor = unit(queries).astype("f4"), self._tame(norms), floor.copy()
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in np.flatnonzero(permitted.any(axis=0)).tolist():
            start, end = self.runs[j]
            asking = np.flatnonzero(permitted[:, j] & ~(bound[:, j] < floor))
            if not len(asking):
                continue
            found = []
            fast, docs = asking[tame[asking]], start + np.flatnonzero(self.tame[start:end])
            if len(fast) and len(docs):
                whole = len(docs) == end - start
                rows, cols = self._sifted(near[fast], self.near[start:end] if whole else self.near[docs], self.ids[docs], asked_by[fast], k[fast], skip[fast], floor[fast])
                found.append((fast[rows], docs[cols]))
            for some, others in ((fast, start + np.flatnonzero(~self.tame[start:end])), (asking[~tame[asking]], np.arange(start, end))):
                found.append((np.repeat(some, len(others)), np.tile(others, len(some))))
            row, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            own = skip[row] & (asked_by[row] == self.ids[doc])
            row, doc = row[~own], doc[~own]
            score = np.empty(len(row))
            for at in range(0, len(row), PAIRS):
                r, d = row[at:at + PAIRS], doc[at:at + PAIRS]
                score[at:at + PAIRS] = np.round(np.einsum("ij,ij->i", queries[r], self.docs[d].astype("f8")) / (norms[r] * self.norms[d] + 1e-9), 9)
            kept = np.isfinite(score) & (score >= floor[row])
            if not kept.any():
                continue
            row, doc, score = (np.concatenate([old, new[kept]]) for old, new in zip(held, (row, doc, score), strict=True))
            order = np.lexsort((self.ids[doc], -score, row))
            row, doc, score = row[order], doc[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            last = rank == k[row] - 1
            floor[row[last]] = np.maximum(floor[row[last]], score[last])
            held = tuple(x[rank < k[row]] for x in (row, doc, score))
        return held

    def _sifted(self, queries, docs, ids, asked_by, k, skip, floor):
        """Pairs that may be among the best k and reach ``floor``."""
        cosine = queries @ docs.T
        least = floor - self.slack
        new = np.flatnonzero(np.isneginf(floor))
        if len(new):
            # no score is known yet: the k-th cosine of this block is one, up to the slack on both sides
            other = cosine[new]
            other[skip[new, None] & (asked_by[new, None] == ids)] = -np.inf
            other.sort(axis=1)
            least[new] = other[np.arange(len(new)), np.maximum(len(ids) - k[new], 0)] - 2 * self.slack
        return np.divmod(np.flatnonzero(cosine >= least.astype("f4")[:, None]), len(ids))


def _scorer(of_docs: str, of_queries: str):
    """Rows of a spot come vectors first, then the packets that visit them: the best k of each visit."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, held, group = None, [], None
        for batch in batches:
            keys = [_numpy(batch.column(x)) for x in ("dim", "group", "part", "kind")]
            for start, end in _runs(*keys):
                part, here = batch.slice(start, end - start), tuple(int(x[start]) for x in keys[:3])
                if here != spot:
                    spot, held, group = here, [], None
                if keys[3][start] == 0:
                    held.append(part)
                    continue
                if group is None:
                    group, held = _Group(held, of_docs), []
                for i in range(len(part)):
                    yield group.answer(part, i, of_queries)
    return score


def hits(visited: DataFrame, blocks: DataFrame, listed: DataFrame, copies: int, kinds: tuple[str, str]) -> DataFrame:
    """The best k of every visit, a row for each query and layer. ``copies``: how often a group is copied, each copy for a part of the packets."""
    where = blocks.join(listed.select("block", "group"), "block")
    docs = where.select("dim", "group", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), F.lit(0).alias("kind"), "block", F.col("doc_id").alias("id"),
                        F.when(F.col("n").isNotNull(), F.col("bucket")).alias("bucket"), "low", "high", "least_norm", "centre", F.col("vec").alias("vecs"))
    asking = visited.withColumn("part", F.pmod(F.xxhash64("query_ids"), F.lit(copies)).cast("int")).withColumn("kind", F.lit(1))
    rows = docs.unionByName(asking, allowMissingColumns=True)
    # every spot is a task of its own: the work of a spot is not seen in its bytes
    spots = listed.agg(F.coalesce(F.max("group") + 1, F.lit(1))).first()[0] * copies
    dealt = rows.repartitionById(spots, (F.col("group") * copies + F.col("part")).cast("int"))
    return dealt.sortWithinPartitions("dim", "group", "part", "kind").mapInArrow(_scorer(*kinds), _HITS)


def best(found: DataFrame) -> DataFrame:
    """Of the hits of each query and layer the first k. They move as lists, and are rows afterwards."""
    rows = found.repartition("query_id").select("query_id", "layer", "k", F.explode(F.arrays_zip("doc_ids", "scores")).alias("hit")) \
        .select("query_id", "layer", "k", F.col("hit.doc_ids").alias("doc_id"), F.col("hit.scores").alias("score"))
    order = Window.partitionBy("query_id", "layer").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("k"))


def reached(found: DataFrame) -> DataFrame:
    """The k-th score of each layer of a query, null where there are fewer; a query visits few blocks in the first round."""
    scores = found.select("query_id", "layer", "k", "scores").repartition("query_id").groupBy("query_id", "layer", "k").agg(F.flatten(F.collect_list("scores")).alias("scores"))
    kth = F.get(F.sort_array("scores", asc=False), F.col("k") - 1)
    return scores.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("layer", kth.alias("kth")))).alias("kths"))


def search(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, layer, k, doc_id, score and rank of the best k. ``queries``: query_id, vec, asks (layer, k, skip_self, buckets; a layer occurs once); ``corpus``: doc_id, vec, bucket.

    Defined results: null and empty vectors neither ask nor answer; a vector of zeros scores 0 with all; ties go to the lower doc_id;
    a query whose buckets hold fewer than k vectors gets all of them; vectors of different widths do not meet.
    """
    kinds = precision(corpus), precision(queries)
    blocks, asking = build(corpus), queries.count()
    listed = directory(blocks, asking, kinds[0])
    groups = listed.agg(F.max("group")).first()[0]
    copies = max(-(-SPOTS // ((groups or 0) + 1)), -(-asking // SPLIT))

    def asks(kth):
        return F.transform("asks", lambda a: F.struct(F.to_json(a).alias("kind"), kth(a).alias("kth")))

    # the first round asks for some blocks only, so that a copy can serve more queries
    seats = listed.withColumn("group", F.col("seat"))
    seeking = queries.select("query_id", "vec", asks(lambda a: F.lit(None).cast("double")).alias("asks"))
    first = hits(visits(seeking, seats, False), blocks, seats, max(-(-asking // (2 * SPLIT)), 1), kinds)
    known = queries.withColumn("query_id", F.col("query_id").cast("long")).join(reached(first), "query_id", "left") \
        .select("query_id", "vec", asks(lambda a: F.try_element_at("kths", a["layer"])).alias("asks"))
    return best(hits(visits(known, listed, True), blocks, listed, copies, kinds))
