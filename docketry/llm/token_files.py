"""Token ids in files, coded by a static range asymmetric numeral system with interleaved lanes.

One table of frequencies serves all blocks of a corpus. A block holds whole documents, in ascending key order,
and can be decoded by itself: its header has the state of every lane, checkpoints inside it give the states
and the place in the stream after every ``CHECKPOINT_STEPS`` steps, and a CRC-32 closes it. Token t belongs to lane
t mod lanes; a step codes one token of each lane, so the lanes of a block advance together as arrays.

Block, little-endian: "RANS", version u8, scale bits u8, lanes u16, table CRC u32, tokens u64, checkpoints u32,
words u32, state u64 per lane, checkpoints (step u32, word u32, state u64 per lane), words u32, CRC u32 of all before.
Blocks are rows of Parquet files beside the keys and lengths of their documents, so Spark's writer commits them and a
reader may decode any subset; the table of frequencies lies in a folder beside them.

Defined results: a null or empty text is a document with the end id alone; rows with a null key come first; repeated
rows are stored each, equal keys next to each other; an empty table gives files without blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import encode
from docketry.llm.common import releasing, stored, text_runs, texts_of

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 524_288
_HEAD = struct.Struct("<4sBBHIQII")
_U = np.uint64

RAW = "part int, block int, inside long, n_tokens long, doc_ids array<long>, doc_lengths array<long>, ids binary, counts binary"
FILES = "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def normalised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits; every symbol that occurs keeps at least 1."""
    total, scale = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > scale:
        raise ValueError("more symbols than slots: raise the scale bits")
    share = counts.astype(np.float64) * (scale / total)
    table = np.where(counts > 0, np.maximum(share.astype(np.int64), 1), 0)
    excess = int(table.sum()) - scale
    order = np.argsort(-table, kind="stable")
    while excess:  # the most frequent symbols give or take what rounding left over
        room = table[order] - 1 if excess > 0 else np.full(len(order), scale)
        step = np.minimum(np.maximum(room, 0), max(1, abs(excess) // 64 + 1))
        step = np.minimum(step, np.maximum(abs(excess) - (np.cumsum(step) - step), 0))
        table[order] -= step * (1 if excess > 0 else -1)
        excess = int(table.sum()) - scale
    return table.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks by one table of frequencies."""

    def __init__(self, frequencies: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.f = bits, frequencies.astype(np.uint64)
        self.c = np.cumsum(self.f) - self.f
        self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint16 if len(self.f) <= 1 << 16 else np.uint32), self.f.astype(np.int64))
        self.crc = zlib.crc32(self.f.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> bytes:
        n, steps = len(ids), -(-len(ids) // lanes)
        states = np.full(lanes, LOW, np.uint64)
        words, sizes, points = [], np.zeros(steps, np.int64), []
        bits, symbols = _U(self.bits), ids.astype(np.intp)
        all_f, all_c = self.f[symbols], self.c[symbols]
        limits = all_f << _U(31 - self.bits + 32)
        for step in range(steps - 1, -1, -1):
            own = slice(step * lanes, (step + 1) * lanes)
            f = all_f[own]
            x = states[:len(f)]
            full = x >= limits[own]
            out = x[full]
            words.append(out.astype(np.uint32))
            sizes[step] = len(out)
            x[full] = out >> _U(32)
            quotient = x // f
            x -= quotient * f
            x += quotient << bits
            x += all_c[own]
            if step and step % CHECKPOINT_STEPS == 0:
                points.append((step, states.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(sizes)])
        body = [_HEAD.pack(b"RANS", 1, self.bits, lanes, self.crc, n, len(points), len(stream)), states.astype("<u8").tobytes()]
        for step, held in reversed(points):
            body += [struct.pack("<II", step, int(before[step])), held.astype("<u8").tobytes()]
        body.append(stream.astype("<u4").tobytes())
        data = b"".join(body)
        return data + struct.pack("<I", zlib.crc32(data))

    def decode(self, data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Tokens first..last of a block (all, if not given), starting at the nearest checkpoint before them."""
        (crc,) = struct.unpack("<I", data[-4:])
        magic, version, bits, lanes, table, n, n_points, n_words = _HEAD.unpack_from(data)
        if magic != b"RANS" or version != 1 or crc != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("damaged block")
        if table != self.crc or bits != self.bits:
            raise ValueError("block of another table of frequencies")
        at = _HEAD.size
        states = np.frombuffer(data, "<u8", lanes, at).copy()
        at, step, word = at + 8 * lanes, 0, 0
        last = n if last is None else min(last, n)
        for _ in range(n_points):
            s, w = struct.unpack_from("<II", data, at)
            if s * lanes <= first:
                step, word, states = s, w, np.frombuffer(data, "<u8", lanes, at + 8).copy()
            at += 8 + 8 * lanes
        words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)
        begin, mask, shift = step * lanes, _U((1 << self.bits) - 1), _U(self.bits)
        out = np.empty(max(last - begin, 0), np.uint32)
        while step * lanes < last:
            m = min(lanes, n - step * lanes)
            x = states[:m]
            slot = x & mask
            symbol = self.symbol[slot.view(np.int64)].astype(np.intp)
            x = self.f[symbol] * (x >> shift)
            x += slot
            x -= self.c[symbol]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << _U(32)) | words[word:word + len(low)]
            word += len(low)
            states[:m] = x
            place = step * lanes - begin
            out[place:place + m] = symbol[:len(out) - place]
            step += 1
        return out[max(first - begin, 0):]


def _blocks(name: str, end_id: int, block_tokens: int):
    """Runs of whole documents of at least ``block_tokens`` tokens; the last of a part may be shorter.

    The last row of a part has no document but the numbers of all ids in it, so that the ids are not read for them.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block = encode.encoder(name), TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = inside = 0
        counts = np.zeros(0, np.int64)

        def flush(last: bool = False) -> pa.RecordBatch:
            tokens = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            narrow = "<u2" if tokens.max(initial=0) < 1 << 16 else "<u4"
            row = [[part], [block], [inside], [held], [keys], [np.concatenate(lengths) if lengths else []], [tokens.astype(narrow).tobytes()],
                   [counts.astype("<i8").tobytes() if last else None]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in RAW.split(", ")])

        for some, texts in text_runs(batches):
            found, n = coder.encode(texts)
            n = n + 1
            ends = np.cumsum(n)
            whole = np.full(int(ends[-1]), end_id, np.uint32)
            own = np.ones(len(whole), bool)
            own[ends - 1] = False
            whole[own] = found
            counts = _sum(counts, np.bincount(whole))
            # whole documents up to the first border behind each multiple of the block size
            cuts = np.append(np.flatnonzero(np.diff((held + ends) // block_tokens)) + 1, len(n))
            first = 0
            for cut in cuts.tolist():
                keys += some[first:cut]
                lengths.append(n[first:cut])
                ids.append(whole[ends[first] - n[first]:ends[cut - 1]])
                held += len(ids[-1])
                first = cut
                if held >= block_tokens:
                    yield flush()
                    keys, lengths, ids, held, inside, block = [], [], [], 0, inside + held, block + 1
        if keys:
            yield flush()
            keys, lengths, ids, held, inside, block = [], [], [], 0, inside + held, block + 1
        if len(counts):
            yield flush(last=True)
    return make


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    a[:len(b)] += b
    return a


def _ids(row: pa.RecordBatch, i: int) -> np.ndarray:
    """Ids of a raw block, two or four bytes each."""
    data = row.column("ids")[i].as_buffer()
    return np.frombuffer(data, f"<u{len(data) // row.column('n_tokens')[i].as_py()}")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for data in batch.column("counts").to_pylist():
            counts = _sum(counts, np.frombuffer(data, "<i8").copy())
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["symbol", "n"])


def _encoder(frequencies: np.ndarray, before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                start = before[row.column("part")[0].as_py()] + row.column("inside")[0].as_py()
                kept = [row.column(x) for x in ("part", "block", "n_tokens", "doc_ids", "doc_lengths")]
                yield pa.RecordBatch.from_arrays(
                    [*kept[:2], pa.array([start], pa.int64()), *kept[2:], pa.array([coder.encode(_ids(batch, i))], pa.binary())],
                    [x.split()[0] for x in FILES.split(", ")])
    return run


def write_token_files(docs: DataFrame, path: str, name: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode all texts and write ``path``/blocks and ``path``/table. Every text is encoded once."""
    spark = docs.sparkSession
    ordered = texts_of(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    raw = stored(ordered.mapInArrow(releasing(_blocks(name, end_id, BLOCK_TOKENS)), RAW), "token-blocks")
    found = raw.filter("counts is not null").select("counts").mapInArrow(releasing(_histogram), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((row["symbol"] for row in found), default=-1) + 1, np.int64)  # no longer than the vocabulary
    for row in found:
        counts[row["symbol"]] = row["n"]
    frequencies = normalised(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequencies)], "symbol int, frequency long").coalesce(1).write.parquet(f"{path}/table")
    before, total = {}, 0  # parts follow the key order; one number for each part
    for part, n in sorted((row["part"], row["n"]) for row in raw.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        before[part] = total
        total += n
    raw.filter("counts is null").drop("counts").mapInArrow(releasing(_encoder(frequencies, before)), FILES).write.parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """Frequencies of the symbols; as many rows as the vocabulary has ids."""
    rows = sorted((row["symbol"], row["frequency"]) for row in spark.read.parquet(f"{path}/table").collect())
    return np.array([f for _, f in rows], np.uint64)


def _decoder(frequencies: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = coder.decode(row.column("payload")[0].as_py())
                lengths = np.array(row.column("doc_lengths")[0].as_py(), np.int64)
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                bodies = [data[4 * (end - n):4 * end] for end, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                last = pa.array([zlib.crc32(x) for x in bodies], pa.int64()) if digest else pa.array([bytes(x) for x in bodies], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row.column("doc_ids")[0].as_py(), pa.int64()), pa.array(row.column("start")[0].as_py() + ends - lengths),
                     pa.array(lengths), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian unsigned 32-bit) of every document, or their CRC-32, decoded from the files."""
    last = "ids_crc32 long" if digest else "ids binary"
    blocks = spark.read.schema(FILES).parquet(f"{path}/blocks")
    return blocks.mapInArrow(releasing(_decoder(read_table(spark, path), digest)), f"doc_id long, start long, n_tokens long, {last}")
