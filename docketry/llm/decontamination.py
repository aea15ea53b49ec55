"""Benchmark decontamination by an FM-index for each shard of the training text.

A shard is a run of whole documents in one task of about ``SHARD_BYTES`` bytes. Words that no
benchmark text has cannot lie inside an occurrence, so they only divide the indexed text, and stretches between
them that are shorter than the shortest window are left out: the index answers every window as one of the
whole text would. Backward search finds all windows at once, sampled positions locate them, and overlapping
occurrences merge into removal spans.

The windows of a benchmark travel to the tasks in blocks of at most ``BLOCK_WORDS`` words, one broadcast each;
every block is searched in every shard, so a larger benchmark means more blocks, not fewer windows.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; equal items
count by their ids; an item without id counts under the empty id; repeated rows have a line each; empty tables
give no lines or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import releasing, run_borders, text_runs, texts_of
from docketry.llm.fm_index import FMIndex

WINDOW = 13
SHARD_BYTES = 8_000_000
BLOCK_WORDS = 2_000_000

#: ASCII letters lower-cased, everything that is no word byte a blank; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

#: The same words in the text as it is.
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Windows:
    """Windows of a block of items: vocabulary, one array of phrases for each length, the items of each phrase."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        found: dict[int, dict[bytes, list[int]]] = {}
        for number, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(word, len(self.vocabulary) + 2) for word in text], np.int32)
            length = min(window, len(ids))
            for start in range(len(ids) - length + 1 if length else 0):
                found.setdefault(length, {}).setdefault(ids[start:start + length].tobytes(), []).append(number)
        self.phrases = {length: np.array([np.frombuffer(x, np.int32) for x in texts]).astype(np.int64) for length, texts in found.items()}
        self.items = {length: list(texts.values()) for length, texts in found.items()}
        self.shortest = min(found, default=0)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Shard:
    """Documents of a shard and the reduced text that is indexed: symbol, document and word place of each position."""

    def __init__(self):
        self.symbols: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []

    def add(self, number: int, symbols: np.ndarray, shortest: int) -> None:
        """``symbols``: 1 for a word outside the vocabulary."""
        walls = np.flatnonzero(np.concatenate([[1], symbols, [1]]) == 1)
        lengths = np.diff(walls) - 1
        for i in np.flatnonzero(lengths >= max(shortest, 1)).tolist():
            start, n = int(walls[i]), int(lengths[i])
            self.symbols += [symbols[start:start + n], np.ones(1, np.int64)]
            self.where.append(np.arange(start, start + n + 1))
            self.owner.append(np.full(n + 1, number))

    def hits(self, windows: Windows) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Removal spans and items of every document that has any."""
        if not self.symbols or not windows.phrases:
            return {}
        text = np.concatenate([*self.symbols, np.zeros(1, np.int64)])
        where, owner = np.concatenate(self.where), np.concatenate(self.owner)
        index = FMIndex(text, len(windows.vocabulary) + 2)
        rows = []
        for length, phrases in windows.phrases.items():
            phrase, place = index.locate(*index.search(phrases))
            rows.append((owner[place], where[place], np.full(len(place), length), phrase))
        documents, starts, lengths, phrase = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(documents, kind="stable")
        out = {}
        for part in np.split(order, np.flatnonzero(np.diff(documents[order])) + 1) if len(order) else []:
            spans = _merged(starts[part], starts[part] + lengths[part])
            pairs = set(zip(lengths[part].tolist(), phrase[part].tolist(), strict=True))
            out[int(documents[part[0]])] = spans, {windows.names[i] for n, p in pairs for i in windows.items[n][p]}
        return out


def examine(texts: list[str], blocks: list[Windows]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Number of words, removal spans (word places) and items hit of each text; the texts are one shard."""
    found = [words(text) for text in texts]
    result: list[tuple[int, list, set]] = [(len(x), [], set()) for x in found]
    for windows in blocks:
        shard, get = Shard(), windows.vocabulary.get
        for number, text in enumerate(found):
            shard.add(number, np.fromiter((get(word, 1) for word in text), np.int64, len(text)), windows.shortest)
        for number, (spans, items) in shard.hits(windows).items():
            n, old, names = result[number]
            both = np.array([*old, *spans]).reshape(-1, 2)
            result[number] = n, _merged(both[:, 0], both[:, 1]), names | items
    return result


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _searcher(blocks: list):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [block.value for block in blocks]
        for keys, texts in text_runs(batches, SHARD_BYTES):
            rows = []
            for key, (n, spans, items) in zip(keys, examine(texts, held), strict=True):
                hit = sum(end - start for start, end in spans)
                name = hashlib.sha256(",".join(sorted(items)).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((key, n, hit, len(items), name, is_contaminated(n, hit), [{"start": s, "end": e} for s, e in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return search


def _cleaner(blocks: list, cut: Callable[[str, list[tuple[int, int]]], str]):
    def clean_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [block.value for block in blocks]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keep: list[bool] = []
            for start, end in run_borders(batch.column("text"), SHARD_BYTES):
                for i, (n, spans, _) in enumerate(examine([text or "" for text in texts[start:end]], held), start):
                    keep.append(not is_contaminated(n, sum(e - s for s, e in spans)))
                    if keep[-1] and spans:
                        texts[i] = cut(texts[i], spans)
            at = batch.schema.get_field_index("text")
            done = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield done.filter(pa.array(keep, pa.bool_()))
    return clean_


def window_blocks(items: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> Iterator[Windows]:
    """Blocks of items with at most ``limit`` words each, read one partition of the benchmark at a time."""
    held, size = [], 0
    read = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for row in read.toLocalIterator():
        found = words(row["text"])
        if held and size + len(found) > limit:
            yield Windows(held, window)
            held, size = [], 0
        held.append((row["item_id"], found))
        size += len(found)
    if held:
        yield Windows(held, window)


def _shared(docs: DataFrame, items: DataFrame, window: int) -> list:
    return [docs.sparkSession.sparkContext.broadcast(block) for block in window_blocks(items, window)]


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, hit words, items hit, the verdict and the merged removal spans (word places) of every row."""
    return texts_of(docs).mapInArrow(releasing(_searcher(_shared(docs, items, window))), RESULT)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    borders = [match.span() for match in _WORD.finditer(text)]
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:borders[start][0]])
        at = borders[end - 1][1]
    return "".join([*parts, text[at:]])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, that are not contaminated; from their ``text`` the removal spans are cut."""
    return docs.mapInArrow(releasing(_cleaner(_shared(docs, items, window), cut_spans)), docs.schema)
