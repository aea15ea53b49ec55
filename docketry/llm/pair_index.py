"""Byte-pair encoding with an index of pair occurrences, and decoding.

The words of a run of texts that are not known yet stand in one array of symbols. An index maps every pair that has a merge to all
places where it occurs; the active ranks are taken in ascending order, each is applied at all its places at once, and the lists of the
pairs that come into being beside them are extended. A merge only makes pairs of later ranks (checked when the vocabulary is read), so
this gives what merging pair by pair in every single word gives. Normal form and word borders are those of the vocabulary file's own
normaliser and pre-tokeniser; merging and decoding are done here.

Texts are cut at blanks and newlines, which the vocabulary drops, and a table of bounded size keeps the ids of the pieces met so far.

Defined results: a null text is empty and has no ids; repeated rows have a line each; rows without key have a line; special strings inside
a text are their special ids; an empty table gives an empty result. Whole texts are encoded, however long: a text longer than a run is a
run by itself. Only the key and the text are read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docketry.llm.common import ragged, releasing, run_borders, texts_of

#: Bytes of text whose new words are indexed together.
RUN_BYTES = 8_000_000
#: Pieces and ids that the table of a worker may hold before it starts afresh.
MAX_PIECES, MAX_POOL = 400_000, 4_000_000

_OTHER_SPACE = re.compile(r"[^\S \n]")
_WORKER: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """One codec, with its table of pieces, for all tasks of a Python worker."""
    if name not in _WORKER:
        _WORKER[name] = Codec(name)
    return _WORKER[name]


class Merges:
    """The merge table of a vocabulary file, searchable by pair."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.left, self.right = (np.array([self.ids[pair[side]] for pair in pairs], np.int64) for side in (0, 1))
        self.made = np.array([self.ids["".join(pair)] for pair in pairs], np.int64)
        born = np.full(len(self.ids), -1)
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge of this vocabulary makes pairs of earlier ranks")
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has no merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def _add(index: dict[int, list[np.ndarray]], ranks: np.ndarray, places: np.ndarray) -> list[int]:
    """Add places to the lists of their ranks; returns the ranks that had no list yet."""
    known = ranks >= 0
    ranks, places = ranks[known], places[known]
    if not len(ranks):
        return []
    order = np.argsort(ranks, kind="stable")
    ranks, places = ranks[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
    fresh = []
    for rank, start, end in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)], strict=True):
        if rank in index:
            index[rank].append(places[start:end])
        else:
            index[rank] = [places[start:end]]
            fresh.append(rank)
    return fresh


def _every_second(places: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap one after the other, the first, third, ... of each chain."""
    begins = np.concatenate([[True], following[:-1] != places[1:]])
    at = np.arange(len(places))
    return places[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]


def apply_merges(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as runs of ``lengths`` symbols, and the number of ids of each word."""
    n, ends = len(symbols), np.cumsum(lengths)
    symbol = symbols.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = lengths > 0
    after[ends[filled] - 1] = -1
    before[(ends - lengths)[filled]] = -1
    index: dict[int, list[np.ndarray]] = {}
    places = np.flatnonzero(after >= 0)
    active = _add(index, merges.ranks(symbol[places], symbol[places + 1]), places)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        left, right = merges.left[rank], merges.right[rank]
        # a place may have been merged away, or stand before another symbol by now
        at = at[symbol[at] == left]
        second = after[at]
        good = (second >= 0) & (symbol[second] == right)
        at, second = at[good], second[good]
        if left == right and len(at) > 1:
            at = _every_second(at, second)
            second = after[at]
        if not len(at):
            continue
        third = after[second]
        symbol[at], symbol[second], after[at] = merges.made[rank], -1, third
        followed = third >= 0
        before[third[followed]] = at[followed]
        first = before[at]
        changed = np.concatenate([first[first >= 0], at[followed]])
        for new in _add(index, merges.ranks(symbol[changed], symbol[after[changed]]), changed):
            heapq.heappush(active, new)
    left_over = np.concatenate([[0], np.cumsum(symbol >= 0)])
    return symbol[symbol >= 0], left_over[ends] - left_over[ends - lengths]


class Codec:
    """``encode(texts)`` gives all ids in one array and the number of ids of each text; ``decode`` gives the texts of such ids."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        if content["decoder"] is not None or content["post_processor"] is not None:
            raise ValueError("only vocabularies whose decoding joins the tokens by blanks")
        self.merges = Merges(content["model"])
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.special_strings = re.compile("|".join(map(re.escape, self.special)))
        names = np.full(max([*self.merges.ids.values(), *self.special.values()]) + 1, "", object)
        for token, i in (self.merges.ids | self.special).items():
            names[i] = token
        self.names = pa.array(names.tolist(), pa.string())
        # symbol of each byte's character, inside a word and at its end
        single = {ord(x): i for x, i in self.merges.ids.items() if len(x) == 1}
        self.inside, self.last = np.full(max(single) + 1, -1), np.full(max(single) + 1, -1)
        for character, i in single.items():
            self.inside[character], self.last[character] = i, self.merges.ids[chr(character) + self.merges.suffix]
        self._forget()

    def _forget(self) -> None:
        self.table = pa.array([], pa.string())
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of all pieces in byte characters, special strings as they are, and the number of words of each piece."""
        odd = [i for i, piece in enumerate(pieces) if "<|" in piece or _OTHER_SPACE.search(piece)]
        if not odd:
            return self._together(pieces)
        plain = np.ones(len(pieces), bool)
        plain[odd] = False
        words, counts = self._together([pieces[i] for i in np.flatnonzero(plain).tolist()])
        each = [self._words_of(pieces[i]) for i in odd]
        total = np.zeros(len(pieces), np.int64)
        total[plain], total[odd] = counts, [len(x) for x in each]
        ends = np.cumsum(total)
        out = [""] * int(ends[-1])
        for i, word in zip(ragged((ends - total)[plain], counts).tolist(), words, strict=True):
            out[i] = word
        for i, found in zip(odd, each, strict=True):
            out[ends[i] - total[i]:ends[i]] = found
        return out, total

    def _together(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The same for pieces without special strings and white space: one call for all, dealt out by the place of their words."""
        normal = self.normalise(" ".join(pieces))
        if not pieces or normal.count(" ") != len(pieces) - 1:
            each = [self._words_of(piece) for piece in pieces]
            return [word for words in each for word in words], np.array([len(words) for words in each], np.int64)
        found = self.split(normal)
        borders = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
        place = np.searchsorted(borders, np.fromiter((span[0] for _, span in found), np.int64, len(found)))
        return [word for word, _ in found], np.bincount(place, minlength=len(pieces))

    def _words_of(self, piece: str) -> list[str]:
        out, at = [], 0
        for found in self.special_strings.finditer(piece):
            out += [word for word, _ in self.split(self.normalise(piece[at:found.start()]))] + [found[0]]
            at = found.end()
        return out + [word for word, _ in self.split(self.normalise(piece[at:]))]

    def _ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, and the number of ids of each."""
        own = [i for i, word in enumerate(words) if word in self.special]
        text = "".join("" if word in self.special else word for word in words) if own else "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lengths[own] = 0
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbols = self.inside[codes]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = self.last[codes[ends]]
        ids, counts = apply_merges(symbols, lengths, self.merges)
        if own:
            places = np.cumsum(counts)[own]
            ids, counts[own] = np.insert(ids, places, [self.special[words[i]] for i in own]), 1
        return ids, counts

    def _learn(self, pieces: pa.Array) -> None:
        words, counts = self._words(pieces.to_pylist())
        coded = pa.array(words, pa.string()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        ids, lengths = self._ids_of_words(coded.dictionary.to_pylist())
        starts = np.cumsum(lengths) - lengths
        of_word = lengths[code]
        total = np.concatenate([[0], np.cumsum(of_word)])
        ends = np.cumsum(counts)
        of_piece = total[ends] - total[ends - counts]
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(of_piece) - of_piece])
        self.lengths = np.concatenate([self.lengths, of_piece])
        self.pool = np.concatenate([self.pool, ids[ragged(starts[code], of_word)].astype(np.uint32)])
        self.table = pa.concat_arrays([self.table, pieces])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = pieces.flatten()
        codes = pc.index_in(flat, value_set=self.table)
        if codes.null_count:
            new = flat.filter(pc.is_null(codes)).unique()
            if len(self.table) + len(new) > MAX_PIECES or len(self.pool) > MAX_POOL:
                self._forget()
                new = flat.unique()
            self._learn(new)
            codes = pc.index_in(flat, value_set=self.table)
        codes = codes.to_numpy()
        lengths = self.lengths[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        return self.pool[ragged(self.starts[codes], lengths)], total[ends] - total[starts]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The texts of runs of ids: their tokens joined by blanks, special ones too."""
        return pc.binary_join(_lists(self.names.take(pa.array(ids)), lengths), " ")


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


Batches = Iterator[pa.RecordBatch]


def _round_trip(name: str, decoded: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        coder = codec(name)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for start, end in run_borders(texts, RUN_BYTES):
                ids, lengths = coder.encode(texts[start:end])
                found = [keys[start:end], _lists(pa.array(ids.astype(np.int32)), lengths)]
                if decoded:
                    found.append(coder.decode(ids, lengths))
                yield pa.RecordBatch.from_arrays(found, ["doc_id", "ids", "decoded"][:len(found)])
    return run


def _decoder(name: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        coder = codec(name)
        for batch in batches:
            ids = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            texts = coder.decode(batch.column("ids").flatten().to_numpy(zero_copy_only=False), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])
    return run


def _digester(name: str) -> Callable[[Batches], Batches]:
    """Number and digest of the ids, digest of the decoded text."""
    round_trip = _round_trip(name, True)

    def run(batches: Batches) -> Batches:
        for batch in round_trip(batches):
            ids = batch.column("ids")
            lengths = pc.list_value_length(ids)
            named = pc.binary_join(_lists(ids.flatten().cast(pa.string()), lengths.to_numpy()), " ")
            digests = [pa.array([sha256(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in (named, batch.column("decoded"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lengths.cast(pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id and the ids of every text."""
    return texts_of(docs).mapInArrow(releasing(_round_trip(name, False)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id and the text of ids in the columns doc_id and ids; no ids, or null, give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(releasing(_decoder(name)), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: ids and decoded texts stay in the task that makes them."""
    return texts_of(docs).mapInArrow(releasing(_digester(name)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
