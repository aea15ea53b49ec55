"""Token ids by the tokenizers library, encoding every distinct piece of text once.

Both public vocabularies split a text into words before they merge bytes, and no word of theirs crosses
the cuts made here, so the ids of the pieces in order are the ids of the whole text (tested against the
library on random texts). A piece is looked up in a table of bounded size; only pieces not in it are encoded.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from docketry.llm.common import ragged

#: Pieces and ids the table of one Python worker may hold before it starts afresh.
MAX_PIECES = 600_000
MAX_POOL = 8_000_000
#: Pieces that the library encodes in one call.
AT_ONCE = 8192

#: Stands between pieces; a text that has it is one piece.
MARK = "\0"
#: White space other than blank and newline, and the mark.
_OTHER_SPACE = "\0\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_ANY_SPACE = re.compile(r"\s")


def byte_level_cuts(text: str) -> str:
    """The text with a mark before a single space and around a single newline between visible characters.

    The word pattern lets a word begin with one space and never end with white space after a visible
    character, so these places are always borders of words. Texts with other white space are cut only
    before a space that stands alone.
    """
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text \
            or any(space in text for space in _OTHER_SPACE):
        return MARK.join(_SAFE_SPACE.split(text))
    return text.replace(" ", MARK + " ").replace("\n", MARK + "\n" + MARK)


def blank_free_cuts(text: str) -> str:
    """For vocabularies that drop white space: every blank and newline is a cut."""
    return text.replace("\n", MARK).replace(" ", MARK)


#: Cuts, and a string that divides pieces when many are encoded in one call: its id appears in no other way,
#: since pieces with white space inside or with a special string are encoded by themselves.
CUTS = {"byte_bpe_50k.json": (byte_level_cuts, "\n"), "word_bpe_49k.json": (blank_free_cuts, "<|endoftext|>")}

_WORKER: dict[tuple, Encoder] = {}


def encoder(name: str, path: str | None = None) -> Encoder:
    """One encoder, with its table of pieces, for all tasks of a Python worker."""
    if (name, path) not in _WORKER:
        _WORKER[name, path] = Encoder(name, path)
    return _WORKER[name, path]


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives all ids in one array and the number of ids of each text."""

    def __init__(self, name: str, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.cut, self.divider = CUTS[name]
        (self.divider_id,) = self.library.encode(self.divider, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.table = pa.array([], pa.string())
        self.again = np.zeros(0, bool)  # met in a later call than the first
        self.starts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep the pieces that came back; start afresh if these alone fill half of the table."""
        kept = np.flatnonzero(self.again)
        lengths = self.lengths[kept]
        if len(kept) > MAX_PIECES // 2 or lengths.sum() > MAX_POOL // 2:
            self._clear()
            return
        self.table = self.table.take(pa.array(kept))
        self.pool = self.pool[ragged(self.starts[kept], lengths)]
        self.starts, self.lengths = (np.cumsum(lengths) - lengths).astype(np.int32), lengths
        self.again = np.zeros(len(kept), bool)

    def _learn(self, pieces: list[str]) -> pa.Array:
        """Add pieces to the table; returns them in the order in which they were added."""
        plain = [x for x in pieces if x and not x.isspace() and "<|" not in x and not _ANY_SPACE.search(x, 1)]
        odd = list(set(pieces).difference(plain))
        found = [self._together(plain[i:i + AT_ONCE]) for i in range(0, len(plain), AT_ONCE)]
        found += [self._one_by_one(odd[i:i + AT_ONCE]) for i in range(0, len(odd), AT_ONCE)]
        lengths = np.concatenate([n for _, n in found])
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        self.starts = np.concatenate([self.starts, starts]).astype(np.int32)
        self.lengths = np.concatenate([self.lengths, lengths]).astype(np.int32)
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in found)])
        new = pa.array([*plain, *odd], pa.string())
        self.table = pa.concat_arrays([self.table, new])
        return new

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces encoded in one call, and how many each has."""
        ids = np.array(self.library.encode_batch_fast([self.divider.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        own = ids != self.divider_id
        marks = np.flatnonzero(~own)
        if len(marks) != len(pieces) - 1:  # the divider's id inside a piece
            return self._one_by_one(pieces)
        return ids[own], np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table place of every piece, and the number of pieces of each text."""
        if any(MARK in text for text in texts):
            cut = [[text] if MARK in text else self.cut(text).split(MARK) for text in texts]
        else:
            cut = None
        pieces = pa.array(cut, pa.list_(pa.string())) if cut else pc.split_pattern(pa.array([self.cut(text) for text in texts], pa.string()), MARK)
        flat = pieces.flatten()
        codes = self._look_up(flat, self.table)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = flat.take(pa.array(missing)).unique()
            if len(self.table) + len(new) > MAX_PIECES or len(self.pool) > MAX_POOL:
                self._forget()
                codes = self._look_up(flat, self.table)
                missing = np.flatnonzero(codes < 0)
                new = flat.take(pa.array(missing)).unique()
        self.again[codes[codes >= 0]] = True
        if len(missing):
            first = len(self.table)
            new = self._learn(new.to_pylist())
            codes[missing] = first + self._look_up(flat.take(pa.array(missing)), new)
        return codes, pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    @staticmethod
    def _look_up(pieces: pa.Array, table: pa.Array) -> np.ndarray:
        """Place of each piece in the table, -1 if it is not there."""
        return pc.fill_null(pc.index_in(pieces, value_set=table), -1).to_numpy().copy()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, n_pieces = self._codes(texts)
        lengths = self.lengths[codes]
        return self.pool[ragged(self.starts[codes], lengths)], _sums(lengths, n_pieces)

    def count(self, texts: list[str]) -> np.ndarray:
        codes, n_pieces = self._codes(texts)
        return _sums(self.lengths[codes], n_pieces)


def _sums(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(runs)
    return total[ends] - total[ends - runs]
