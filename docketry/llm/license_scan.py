"""Licence scan: phrases, and an exact set-similarity join of text blocks with licence templates.

A block is a line, a whole hard-wrapped paragraph, or a run of consecutive lines, wrapped however: comment marks, empty
lines and carriage returns hold no words. Of the runs those are taken that hold a template and no shorter such run, grown to
the lines around them that hold more of it. A run of several lines has at most ``SLACK`` times as many distinct words as
the template, so that words strewn over a long text are no notice; lines and paragraphs may have any number. Tokens of the templates are ordered by the
number of documents that hold them, the rarest first, counted over all documents. A block can hold ``CONTAINMENT``
of a template only if it has one of the template's first (size - needed + 1) tokens (prefix filter), at least as many
tokens as needed (length filter), and enough tokens left behind the first common one on both sides (positional
filter); what passes is counted exactly. The templates are fixed values, so their prefixes fit into every task.

Defined results: a null or empty text has no words and no blocks; a block has each token once however often it repeats;
repeated rows have a line each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import releasing, texts_of
from docketry.llm.decontamination import words
from docketry.llm.license_values import PHRASES, TEMPLATES

CONTAINMENT = 0.9
#: Lines of a hard-wrapped paragraph are about this long, but for the last.
WRAPPED = range(50, 101)
#: A run of several lines has at most so many times the words of the template, distinct ones on both sides.
SLACK = 2

RESULT = "doc_id long, n_words long, places array<struct<label:string,word:long>>, blocks array<struct<label:string,line:int,containment:double>>"
_LINE_END = re.compile(r"\r\n|\r|\n")
_BLANK_LINE = re.compile(r"\n[ \t]*\n")


class Templates:
    """Token sets in the global order, and the templates listed under each token of their prefixes."""

    def __init__(self, frequency: dict[bytes, int], threshold: float = CONTAINMENT):
        order = lambda token: (frequency.get(token, 0), token)
        self.sets = [(label, sorted(set(words(text)), key=order)) for label, text in TEMPLATES]
        self.needed = [max(1, ceil(threshold * len(tokens) - 1e-9)) for _, tokens in self.sets]
        self.rank = {token: i for i, token in enumerate(sorted(vocabulary(), key=order))}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for number, ((_, tokens), needed) in enumerate(zip(self.sets, self.needed, strict=True)):
            for place, token in enumerate(tokens[:len(tokens) - needed + 1]):
                self.prefix.setdefault(token, []).append((number, place))
        self.rare = frozenset(self.prefix)

    def match(self, block: set[bytes]) -> list[tuple[str, float]]:
        """Label and containment of every template that the block holds."""
        if self.rare.isdisjoint(block):
            return []
        known = sorted(block.intersection(self.rank), key=self.rank.__getitem__)
        tried, found = set(), []
        for i, token in enumerate(known):
            for number, place in self.prefix.get(token, ()):
                label, tokens = self.sets[number]
                if number in tried or len(block) < self.needed[number]:
                    continue
                tried.add(number)  # the first common token of the two: nothing before it is shared
                if min(len(known) - i, len(tokens) - place) < self.needed[number]:
                    continue
                shared = sum(t in block for t in tokens)
                if shared >= self.needed[number]:
                    found.append((label, shared / len(tokens)))
        return found


def vocabulary() -> set[bytes]:
    return {token for _, text in TEMPLATES for token in words(text)}


def wrapped_paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(number of its first line, paragraph)."""
    line = 0
    for paragraph in _BLANK_LINE.split(_LINE_END.sub("\n", text)):
        lines = paragraph.split("\n")
        if len(lines) > 1 and all(len(x) in WRAPPED for x in lines[:-1]):
            yield line, paragraph
        line += len(lines) + 1


def blocks_of(text: str, templates: Templates) -> list[tuple[str, int, float]]:
    """Label, number of the first line and containment of every block, in the order of templates and lines."""
    lines = [set(words(line)) for line in _LINE_END.split(text)]
    places: dict[bytes, list[int]] = {}
    for number, line in enumerate(lines):
        for token in line.intersection(templates.rank):
            places.setdefault(token, []).append(number)
    out = []
    for (label, tokens), needed in zip(templates.sets, templates.needed, strict=True):
        if sum(token in places for token in tokens) >= needed:
            own = set(tokens)
            shared = [line & own for line in lines]
            out += [(label, start, share) for start, share in _runs(lines, shared, len(tokens), needed)]
    # a paragraph whose template is strewn over more words than a run may have
    known = {(label, start) for label, start, _ in out}
    out += [(label, line, share) for line, body in wrapped_paragraphs(text) for label, share in templates.match(set(words(body))) if (label, line) not in known]
    return out


def _runs(lines: list[set[bytes]], shared: list[set[bytes]], size: int, needed: int) -> list[tuple[int, float]]:
    """First line and containment of the grown runs."""
    found: dict[tuple[int, int], float] = {}
    for first, end in shortest_runs(lines, shared, size, needed):
        held, every = set().union(*shared[first:end + 1]), set().union(*lines[first:end + 1])
        for step in (-1, 1):
            at, beside = first - 1 if step < 0 else end + 1, every
            while len(held) < size and 0 <= at < len(lines) and len(beside := beside | lines[at]) <= SLACK * size:
                if shared[at] - held:  # lines that add nothing may lie between
                    first, end, held, every = min(first, at), max(end, at), held | shared[at], beside
                at += step
        found[first, end] = len(held) / size
    return [(first, share) for (first, _), share in found.items()]


def shortest_runs(lines: list[set[bytes]], shared: list[set[bytes]], size: int, needed: int) -> list[tuple[int, int]]:
    """First and last line of the runs that hold ``needed`` of the template's tokens and hold no shorter such run."""
    found: list[tuple[int, int]] = []
    counts: dict[bytes, int] = {}
    start = 0
    for end, line in enumerate(shared):
        for token in line:
            counts[token] = counts.get(token, 0) + 1
        while len(counts) >= needed:
            first = start
            for token in shared[start]:
                counts[token] -= 1
                if not counts[token]:
                    del counts[token]
            start += 1
            if len(counts) < needed and (first == end or len(set().union(*lines[first:end + 1])) <= SLACK * size):
                found.append((first, end))
    return found


def phrase_places(found: list[bytes]) -> list[tuple[int, str]]:
    """Start and label of every place of a phrase, in text order."""
    phrases = [(phrase.encode().split(), label) for phrase, label in PHRASES]
    last = {phrase[-1] for phrase, _ in phrases}
    return [(i - len(phrase) + 1, label) for i, word in enumerate(found) if word in last
            for phrase, label in phrases if i + 1 >= len(phrase) and found[i - len(phrase) + 1:i + 1] == phrase]


def _token_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = vocabulary()
    counts = dict.fromkeys(known, 0)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for token in known.intersection(words(text)):
                counts[token] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])


def _scanner(frequency: dict[bytes, int]):
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("line", pa.int32()), ("containment", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(frequency)
        for batch in batches:
            counts, places, blocks = [], [], []
            for text in batch.column("text").to_pylist():
                found = words(text)
                counts.append(len(found))
                places.append([{"label": label, "word": i} for i, label in phrase_places(found)] if b"license" in found else [])
                blocks.append([] if templates.rare.isdisjoint(found) else [
                    {"label": label, "line": line, "containment": share} for label, line, share in blocks_of(text, templates)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(blocks, block)],
                ["doc_id", "n_words", "places", "blocks"])
    return scan


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all places of the phrases, all blocks that hold a template."""
    read = texts_of(docs)
    counted = read.select("text").mapInArrow(releasing(_token_counter), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {bytes(row["token"]): row["n"] for row in counted.collect()}  # one row for each token of the templates
    return read.mapInArrow(releasing(_scanner(frequency)), RESULT)


def summary(found: DataFrame) -> DataFrame:
    """Counts, borders, labels and score of each document. The score is 1 with a phrase, else the best containment."""
    starts = F.transform("places", lambda x: x["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    every = F.array_sort(F.array_union(base, F.transform("blocks", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))
