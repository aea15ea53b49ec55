"""Proper names of laws behind a captured name: one walk over a trie of reversed names, or a join with a table of laws."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import values as V

#: a name is recognised without its first character only if at least so many characters are registered
SHORTEST_CLIPPED = 5
#: characters that must remain behind a lead word
LEAST_REST = 2

_REGISTERED, _CLIPPED, _PRONOUN, _LEAD = "registered", "clipped", "pronoun", "lead"


class LawNames:
    """Index of law names in an order of preference, of pronoun names and of lead words, all entered from their last character.

    A captured name is walked backwards once from its end; every node on the way that closes an entry is a suffix that is known.
    """

    def __init__(self, laws: Iterable[str], pronouns: Iterable[str] = V.PRONOUN_LAWS, leads: Iterable[str] = V.LAW_LEAD_WORDS):
        self.root: dict = {}
        for place, law in enumerate(laws):
            self._enter(law, _REGISTERED, (place, law))
            if len(law) >= SHORTEST_CLIPPED:
                self._enter(law[1:], _CLIPPED, (place, law))
        for kind, words in ((_PRONOUN, pronouns), (_LEAD, leads)):
            for word in words:
                self._enter(word, kind, (0, word))

    def _enter(self, word: str, kind: str, entry: tuple[int, str]) -> None:
        node = self.root
        for char in reversed(word):
            node = node.setdefault(char, {})
        node.setdefault(kind, entry)     # of entries with the same characters the first one counts

    def _suffixes(self, name: str, end: int):
        """Nodes of the known suffixes of ``name[:end]``, shortest first."""
        node = self.root
        for at in range(end - 1, -1, -1):
            node = node.get(name[at])
            if node is None:
                return
            yield node

    def resolve(self, name: str) -> str:
        """Longest registered suffix; else the first law that lost its first character; else the longest pronoun; else what follows the lead words."""
        best: dict[str, tuple[int, str]] = {}
        for node in self._suffixes(name, len(name)):
            for kind in (_REGISTERED, _PRONOUN):
                if kind in node:
                    best[kind] = node[kind]
            if _CLIPPED in node:
                best[_CLIPPED] = min(best.get(_CLIPPED, node[_CLIPPED]), node[_CLIPPED])
        for kind in (_REGISTERED, _CLIPPED, _PRONOUN):
            if kind in best:
                return best[kind][1]
        return self._behind_lead_words(name)

    def _behind_lead_words(self, name: str) -> str:
        """Ends of lead words from right to left; a word counts where it stands last."""
        too_late: set[str] = set()
        for end in range(len(name), 0, -1):
            here = {node[_LEAD][1] for node in self._suffixes(name, end) if _LEAD in node} - too_late
            if here and len(name) - end >= LEAST_REST:
                return name[end:]
            too_late |= here
        return name


def resolve_by_table(rows: DataFrame, column: str, laws: DataFrame, fallback: Column) -> DataFrame:
    """``rows`` with a column ``law``: the name in ``column`` resolved against a table of any number of laws.

    ``laws``: place (order of preference, unique), law. The same rules as ``LawNames``; ``fallback`` gives the name where no
    entry is a suffix (null or empty names have none). Distinct names are cut into suffixes no longer than the longest law and joined by
    equality with the forms of the laws; a name that is asked for very often is looked up once, and the least (rule, rank) of its
    hits is taken by an aggregation that combines on the map side. Repeated laws and null laws change nothing.
    """
    known = laws.filter(F.col("law") != "").groupBy("law").agg(F.min("place").cast("long").alias("place"))
    size = F.length("law").cast("long")
    pronouns = rows.sparkSession.createDataFrame([(p,) for p in V.PRONOUN_LAWS], "law string")
    forms = known.select(F.col("law").alias("form"), "law", F.struct(F.lit(0).alias("rule"), (-size).alias("rank")).alias("order")) \
        .unionByName(known.filter(size >= SHORTEST_CLIPPED).select(
            F.substr("law", F.lit(2)).alias("form"), "law", F.struct(F.lit(1).alias("rule"), F.col("place").alias("rank")).alias("order"))) \
        .unionByName(pronouns.select(F.col("law").alias("form"), "law", F.struct(F.lit(2).alias("rule"), (-size).alias("rank")).alias("order")))
    shortest, longest = forms.agg(F.min(F.length("form")), F.max(F.length("form"))).head()
    asked = rows.select(F.col(column).alias("asked")).filter(F.col("asked") != "").distinct()
    lengths = F.when(F.length("asked") >= shortest, F.sequence(F.lit(shortest), F.least(F.length("asked"), F.lit(longest))))
    cut = asked.select("asked", F.explode(lengths).alias("n")).select("asked", F.expr("right(asked, n)").alias("form"))
    found = cut.join(forms, "form").groupBy("asked").agg(F.min_by("law", "order").alias("found"))
    return rows.join(found, F.col(column) == F.col("asked"), "left").select(
        *[rows[c] for c in rows.columns], F.coalesce("found", fallback).alias("law"))
