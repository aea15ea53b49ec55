"""Keyword scores and rule chains over one text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions.text import bind, contains_any, words_found


def keyword_label(text: Column, table: dict, bonus: int, default) -> Column:
    """Struct<label, score, words> of the class with the highest score, the first listed one on a tie.

    A score counts the distinct keywords found, plus a bonus for the first keyword (the statute
    name). The default label stands where nothing is found.
    """
    def scored(i: int, label, words: list[str]) -> Column:
        return bind(words_found(text, words), lambda hits: F.struct(
            (F.size(hits) + F.when(F.array_contains(hits, words[0]), bonus).otherwise(0)).alias("score"),
            F.lit(-i).alias("order"), F.lit(label).alias("label"), hits.alias("words")))

    classes = F.array(*[scored(i, label, words) for i, (label, words) in enumerate(table.items())])
    return bind(F.array_max(classes), lambda best: F.struct(
        F.when(best["score"] == 0, default).otherwise(best["label"]).alias("label"), best["score"].alias("score"), best["words"].alias("words")))


def ruling_kind(text: Column) -> Column:
    """Direction of a ruling; inadmissible wins over revoke, revoke over dismiss."""
    chain = None
    for kind, word in V.RULING_WORDS.items():
        test = F.contains(text, F.lit(word))
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain


def normalized_disposition(text: Column) -> Column:
    kind = ruling_kind(text)
    return F.when(kind == "inadmissible", V.INADMISSIBLE).when(kind == "revoke", V.REVOKE).when(kind == "dismiss", V.DISMISS)


def disposition_of(meta: Column, text: Column) -> Column:
    """Disposition label from the metadata, else from the head of the text, else ''."""
    def chain(source: Column, otherwise: Column) -> Column:
        out = otherwise
        for label, word in reversed(V.DISPOSITION_PATTERNS):
            out = F.when(F.contains(source, F.lit(word)), label).otherwise(out)
        return out

    head = F.left(F.coalesce(text, F.lit("")), F.lit(V.DISPOSITION_HEAD))
    return chain(F.coalesce(meta, F.lit("")), chain(head, F.lit("")))


def year_of(meta: Column, text: Column) -> Column:
    found = F.regexp_extract(F.left(text, F.lit(V.YEAR_HEAD)), V.YEAR_PATTERN, 1).try_cast("int")
    return F.coalesce(meta.try_cast("int"), found)


def clause_number(raw: Column) -> Column:
    """Clause digits of '77-2', '77(2)' or '2', null when no template knows them."""
    after = F.regexp_extract(raw, r"77\s*[-(（]?\s*(\d+)", 1)
    number = F.when(raw.rlike(r"77\s*[-(（]?\s*\d"), after).otherwise(F.regexp_extract(raw, r"(\d+)", 1))
    return F.when(number.isin(list(V.CLAUSE_TEMPLATES)), number)


def has_all(text: Column, *words: str) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found & F.contains(text, F.lit(word))
    return found


__all__ = ["keyword_label", "ruling_kind", "normalized_disposition", "disposition_of",
           "year_of", "clause_number", "has_all", "contains_any"]
