"""String expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import values as V

# Java's \s knows ASCII blanks only; the source texts also hold full-width ones.
BLANK = r"[\s\x1c-\x1f\x85\xa0  -     　]"
CJK = "[一-鿿]"


# separators no text of the domain holds
_UNIT, _PAIR = "\x1f", "\x1e"


def lits(items: Sequence[str]) -> Column:
    """Array of constants. One foldable call instead of one per item keeps plans small."""
    return F.split(F.lit(_UNIT.join(items)), _UNIT)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def groups(hit: Column, pattern: str, count: int) -> Column:
    """All capture groups of a full match as one array, with a single run of the pattern."""
    return F.split(F.regexp_replace(hit, pattern, "\t".join(f"${i}" for i in range(1, count + 1))), "\t", -1)


def lit_map(mapping: dict) -> Column:
    if all(isinstance(part, str) for pair in mapping.items() for part in pair):
        text = _UNIT.join(f"{key}{_PAIR}{value}" for key, value in mapping.items())
        return F.str_to_map(F.lit(text), F.lit(_UNIT), F.lit(_PAIR))
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def wide_blanks(pattern: str) -> str:
    """The pattern with every blank class widened to the blanks the source texts hold."""
    return pattern.replace(r"\s", BLANK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def is_filled(text: Column) -> Column:
    """Something else than blanks stands in the text."""
    return text.rlike("[^" + BLANK[1:])


def squeeze(text: Column) -> Column:
    """Every blank run becomes one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def drop_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANK + "+", "")


def ascii_digits(text: Column) -> Column:
    # looking for other digits is far cheaper than translating every character
    return F.when(text.rlike(f"[{V.FULLWIDTH_DIGITS}]"), F.translate(text, V.FULLWIDTH_DIGITS, V.ASCII_DIGITS)).otherwise(text)


def fill(template: str, *values: Column) -> Column:
    """The template with a value for each %s, null as 'null' like ``format_string``, without a formatter for every row."""
    parts = template.split("%s")
    if len(parts) != len(values) + 1:
        raise ValueError(f"{len(values)} values for {template!r}")
    pieces = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:], strict=True):
        pieces += [F.coalesce(value.cast("string"), F.lit("null")), F.lit(after)]
    return F.concat(*pieces)


def unify_variants(text: Column) -> Column:
    return F.translate(text, V.VARIANTS_FROM, V.VARIANTS_TO)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(word) for word in words))


def words_found(text: Column, words: Sequence[str]) -> Column:
    return F.filter(lits(words), lambda word: F.contains(text, word))


def summarize(text: Column, limit: int) -> Column:
    return bind(squeeze(F.coalesce(text, F.lit(""))), lambda flat: F.when(
        F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat))


def last_segment(path: Column) -> Column:
    """The part after the last slash, trailing slashes ignored; '' for a missing path."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*\z", 1)


def normalize_text(text: Column) -> Column:
    """Undo layout damage: digits split over lines, blank runs, empty-line runs."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(out, rf"(?<=\d){BLANK}*\n{BLANK}*(?=\d)", "")
    out = F.regexp_replace(out, "[ \t　]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return strip(out)


def section_after(text: Column, markers: Sequence[str]) -> Column:
    """Text after the first marker present (in list order) up to the next empty line; '' if none."""
    tail = F.lit("")
    for marker in reversed(markers):
        after = F.substr(text, F.locate(marker, text) + F.lit(len(marker)))
        cut = strip(F.substring_index(F.regexp_replace(after, "^[：: 　\n]+", ""), "\n\n", 1))
        tail = F.when(F.contains(text, F.lit(marker)), cut).otherwise(tail)
    return tail


def safe_stem(name: Column) -> Column:
    return F.left(F.regexp_replace(name, r"(?U)[^\w.\-]+", "_"), F.lit(V.STEM_LIMIT))


def clean_source_law(raw: Column) -> Column:
    return F.left(unify_variants(drop_blanks(raw)), F.lit(V.SOURCE_LAW_LIMIT))


def document_number(text: Column) -> Column:
    """First document number; leading connective words go while two prefix characters stay."""
    raw = F.replace(F.regexp_extract(text, V.DOC_NO_PATTERN, 1), F.lit(" "), F.lit(""))
    # the look-ahead keeps two prefix characters
    return F.regexp_replace(raw, rf"^[{V.DOC_NO_LEADING}]*(?={CJK}{{2,}}字第)", "")


def penalty_amount(text: Column) -> Column:
    """First amount of at least a thousand, or given in ten-thousands."""
    hits = F.regexp_extract_all(ascii_digits(text), F.lit(V.AMOUNT_PATTERN), F.lit(0))
    amounts = F.transform(hits, lambda hit: bind(groups(hit, V.AMOUNT_PATTERN, 2), lambda g: F.struct(
        F.replace(g[0], F.lit(","), F.lit("")).try_cast("bigint").alias("number"), (g[1] != "").alias("large"))))
    kept = F.filter(amounts, lambda a: a["number"].isNotNull() & (a["large"] | (a["number"] >= V.AMOUNT_FLOOR)))
    return bind(F.get(kept, F.lit(0)), lambda a: a["number"] * F.when(a["large"], V.AMOUNT_TEN_THOUSAND).otherwise(1))


def fenced_json(reply: Column) -> Column:
    """The object inside a code fence, else the stripped reply."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.coalesce(blank_to_null(inner), strip(reply))


def braced_json(reply: Column) -> Column:
    """From the first opening brace to the last closing one; null when there is no such pair."""
    return blank_to_null(F.regexp_extract(reply, r"(?s)\{.*\}", 0))


def split_claims(reasons: Column) -> Column:
    """Numbered items of the grounds, else its sentences, as array<struct<claim_id, summary, quote>>."""
    number = r"(?:^|\n)" + BLANK + r"*(?:[一二三四五六七八九十]+[、.．)）]|[（(][一二三四五六七八九十]+[)）]|[0-9]+[、.．)）])" + BLANK + "*"

    def pieces(text: Column, pattern: str) -> Column:
        return F.filter(F.transform(F.split(text, pattern, -1), strip), lambda part: part != "")

    def parts(text: Column) -> Column:
        def by_sentence() -> Column:
            return bind(pieces(text, "[。；]" + BLANK + "*"),
                        lambda found: F.when((F.size(found) == 0) & (text != ""), F.array(text)).otherwise(found))

        return bind(pieces(text, number), lambda found: F.when(F.size(found) > 1, found).otherwise(by_sentence()))

    return F.transform(bind(strip(F.coalesce(reasons, F.lit(""))), parts), lambda part, i: F.struct(
        F.concat(F.lit("C"), (i + 1).cast("string")).alias("claim_id"),
        F.when(F.length(part) <= 60, part).otherwise(F.concat(F.left(part, F.lit(57)), F.lit("…"))).alias("summary"),
        part.alias("quote"),
    ))
