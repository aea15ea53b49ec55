"""Masking of personal data, pass by pass, as native string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions.text import CJK, bind

_PAD = "[ \t　]"
_LABELS = "(?:" + "|".join(f"{_PAD}*".join(label) for label in V.PARTY_LABELS) + ")"
_LEAD = rf"{_PAD}*(?:\d{{1,3}}{_PAD}+)?"
_PARTY_LINE = rf"(?md)^{_LEAD}{_LABELS}{_PAD}"
_ORPHAN_LINE = rf"\A{_PAD}*(?!(?:{'|'.join(V.SHORT_LINE_WORDS)}){_PAD}*\z){CJK}{{2,4}}{_PAD}*\z"

# name length -> (tail of the pattern, replacement of the tail); first and last characters stay
_NAME_FORMS = [
    (rf"({CJK}){CJK}", "○"),
    (rf"({CJK}){CJK}({CJK})", "○"),
    (rf"({CJK}){CJK}{{2}}({CJK})", "○○"),
]


def _mask_names(text: Column, before: str, after: str) -> tuple[Column, Column]:
    """Mask names of two to four characters between two patterns; gives text and count."""
    count = F.lit(0)
    for size, (name, fill) in enumerate(_NAME_FORMS, start=2):
        skip = f"(?!{'|'.join(V.NOT_NAMES)})" if size == 2 else ""
        pattern = f"{before}{skip}{name}{after}"
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"$1$2{fill}" + ("$3" if size > 2 else ""))
    return text, count


def mask_fixed(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_replace(text, pattern, V.MASK), F.regexp_count(text, F.lit(pattern))


def mask_party_names(text: Column) -> tuple[Column, Column]:
    """Names after a party label at the start of a line."""
    titles = "|".join(V.PARTY_TITLES)
    return _mask_names(text, rf"(?md)^({_LEAD}{_LABELS}{_PAD}{{1,8}})",
                       rf"(?={_PAD}*$|{_PAD}*[（(]|{_PAD}+(?:{titles}))")


def mask_following_names(text: Column) -> tuple[Column, Column]:
    """Names alone on the lines right below a party line.

    The text is cut before every party line and each piece into its lines; names are the lines that follow
    the first one without a break. No pattern spans lines, so a piece may have any number of them.
    """
    pieces = F.split(text, rf"(?={_PARTY_LINE})", -1)

    def masked_line(line: Column) -> Column:
        for name, fill in _NAME_FORMS:
            line = F.regexp_replace(line, rf"\A({_PAD}*){name}({_PAD}*)\z", f"$1$2{fill}" + ("$3$4" if name.count("(") > 1 else "$3"))
        return line

    def one(piece: Column) -> Column:
        lines = F.split(piece, "\n", -1)
        stop = F.array_position(F.transform(F.slice(lines, 2, F.size(lines)), lambda line: line.rlike(_ORPHAN_LINE)), False)
        run = F.when(piece.rlike(_PARTY_LINE.replace("(?md)", "")), F.when(stop > 0, stop - 1).otherwise(F.size(lines) - 1)).otherwise(0)
        return bind(F.struct(lines.alias("lines"), run.cast("int").alias("n")), lambda p: F.struct(
            F.when(p["n"] == 0, piece).otherwise(F.array_join(F.transform(
                p["lines"], lambda line, i: F.when((i >= 1) & (i <= p["n"]), masked_line(line)).otherwise(line)), "\n")).alias("text"),
            p["n"].alias("n")))

    done = F.transform(pieces, one)
    present = text.rlike(_PARTY_LINE)
    masked = F.array_join(F.transform(done, lambda d: d["text"]), "")
    count = F.aggregate(done, F.lit(0), lambda acc, d: acc + d["n"])
    return F.when(present, masked).otherwise(text), F.when(present, count).otherwise(0)


MASK_PASSES = [
    ("n_id", lambda text: mask_fixed(text, V.ID_PATTERN)),
    ("n_address", lambda text: mask_fixed(text, V.ADDRESS_PATTERN)),
    ("n_phone", lambda text: mask_fixed(text, V.MOBILE_PATTERN)),
    ("n_party", mask_party_names),
    ("n_following", mask_following_names),
]


def short_line_suspects(text: Column) -> Column:
    """Lines of two to four characters that may still be names."""
    found = F.regexp_extract_all(text, F.lit(rf"(?md)^{_PAD}*({CJK}{{2,4}}){_PAD}*$"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda name: ~name.isin(V.SHORT_LINE_WORDS)))
