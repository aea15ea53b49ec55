"""Law citations inside texts. All of it is evaluated per row, without a join or a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions.law_names import LawNames, resolve_by_table
from docketry.functions.text import (
    BLANK, CJK, ascii_digits, bind, blank_to_null, drop_blanks, groups, lits, strip, unify_variants,
)


# A citation is a run of characters that ends at a section sign or an article number. Looking at the
# run once rules out most start positions before the lazy pattern is tried there.
_SCAN = rf"(?={CJK}{{2,25}}+\s*(?:§|第?\s*\d))" + V.CITATION_PATTERN


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _cut_lead_words(law: Column) -> Column:
    """What follows the last lead word, as long as two characters remain."""
    def cut(backwards: Column) -> Column:
        ends = F.transform(lits([word[::-1] for word in V.LAW_LEAD_WORDS]), lambda word: bind(
            F.position(word, backwards), lambda at: F.when(at > 2, F.length(law) - at + 1).otherwise(0)))
        return F.substr(law, F.array_max(ends) + 1)

    return bind(F.reverse(law), cut)


def _resolve(law: Column) -> Column:
    # the leftmost match that reaches the end is the longest registered suffix
    registered = F.regexp_extract(law, _one_of(V.REGISTERED_LAWS) + r"\z", 0)
    first_char_lost = F.get(
        F.filter(lits([name for name in V.REGISTERED_LAWS if len(name) >= 5]),
                 lambda name: F.endswith(law, F.substring(name, 2, 100))), F.lit(0))
    pronoun = F.regexp_extract(law, _one_of(V.PRONOUN_LAWS) + r"\z", 0)
    unregistered = F.coalesce(first_char_lost, bind(pronoun, blank_to_null), _cut_lead_words(law))
    return bind(registered, lambda name: F.when(name != "", name).otherwise(unregistered))


def resolve_law(raw: Column) -> Column:
    """Proper law name of a captured name, which may carry subject and verb in front."""
    return bind(unify_variants(drop_blanks(F.coalesce(raw, F.lit("")))), _resolve)


def resolve_laws(rows: DataFrame, column: str, laws: DataFrame) -> DataFrame:
    """``rows`` with ``law``: names in ``column`` resolved against a table of laws (place, law) instead of the fixed list; null and empty names give ''."""
    settled = rows.withColumn("_settled", unify_variants(drop_blanks(F.coalesce(F.col(column), F.lit("")))))
    return resolve_by_table(settled, "_settled", laws, _cut_lead_words(F.col("_settled"))).drop("_settled")


def _number(digits: Column) -> Column:
    """Digits without leading zeros."""
    return bind(F.ltrim(digits, F.lit("0")), lambda n: F.when((n == "") & (digits != ""), "0").otherwise(n))


def citation_text(law: Column, article: Column, sub: Column) -> Column:
    """Numbers come without leading zeros; an empty or missing sub-article adds nothing."""
    return F.concat(law, F.lit("第"), article, F.lit("條"), F.when(F.coalesce(sub, F.lit("")) != "", F.concat(F.lit("之"), sub)).otherwise(""))


def _parts(hit: Column) -> Column:
    """Struct of a citation from the matched text; the five groups are law, §-form and article form."""
    def numbers(g: Column) -> Column:
        return F.struct(bind(unify_variants(g[0]), _resolve).alias("law"), _number(F.concat(g[1], g[3])).alias("article"),
                        _number(F.concat(g[2], g[4])).alias("sub"))

    return bind(bind(groups(hit, V.CITATION_PATTERN, 5), numbers), lambda p: F.struct(
        p["law"].alias("law"), p["article"].alias("article"), blank_to_null(p["sub"]).alias("sub_article"),
        citation_text(p["law"], p["article"], p["sub"]).alias("citation")))


def _is_named(part: Column) -> Column:
    return (part["law"] != "") & ~part["law"].isin(V.PRONOUN_LAWS)


def parse_citation(cite: Column) -> Column:
    """One citation as struct<law, article, sub_article, citation>; null when the text does not start with one."""
    hit = F.regexp_extract(ascii_digits(strip(cite)), "^" + V.CITATION_PATTERN, 0)
    return bind(hit, lambda h: F.when(h != "", bind(_parts(h), lambda part: F.when(_is_named(part), part))))


def normalize_citation(cite: Column) -> Column:
    return parse_citation(cite)["citation"]


# ---- whole texts ------------------------------------------------------------------------------
# One run of the compiled pattern over a text and one fold over what it finds, batch by batch: the time grows with the text,
# and measured against higher-order functions over the same patterns it is several times shorter.

_PART = "struct<law:string,article:string,sub_article:string,citation:string>"
#: texts that are searched in one run are joined by a character that no pattern matches, as far as they hold so many characters
_BETWEEN, _AT_ONCE = "\0", 1 << 20


def _lists(sizes: Iterable[int], flat: pa.Array) -> pa.ListArray:
    """An array of lists from their sizes and what they hold, one after the other."""
    ends = np.cumsum(np.fromiter(sizes, dtype=np.int32), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), flat)


class _Reader:
    """Finds the citations of texts; a law and a citation as written are resolved once for each batch."""

    def __init__(self):
        # blanks and digits of the patterns are the ASCII ones, as in the column expressions
        self.scan, self.parts = re.compile(_SCAN, re.ASCII), re.compile(V.CITATION_PATTERN, re.ASCII)
        self.follow, self.broken = re.compile(V.FOLLOW_ON_PATTERN, re.ASCII), re.compile(V.MALFORMED_PATTERN, re.ASCII)
        self.names = LawNames(V.REGISTERED_LAWS)
        self.only_digits = re.compile(r"\d+", re.ASCII)
        self.edges = re.compile(rf"\A{BLANK}+|{BLANK}+\Z")
        self.wide, self.digits = re.compile(f"[{V.FULLWIDTH_DIGITS}]+"), str.maketrans(V.FULLWIDTH_DIGITS, V.ASCII_DIGITS)
        self.variants = str.maketrans(V.VARIANTS_FROM, V.VARIANTS_TO)
        self.laws: dict[str, str] = {}
        self.known: dict[tuple, dict | None] = {}
        self.articles: dict[tuple[str, str], str | None] = {}

    def plain(self, text: str | None) -> str:
        """The text with ASCII digits. Only runs of other digits are translated: translating every character costs more than all patterns."""
        if not text:
            return ""
        return self.wide.sub(lambda run: run[0].translate(self.digits), text) if any(digit in text for digit in V.FULLWIDTH_DIGITS) else text

    def law(self, raw: str) -> str:
        if raw not in self.laws:
            self.laws[raw] = self.names.resolve(raw.translate(self.variants))
        return self.laws[raw]

    @staticmethod
    def number(digits: str | None) -> str:
        return (digits.lstrip("0") or "0") if digits else ""

    def cite(self, law: str, article: str | None, sub: str | None) -> str:
        return f"{law}第{self.number(article)}條" + (f"之{self.number(sub)}" if sub else "")

    def part(self, match: re.Match) -> dict | None:
        written = match.groups()
        if written not in self.known:
            self.known[written] = self._part(match)
        return self.known[written]

    def _part(self, match: re.Match) -> dict | None:
        law, article, sub = self.law(match[1]), match[2] or match[4], match[3] or match[5]
        if not law or law in V.PRONOUN_LAWS:
            return None
        return {"law": law, "article": self.number(article), "sub_article": self.number(sub) or None, "citation": self.cite(law, article, sub)}

    def placed(self, plain: str) -> list[tuple[int, dict]]:
        """All citations of a text with the offset they end at."""
        found = ((match.end(), self.part(match)) for match in self.scan.finditer(plain))
        return [(end, part) for end, part in found if part]

    def distinct(self, text: str | None) -> list[dict]:
        found: dict[str, dict] = {}
        for _, part in self.placed(self.plain(text)):
            found.setdefault(part["citation"], part)
        return list(found.values())

    def names_of_each(self, texts: list[str | None]) -> Iterator[list[str]]:
        """The distinct citations of every text, in order of first appearance; many short texts are one run of the pattern."""
        first = 0
        while first < len(texts):
            held, last = 0, first
            while last < len(texts) and (last == first or held < _AT_ONCE):
                held += len(texts[last] or "")
                last += 1
            joined = self.plain(_BETWEEN.join([text or "" for text in texts[first:last]]))    # digits keep their places
            found: dict[str, None] = {}
            end, row = len(texts[first] or ""), first
            for match in self.scan.finditer(joined):
                part = self.part(match)
                if part is None:
                    continue
                while match.start() > end:
                    yield list(found)
                    row, found = row + 1, {}
                    end += 1 + len(texts[row] or "")
                found[part["citation"]] = None
            for _ in range(row, last):
                yield list(found)
                found = {}
            first = last

    def names_of(self, text: str | None) -> list[str]:
        return next(self.names_of_each([text]))

    def names_in(self, texts: pa.Array) -> pa.ListArray:
        return self._as_lists(self.names_of_each(texts.to_pylist()))

    @staticmethod
    def _as_lists(rows: Iterable[list[str]]) -> pa.ListArray:
        sizes, flat = [], []
        for row in rows:
            sizes.append(len(row))
            flat += row
        return _lists(sizes, pa.array(flat, pa.string()))

    def followers(self, plain: str, placed: list[tuple[int, dict]]) -> list[str]:
        """Following articles take over the law of the citation that was new last before them, else of the first one."""
        out, seen, law, at = [], set(), placed[0][1]["law"] if placed else "", 0
        for match in self.follow.finditer(plain) if placed else ():
            while at < len(placed) and placed[at][0] <= match.start():
                part = placed[at][1]
                if part["citation"] not in seen:
                    seen.add(part["citation"])
                    law = part["law"]
                at += 1
            out.append(self.cite(law, match[1], match[2]))
        return out

    def normalized(self, cite: str | None) -> str | None:
        match = self.parts.match(self.plain(self.edges.sub("", cite))) if cite is not None else None
        part = self.part(match) if match else None
        return part["citation"] if part else None

    def normalized_each(self, cites: pa.Array) -> pa.Array:
        """Citations are written alike over and over: each way of writing one is read once for each batch."""
        written = cites.dictionary_encode()
        return pa.array([self.normalized(cite) for cite in written.dictionary.to_pylist()], pa.string()).take(written.indices)

    def parsed(self, cites: pa.ListArray) -> pa.ListArray:
        named = self.normalized_each(cites.flatten())
        # sizes of the lists without what did not parse, from the numbers of those that did up to each end
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.fill_null(pc.list_value_length(cites), 0).to_numpy(zero_copy_only=False))])
        good = np.concatenate([np.zeros(1, np.int64), np.cumsum(named.is_valid().to_numpy(zero_copy_only=False))])
        return _lists(np.diff(good[ends]), named.drop_null())

    def listed(self, citation: pa.Array, law: pa.Array, article: pa.Array, *texts: pa.Array) -> pa.ListArray:
        """The whitelist entries of laws: the structured citation; else law and article; else whatever the texts mention."""
        own = self.normalized_each(citation).to_pylist()
        for row, (name, number) in enumerate(zip(law.to_pylist(), article.to_pylist(), strict=True)):
            if own[row] is None and name and number:
                name, number = self.edges.sub("", name), self.edges.sub("", number)
                if name and number:
                    own[row] = self.numbered(name, number)
        rest = [row for row, name in enumerate(own) if name is None]
        mentioned = self.names_of_each([text for row in zip(*(column.take(pa.array(rest, pa.int64())).to_pylist() for column in texts), strict=True) for text in row])
        return self._as_lists([name] if name is not None else [item for _ in texts for item in next(mentioned)] for name in own)

    def numbered(self, law: str, article: str) -> str | None:
        if (law, article) not in self.articles:
            self.articles[law, article] = self.normalized(f"{law}第{article}條" if self.only_digits.fullmatch(article) else law + article)
        return self.articles[law, article]

    def following(self, text: str | None) -> list[str]:
        plain = self.plain(text)
        return self.followers(plain, self.placed(plain))

    def reconciled(self, declared: list | None, text: str | None) -> list[str]:
        plain = self.plain(text)
        placed = self.placed(plain)
        named = [self.normalized(cite) or self.edges.sub("", cite) for cite in declared or [] if cite is not None]
        every = [*named, *(part["citation"] for _, part in placed), *self.followers(plain, placed)]
        return [cite for cite in dict.fromkeys(every) if cite]

    def malformed(self, text: str | None) -> list[str]:
        """Broken article marks with the characters around their start, as they stand in the text."""
        text = text or ""
        starts = [match.start() for match in self.broken.finditer(self.plain(text))]
        return [text[max(0, at - V.MALFORMED_CONTEXT):at + V.MALFORMED_CONTEXT].replace("\n", " ") for at in starts]


def _by_row(method: str, kind: str, *columns: Column) -> Column:
    """``method`` of a reader over the rows of Arrow batches. Built on use: declaring it needs a session."""
    element = pa.list_(pa.struct([(name, pa.string()) for name in ("law", "article", "sub_article", "citation")])) if kind == _PART else pa.list_(pa.string())

    def run(*batches: pa.Array) -> pa.Array:
        reader = _Reader()
        each = getattr(reader, method)
        return pa.array([each(*values) for values in zip(*(batch.to_pylist() for batch in batches), strict=True)], element)

    return _arrow(run, kind, *columns)


def _by_batch(method: str, *columns: Column) -> Column:
    """``method`` of a reader that takes whole Arrow batches and gives lists of citations."""
    def run(*batches: pa.Array) -> pa.Array:
        return getattr(_Reader(), method)(*batches)

    return _arrow(run, "string", *columns)


def _arrow(run, kind: str, *columns: Column) -> Column:
    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def six(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array) -> pa.Array:
        return run(a, b, c, d, e, f)

    return F.arrow_udf({1: one, 2: two, 6: six}[len(columns)], f"array<{kind}>")(*columns)


def extract_citations(text: Column) -> Column:
    """Distinct citations of a text in order of first appearance; pronoun laws are left out."""
    return _by_row("distinct", _PART, text)


def citation_names(text: Column) -> Column:
    """The citations of ``extract_citations`` as texts; their parts are not written out."""
    return _by_batch("names_in", text)


def parsed_citations(cites: Column) -> Column:
    """The citations of an array that parse, normalised; none for a missing array."""
    return _by_batch("parsed", cites)


def listed_citations(citation: Column, law: Column, article: Column, title: Column, text: Column, source: Column) -> Column:
    """Whitelist entries of a recommended law: its structured citation alone; else law and article; else whatever its texts mention, text by text."""
    return _by_batch("listed", citation, law, article, title, text, source)


def malformed_citations(text: Column) -> Column:
    """Broken article marks, each with the characters around its start."""
    return _by_row("malformed", "string", text)


def malformed_count(text: Column) -> Column:
    """Number of broken article marks, 0 for a missing text."""
    return F.coalesce(F.regexp_count(ascii_digits(text), F.lit(V.MALFORMED_PATTERN)), F.lit(0))


def follow_on_citations(text: Column) -> Column:
    """Articles joined to an earlier citation take over the law named last before them."""
    return _by_row("following", "string", text)


def reconcile_cites(declared: Column, text: Column) -> Column:
    """Declared, then written out, then followed-on citations, distinct and in that order."""
    return _by_row("reconciled", "string", declared, text)


def article_citations(law: Column, text: Column) -> Column:
    """Every article number of a text, put under a law name that is known already."""
    hits = F.regexp_extract_all(ascii_digits(text), F.lit(V.ARTICLE_PATTERN), F.lit(0))
    return F.transform(hits, lambda hit: bind(groups(hit, V.ARTICLE_PATTERN, 2), lambda g: citation_text(law, _number(g[0]), _number(g[1]))))
