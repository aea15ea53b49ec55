"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass over a text;
local parsers expand from each anchor to both sides and validate what they find. The spans of the four base kinds
are exactly the leftmost, non-overlapping matches of their patterns that pass validation. Two kinds are added:
``address`` (a scheme with a user part before the host) and ``account`` (an access key or an account number
after its cue; account numbers that begin with two letters must pass the check of ISO 7064 mod 97-10).

Spans count code points, the end is exclusive. Defined results: a null or empty text has no spans; each row of the
input has a row in the result, repeated ones too; an empty table gives an empty result; whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import releasing, texts_of

KINDS = ["email", "ip", "card", "phone", "address", "account"]
SPANS = "spans array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_IN_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LETTER = re.compile(r"[A-Za-z]")
_USER = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+[^\s\"'<>]*")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_NUMBER = re.compile(r"[^0-9A-Za-z\n]{0,3}(?:(?:number|no|nr)\b[^0-9A-Za-z\n]{0,3})?((?:[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}|[0-9](?:[ -]?[0-9]){5,17}))(?![0-9A-Za-z])")

#: Cues before account numbers, and anchors of the other kinds.
CUES = ["iban", "IBAN", "account", "Account", "acct", "Acct"]
ANCHORS = ["@", "+", "://", "AKIA", *"0123456789", *CUES]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor in ANCHORS:
        found.add_word(anchor, anchor)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod_97(number: str) -> bool:
    """Two letters and two check digits first: moved to the end, letters as 10..35, the whole leaves 1."""
    turned = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed in KINDS, then by start."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    after = dict.fromkeys(KINDS, 0)  # where the next match of each kind may begin
    for last, anchor in anchors.iter(text):
        at = last - len(anchor) + 1
        if anchor.isdigit():
            if at >= after["ip"]:
                if match := _IP.match(text, at):
                    after["ip"] = match.end()
                    if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
                        spans["ip"].append(match.span())
                else:
                    after["ip"] = _DIGITS.match(text, at).end()
            if at >= after["card"]:
                match = _CARD.match(text, at)
                after["card"] = match.end() if match else at + 1
                if match and len(match[0]) >= 13:
                    digits = _NO_DIGIT.sub("", match[0])
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(match.span())
        elif anchor == "@":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (match := _DOMAIN.match(text, at + 1)):
                spans["email"].append((start, match.end()))
                after["email"] = match.end()
        elif anchor == "+":
            if match := _PHONE.match(text, at):
                if 9 <= len(_NO_DIGIT.sub("", match[0])) <= 15:
                    spans["phone"].append(match.span())
        elif anchor == "://":
            start = at
            while start > after["address"] and text[start - 1] in _IN_SCHEME:
                start -= 1
            # a scheme begins with a letter
            head = _LETTER.search(text, start, at)
            if head and (match := _USER.match(text, at + 3)):
                end = match.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                spans["address"].append((head.start(), end))
                after["address"] = end
        elif anchor == "AKIA":
            match = _KEY.match(text, at)
            if match and at >= after["account"] and not (at and text[at - 1].isalnum()):
                spans["account"].append(match.span())
                after["account"] = match.end()
        elif at >= after["account"] and not (at and text[at - 1].isalnum()) and (match := _NUMBER.match(text, last + 1)):
            number = match[1].replace(" ", "")
            if number[0].isdigit() or len(number) <= 34 and mod_97(number):
                spans["account"].append(match.span(1))
                after["account"] = match.end()
    return [(kind, start, end) for kind in KINDS for start, end in spans[kind]]


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text, anchors)] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row."""
    return texts_of(docs).mapInArrow(releasing(_finder), f"doc_id long, {SPANS}")


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _masker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        done = [text if text is None or not (found := find_spans(text, anchors)) else masked_text(text, found) for text in texts]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with personal data in the column ``text`` masked. A null text stays null."""
    return docs.mapInArrow(releasing(_masker), docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans in one string, from the output of ``spans_of``."""
    base = F.filter("spans", lambda x: x["kind"].isin(KINDS[:4]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
