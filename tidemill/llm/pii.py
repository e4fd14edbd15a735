"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words move the score.

Kinds `email`, `ip`, `card` and `phone` are the base kinds: their spans always stay, whatever their
score. `iban` (mod-97), `ssn` (three-part number) and `secret` (a run of 20 or more letters and digits, as in
access tokens), the last two only with a context word, are added where their score reaches the threshold. Matches of a kind are leftmost and do not overlap; kinds may overlap.

Spans are in code points, end exclusive. Null or empty text has no spans. Repeated rows and ids get a row each, null ids are
kept; an input column under the name of a result is left out by detect and kept by redact; an empty table gives no rows. Time is linear in the text:
each pattern is anchored so that a failed attempt is not repeated from inside the same run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kernels import slices, text_column

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"

#: Code points before and after a span that are searched for context words.
CONTEXT = 40
THRESHOLD = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


class Rule(NamedTuple):
    """score without context; added for a context word nearby."""

    score: float
    boost: float
    words: re.Pattern


def _words(*words: str) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(words) + r")(?!\w)", re.I)


RULES = {
    "email": Rule(0.9, 0.1, _words("e-?mail", "mail", "contact", "kontakt", "correo", "courriel", "write to")),
    "ip": Rule(0.5, 0.3, _words("ip", "address", "host", "server", "login", "from", "adresse")),
    "card": Rule(0.6, 0.4, _words("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta")),
    "phone": Rule(0.6, 0.4, _words("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
    "iban": Rule(0.8, 0.2, _words("iban", "bank", "account", "konto", "compte", "cuenta")),
    "ssn": Rule(0.3, 0.4, _words("ssn", "social security", "tax id", "taxpayer", "national id")),
    "secret": Rule(0.3, 0.4, _words("(?:[a-z0-9]+[_-])*(?:token|key|secret|password|passwd|credentials?|apikey|bearer)")),
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_SPACED = str.maketrans("", "", " -")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The account number's check: first four characters to the end, letters as 10 to 35, remainder 1."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with a domain takes the whole run of local characters before it."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            free = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].translate(_SPACED)) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0]):
            yield m.span()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


def secrets(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _SECRET.finditer(text))


def _within(words: re.Pattern, text: str, low: int, high: int) -> bool:
    """Whether a context word lies in text[low:high]; what follows the window is seen, so that no word is cut."""
    return any(m.end() <= high for m in words.finditer(text, max(0, low), min(len(text), high + 1)))


_FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns, "secret": secrets}
_DIGIT = re.compile("[0-9]")


def find_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans in order of start, then kind."""
    found = []
    if "@" in text:
        kinds = KINDS
    elif _DIGIT.search(text):
        kinds = KINDS[1:]
    else:
        return found
    for kind in kinds:
        rule = RULES[kind]
        for start, end in _FIND[kind](text):
            near = _within(rule.words, text, start - CONTEXT, start) or _within(rule.words, text, end, end + CONTEXT)
            score = rule.score + rule.boost * near
            if kind in BASE_KINDS or score >= threshold:
                found.append(Span(kind, start, end, score))
    found.sort(key=lambda s: (s.start, KINDS.index(s.kind)))
    return found


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep and `spans`, an array of (kind, start, end, score)."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            spans = [[s._asdict() for s in find_spans(t, threshold)] for t in text_column(b, "__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(spans, kind)], names=[*keep, "spans"])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, spans {SPAN_TYPE}")


def masked(text: str, spans: list[Span]) -> str:
    """Each span replaced by `[KIND]`; overlapping spans merge under the first one's kind."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The same columns with every found span of `text` masked; null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            at = b.schema.get_field_index(text)
            done = [None if t is None else masked(t, find_spans(t, threshold)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(done, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
