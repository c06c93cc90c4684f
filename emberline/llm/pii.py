"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

Base kinds are e-mail addresses, IPv4 addresses, payment cards (12 to 19 digits that pass Luhn)
and international phone numbers (9 to 15 digits). The method adds bank accounts (IBAN, confirmed
by mod 97) and US social security numbers, which have no checksum and so need a context word
nearby. A span's score starts from its kind, gains from words of its kind within ``WINDOW``
characters and loses from words that tell of something else; spans below ``threshold`` go,
except base spans where base_stays is set.

Every row is judged where it lies: no shuffle, no state. Offsets are code points, end exclusive.

Defined cases: a null text is empty and has no spans; repeated rows each get a row; an empty
table gives no rows; very long texts are scanned whole in linear time. Columns besides the id and
the text are not read, except by ``redact``, which passes them through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED
WINDOW = 48

# Context words by kind, and what a span of the kind scores without any.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
FOR = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login", "client"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "cvv", "expiry"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "bic", "swift"),
    "ssn": ("ssn", "social security", "social-security", "taxpayer"),
}
AGAINST = {"ip": ("version", "release", "build"), "card": ("isbn", "tracking", "order", "serial"), "phone": ("version", "isbn"), "ssn": ("part", "serial", "order")}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is tried once, from its first: what fails there fails from any later digit.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
# Characters of an IBAN by country.
_IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN without spaces passes: the rotated digits (A is 10) leave 1 by 97."""
    rest = 0
    for c in account[4:] + account[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """IBANs: from each start the country's length or, of an unknown country, the longest end at a token's border that passes."""
    floor = 0
    for m in _IBAN.finditer(text):
        if m.start() < floor:
            continue
        length, account, ends = _IBAN_LENGTH.get(m[0][:2]), m[0], []
        for place in range(m.start(1), m.end(1)):
            if text[place] == " ":
                continue
            account += text[place]
            after = text[place + 1 : place + 2]
            if len(account) >= 15 and (length is None or len(account) == length) and not (after.isascii() and after.isalnum()):
                ends.append((place + 1, account))
        floor = next((end for end, found in reversed(ends) if mod97(found)), 0)
        if floor:
            yield m.start(), floor


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.domain: the local part is the run before each @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        # A local part cannot begin before the previous @, so no character is walked over twice.
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def propose(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what patterns find and checksums confirm."""
    for start, end in emails(text):
        yield start, end, "email"
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.groups()):
            yield *m.span(), "ip"
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            yield *m.span(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                yield *m.span(), "phone"
    for start, end in accounts(text):
        yield start, end, "iban"
    for m in _SSN.finditer(text):
        yield *m.span(), "ssn"


def scored(text: str, start: int, end: int, kind: str) -> float:
    near = text[max(0, start - WINDOW) : start].lower() + "\n" + text[end : end + WINDOW].lower()
    hit = lambda words: any(re.search(rf"(?<![a-z]){re.escape(w)}", near) for w in words)
    return min(1.0, max(0.0, SCORE[kind] + 0.3 * hit(FOR[kind]) - 0.3 * hit(AGAINST.get(kind, ()))))


def find_spans(text: str | None, threshold: float = 0.5, base_stays: bool = True) -> list[Span]:
    """Spans by start, then kind as listed."""
    out = []
    for start, end, kind in propose(text or ""):
        score = scored(text, start, end, kind)
        if score >= threshold or base_stays and kind in BASE:
            out.append(Span(start, end, kind, score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, base_stays: bool = True) -> DataFrame:
    """Per document: doc_id and spans, an array of (start, end, kind, score)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def scan(batches):
        for batch in batches:
            found = [[vars(s) for s in find_spans(t, threshold, base_stays)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(scan, "doc_id long, spans array<struct<start:long,end:long,kind:string,score:double>>")


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with each span of at least the threshold replaced by its kind in brackets."""
    at = docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        out, end = [], 0
        for s in find_spans(value, threshold, False):
            if s.start >= end:
                out += [value[end : s.start], f"[{s.kind.upper()}]"]
                end = s.end
        return "".join([*out, value[end:]]) if out else value

    def change(batches):
        for batch in batches:
            column = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    return docs.mapInArrow(change, docs.schema)


def digest(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def base_sha(spans) -> str:
    return hashlib.sha256(digest([s for s in spans if s.kind in BASE]).encode()).hexdigest()


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and scores: each span's, in hundredths, in the same order."""
    found = pii_spans(docs, **options)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"))
