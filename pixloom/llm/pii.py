"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: The kinds, in the order in which spans are listed: four base ones, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# Fixed values of the contract.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Begins at a run of digits only and never gives digits back, so that no run is read more than four times.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Kinds beyond the contract.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SOME = re.compile(r"[0-9@]")

#: Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
}
#: Score of a pattern alone; what a checksum or range check adds; what a context word adds.
PATTERN, CHECKED, NEARBY = 0.5, 0.35, 0.15
_START = {"email": 0.75, "ip": PATTERN, "card": PATTERN, "phone": PATTERN, "iban": PATTERN, "ssn": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _octets(found: str) -> bool:
    return all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in found.split("."))


def _card(found: str) -> bool:
    digits = re.sub(r"[\x20-]", "", found)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone(found: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in found) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost addresses that do not overlap, from each @ outwards, so that no letter is read more than twice."""
    after, at = 0, text.find("@")
    while at >= 0:
        before = text[after:at]
        start = after + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        after = found.end() if found else at + 1
        at = text.find("@", after)


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed by a checksum or range) of every span that stands its test, by kind, then start."""
    if not _SOME.search(text):
        return
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b, False
    for kind, pattern, test in (("ip", _IP, _octets), ("card", _CARD, _card), ("phone", _PHONE, _phone), ("iban", _IBAN, mod97)):
        for m in pattern.finditer(text):
            if test(m.group()):
                yield kind, m.start(), m.end(), True
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), False


def find(text: str | None, window: int = 40, threshold: float = 0.45) -> list[tuple[str, int, int, float, str]]:
    """(kind, start, end, score, found) in code points, end exclusive. Base kinds always stay; others need the threshold."""
    out = []
    text = text or ""
    for kind, a, b, confirmed in proposals(text):
        score = _START[kind] + CHECKED * (confirmed and kind in ("card", "iban")) + 0.2 * (confirmed and kind in ("ip", "phone"))
        around = f"{text[max(0, a - window) : a]} {text[b : b + window]}".lower()
        if any(w in CONTEXT[kind] for w in re.findall(r"[\w-]+", around)):
            score += NEARBY
        score = round(min(score, 1.0), 2)  # before it is compared: 0.3 + 0.15 is less than 0.45
        if kind in BASE or score >= threshold:
            out.append((kind, a, b, score, text[a:b]))
    return out


SPAN = StructType(
    [StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()), StructField("found", StringType())]
)


def detect_pii(docs: DataFrame, text_col: str = "text", window: int = 40, threshold: float = 0.45) -> DataFrame:
    """``docs`` with the column pii_spans: array of (kind, start, end, score, found), by kind as in KINDS, then start.

    Patterns are leftmost and non-overlapping per kind; a card must pass Luhn, an IBAN mod 97, an address part be at most
    255, a phone number have 8 to 15 digits; a match that fails is dropped without another try. A word of CONTEXT within
    ``window`` code points raises the score. email, ip, card and phone stay whatever their score; iban and ssn need
    ``threshold``. A null or empty text has no spans. A column pii_spans of ``docs`` is replaced; repeated rows, an
    empty table and other columns pass through. Rows are independent: no shuffle. Time is linear in a text's length.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "pii_spans"])
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("found", pa.string())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score", "found"), s, strict=True)) for s in find(t.as_py(), window, threshold)] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "pii_spans"])

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField("pii_spans", ArrayType(SPAN))]))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first listed stands."""
    if text is None:
        return None
    taken: list[tuple[int, int, str]] = []  # in order
    for kind, a, b in spans:
        at = bisect.bisect(taken, (a, b, kind))
        if (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b, kind))
    out, last = [], 0
    for a, b, kind in taken:
        out += [text[last:a], f"[{kind}]"]
        last = b
    return "".join([*out, text[last:]])


def digest(listed: str) -> str:
    return hashlib.sha256(listed.encode()).hexdigest()
