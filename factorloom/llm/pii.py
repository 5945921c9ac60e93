"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust scores.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches per kind that pass
their check; a failing match is dropped without a retry. Base spans always stay. Further
kinds (iban, ssn, local phone, secret) stay if their score, raised by context words within
``WINDOW`` code points, reaches ``THRESHOLD``.

Null text: no spans. Offsets are code points, end exclusive. Equal rows give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Shield, table, text_slices, tune

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "secret")
WINDOW = 40
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# The look-behinds only skip starts inside a run of digits, which cannot succeed where the
# start of the run failed; they keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(
    r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
)
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[a-zA-Z]*[0-9])[0-9A-Za-z]{16,}(?![0-9A-Za-z])")

# kind -> (score before context, words that raise it, what they add)
SCORES = {
    "email": (0.9, r"mail|contact|write", 0.1),
    "ip": (0.6, r"\bip\b|address|host|server", 0.3),
    "card": (0.8, r"card|visa|credit|karte|carte|tarjeta", 0.2),
    "phone": (0.7, r"phone|tel|call|fax|mobile", 0.3),
    "iban": (0.8, r"iban|bank|account|konto|compte|cuenta", 0.2),
    "ssn": (0.3, r"ssn|social", 0.4),
    "local_phone": (0.3, r"phone|tel|call|fax|mobile", 0.3),
    "secret": (0.2, r"password|passwd|token|secret|key", 0.5),
}
_CONTEXT = {kind: re.compile(words, re.IGNORECASE) for kind, (_, words, _) in SCORES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one @: the longest local part left of it, bounded by the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, before scores."""
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for match in _IP.finditer(text):
        if all(map(_octet, match.group().split("."))):
            yield "ip", *match.span()
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *match.span()
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_digits(match.group())) <= 15:
                yield "phone", *match.span()
    for match in _IBAN.finditer(text):
        if mod97(match.group()):
            yield "iban", *match.span()
    for kind, pattern in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE), ("secret", _SECRET)):
        for match in pattern.finditer(text):
            yield kind, *match.span()


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    found = []
    for kind, start, end in proposals(text):
        score, _, more = SCORES[kind]
        around = text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]
        if _CONTEXT[kind].search(around):
            score = min(1.0, score + more)
        if kind in BASE or score >= THRESHOLD:
            found.append((kind, start, end, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become one, named by the first."""
    parts, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
        )
    )
    for batch in text_slices(batches):
        spans, clean = [], []
        for text in batch.column("text").to_pylist():
            found = find_spans(text) if text else []
            spans.append([dict(zip(("kind", "start", "end", "score"), s)) for s in found])
            clean.append(redact(text, found) if found else text)
        columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(clean, pa.string()), pa.array(spans, kind)],
            names=[*names, "redacted", "spans"],
        )


def detect_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the redacted text and all spans of each document; one pass, no shuffle."""
    wanted = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "text")
    return wanted.mapInArrow(_span_batches, f"{schema}, redacted string, spans {SPAN_TYPE}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced by kinds; ``n_chars`` follows the new text."""
    tune(docs.sparkSession)
    shield = Shield(docs, "text", "n_chars")
    kept = tuple(c for c in shield.inside if c != "text")
    clean = detect_pii(shield.docs, keep=kept).withColumnRenamed("redacted", "text")
    if "n_chars" in kept:
        kind = docs.select("n_chars").schema[0].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return shield.restore(clean)


def _joined(spans) -> "F.Column":
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op9_pii_spans(spark, sf_dir: str) -> DataFrame:
    found = detect_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [
        F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}")
        for kind in BASE
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
