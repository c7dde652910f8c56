"""Personal data: patterns propose spans, check sums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) are found leftmost and without overlap within a kind;
a match that its validator refuses is dropped and not tried again further right. Added kinds are `iban`
(mod-97), `ssn` (issued area, group and serial numbers), `secret` (a key word, then a long token) and `key` (a token of a known form).
They only add spans, where their score is LEAST or more: so a number like an SSN counts only near words that say so.
Base spans always stay, whatever their score.

A null or empty text has no spans. Offsets count code points, ends are exclusive. Rows that
repeat are answered each; columns beyond doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret", "key")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin with its first run of digits, which is never given back: linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_BARE = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
_SECRET = re.compile(r"(?i)(?:api[_-]?key|secret|token|password|passwd)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_/+=-]{16,})")

#: Words near a span that make its kind likelier, in lower case.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "kontakt", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "addr", "adresse"),
    "card": ("card", "visa", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "secret", "token", "password"),
    "key": ("key", "secret", "token", "password"),
}
#: Score of a confirmed span without context, what context adds, and how many characters on either side count.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "secret": 0.6, "key": 0.8}
CONTEXT_GAIN = 0.2
CONTEXT_CHARS = 40
#: Score from which a span of an added kind counts.
LEAST = 0.6


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ the local part is gone back over, which is linear in the text."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 3 or len(p) == 3 and int(p) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in BASE, end), in order of start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def added_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 4, m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
    found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    if ":" in text or "=" in text:
        found += [(m.start(1), 6, m.end(1)) for m in _SECRET.finditer(text)]
    known = {a for a, k, _ in found if k == 6}
    found += [(m.start(), 7, m.end()) for m in _BARE.finditer(text) if m.start() not in known]
    return sorted(found)


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".lower()
    words = set(re.findall(r"\w+", near))
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in words for w in CONTEXT[kind]))


def find(text: str | None, least: float = LEAST) -> list[Span]:
    """All spans of a text; added kinds only where their score is `least` or more."""
    text = text or ""
    out = []
    for a, k, b in sorted(base_spans(text) + added_spans(text)):
        s = score(text, KINDS[k], a, b)
        if k < len(BASE) or s >= least:
            out.append(Span(KINDS[k], a, b, s))
    return out


def redact(text: str | None, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    text, out, at = text or "", [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
            at = s.end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, score)."""
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", text_of().alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s.kind, s.start, s.end, s.score) for s in find(t, least)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in spans], pa.list_(span))], ["doc_id", "spans"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans and their scores as text, and the number of all spans."""
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return detect(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"), F.size("spans").cast("long").alias("n_spans"))
