"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Four kinds are always reported when their pattern and check hold: email, ip,
card (Luhn) and phone. Three more are reported when their score, raised by
context words nearby, reaches a fixed threshold: iban (mod 97), ssn (group
rules) and secret (keys, tokens and passwords).

Every pattern is searched in time linear in the text: a search begins only
where a match can begin (at a digit run's first digit, at an "@" or a "+"),
because long runs of one character would otherwise cost the square of their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct, with_struct

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
#: Characters before and after a span that are searched for context words.
NEAR = 40
THRESHOLD = 0.5

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = (
    (re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), 0.9),
    (re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|token|secret|api_?key)\x20?[=:]\x20?\"?([A-Za-z0-9_+/-]{8,64})(?![A-Za-z0-9_+/-])"), 0.5),
)
#: Words that speak for a kind when they stand near a span, and what each is worth.
CONTEXT = {
    "email": (("mail", "contact", "write"), 0.1),
    "ip": (("address", "host", "server", "login"), 0.1),
    "card": (("card", "visa", "credit", "payment"), 0.1),
    "phone": (("phone", "call", "tel", "mobile"), 0.1),
    "iban": (("iban", "account", "bank", "konto", "cuenta", "compte"), 0.3),
    "ssn": (("ssn", "social", "security", "tax"), 0.3),
    "secret": (("password", "token", "secret", "key", "aws"), 0.1),
}
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.6, "ssn": 0.3}


def luhn(digits: str) -> bool:
    """Luhn check of a string of ASCII digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Remainder check of an account number without spaces."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping matches of local@domain; the local part runs back to the last non-local character."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base kinds, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _proposed(text: str):
    """The method's further proposals that pass their validators, with their starting scores."""
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield "iban", m.start(), m.end(), START["iban"]
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end(), START["ssn"]
    for pattern, score in _SECRET:
        for m in pattern.finditer(text):
            value = m.groups()[-1] if m.groups() else m[0]
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                yield "secret", *m.span(m.re.groups), score


def score(text: str, kind: str, start: int, end: int, begin: float) -> float:
    """``begin`` raised by each context word of the kind within ``NEAR`` characters."""
    near = (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]).lower()
    words, worth = CONTEXT[kind]
    return min(1.0, begin + worth * sum(w in near for w in words))


def all_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Base spans and the method's own at or over the threshold, by kind, then start.

    A span of a further kind that overlaps a base span or an earlier one is dropped.
    """
    out = [(k, a, b, score(text, k, a, b, START[k])) for k, a, b in base_spans(text)]
    taken = sorted((a, b) for _, a, b, _ in out)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    more, last = [], 0
    for kind, a, b, begin in sorted(_proposed(text), key=lambda x: (x[1], -x[2])):
        s = score(text, kind, a, b, begin)
        before = bisect_left(starts, b)
        if s >= THRESHOLD and a >= last and not (before and reach[before - 1] > a):
            last = b
            more.append((kind, a, b, s))
    return out + sorted(more, key=lambda x: (MORE.index(x[0]), x[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def redact(text: str, spans) -> str:
    """``text`` with each span, overlapping ones together, replaced by the kind of the first."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FIELDS = [("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                        ("score", pa.float64())]))), ("redacted", pa.string())]


FOUND = "spans array<struct<kind:string,start:int,end:int,score:double>>, redacted string"


def _find(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts:
        text = t.as_py()
        spans = all_spans(text) if text else []
        rows.append(([dict(zip(("kind", "start", "end", "score"), s)) for s in spans],
                     redact(text, spans) if spans else text))
    return arrow_struct(FIELDS, rows)


DIGEST = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long, "
          "least_score double")


def _digest(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts:
        text = t.as_py()
        spans = all_spans(text) if text else []
        kinds = [s[0] for s in spans]
        base = [s for s in spans if s[0] in BASE]
        rows.append((*[kinds.count(k) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(),
                     joined(spans), len(spans) - len(base), min((s[3] for s in spans), default=None)))
    return arrow_struct([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()),
                         ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
                         ("n_more", pa.int64()), ("least_score", pa.float64())], rows)


def find_pii(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct (spans, redacted) per row, and the struct's name.

    Spans carry kind, code-point start and end, and score. Null texts have no
    spans and stay null, empty ones stay empty; repeated rows are treated alike;
    other columns pass through whatever their names are.
    """
    return with_struct(docs, text, F.arrow_udf(_find, FOUND), "_pii")


def pii_digest(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """As ``find_pii`` with counts and digests of the spans instead of the spans."""
    return with_struct(docs, text, F.arrow_udf(_digest, DIGEST), "_pii")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by the names of its kinds."""
    found, name = find_pii(docs, text)
    return (found.withColumn(text, F.col(f"{name}.redacted"))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
