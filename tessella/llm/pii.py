"""Personal data and secrets: patterns propose, checksums confirm, context adjusts the score.

A text is searched only around the bytes that every pattern needs (a digit or an @): one pass of a
byte test finds the lines that hold one, and texts without any leave at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, ensure_columns, text_bytes

MIN_SCORE = 0.5
WINDOW = 40  # characters before and after a span in which context words count
BOOST, LIFT = 0.35, 0.4  # what a context word adds; what a confirmed checksum adds


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0 and len(set(digits)) > 1


def mod97(text: str) -> bool:
    s = re.sub(r"\s", "", text)
    moved = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _card(s: str) -> bool | None:
    d = re.sub("[^0-9]", "", s)
    return luhn(d) if 12 < len(d) < 20 else False


def _ip(s: str) -> bool | None:
    parts = s.split(".")
    return all(p == str(int(p)) and int(p) < 256 for p in parts)


def _ssn(s: str) -> bool | None:
    a, b, c = s.split("-")
    return None if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else False


def _phone(s: str) -> bool | None:
    n = len(re.sub("[^0-9]", "", s))
    return None if 8 <= n <= 15 else False


def _secret(s: str) -> bool | None:
    kinds = len(set(s))
    return None if kinds >= 8 and re.search("[0-9]", s) and re.search(r"[A-Za-z]", s) else False


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    score: float  # before checksum and context
    check: Callable[[str], bool | None] | None  # True confirms, False refutes, None says nothing
    context: re.Pattern


def _near(*words: str) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(words) + r")", re.I)


_EDGE = r"(?<![\w.+-])"
KINDS = (
    Kind("email", re.compile(r"[A-Za-z0-9\u00c0-\u024f._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b"), 0.9, None, _near("mail", "e-mail", "contact", "correo")),
    Kind("credit_card", re.compile(r"(?<![\w.-])(?:[0-9][ -]?){12,18}[0-9](?![\w-])"), 0.4, _card, _near("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta")),
    Kind("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0.3, mod97, _near("iban", "account", "konto", "compte", "cuenta", "bank")),
    Kind("ssn", re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), 0.4, _ssn, _near("ssn", "social", "security")),
    Kind("phone", re.compile(r"(?<!\w)(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)|(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w-])"), 0.7, _phone, _near("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone", "teléfono")),
    Kind("ip_address", re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"), 0.25, _ip, _near("ip", "host", "server", "address", "addr")),
    Kind("secret", re.compile(r"(?i:\b(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d|pwd|auth)\b)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/=.]{12,})"), 0.8, _secret, _near("token", "secret", "key", "password")),
    Kind("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})\b"), 0.9, _secret, _near("key", "token")),
)


def find(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, confirmed) of the spans in a text, none overlapping a better one."""
    found = []
    for k in KINDS:
        for m in k.pattern.finditer(text):
            start, end = m.span(1 if m.re.groups else 0)
            ok = k.check(text[start:end]) if k.check else None
            if ok is False:
                continue
            score = k.score + LIFT * bool(ok)
            if k.context.search(text, max(0, start - WINDOW), start) or k.context.search(text, end, end + WINDOW):
                score += BOOST
            score = min(1.0, round(score, 4))
            if score >= min_score:
                found.append((k.name, start, end, score, bool(ok)))
    found.sort(key=lambda f: (-f[3], f[1] - f[2], f[1], f[0]))
    out: list[tuple[str, int, int, float, bool]] = []  # in order, none overlapping
    starts: list[int] = []
    for f in found:
        i = bisect_left(starts, f[2])  # all before i start before its end
        if not i or out[i - 1][2] <= f[1]:
            out.insert(i, f)
            starts.insert(i, f[1])
    return out


_NEEDED = np.zeros(256, bool)
_NEEDED[[ord(c) for c in "0123456789@"]] = True

def mask(kind: str, value: str) -> str:
    return f"[{kind}:{len(value)}]"


def find_pii(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, kind, start, length, score, confirmed, masked), a row a span; positions in characters.

    score is the pattern's own, plus 0.4 where a checksum or range check confirms it (Luhn for cards,
    mod-97 for account numbers, octets for addresses), plus 0.35 where a context word stands within 40
    characters; a failed check discards the span. Of overlapping spans the higher score stays, then
    the longer, then the earlier, then the first kind by name. Digits are those of ASCII. A very long text
    is searched whole. Null and empty texts have no spans; rows with a null doc_id are searched and reported
    with a null id; repeated rows are reported each. An empty table gives no rows. Other columns are
    ignored. Values are never returned, only their kind and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            buf, offs = text_bytes(b.column("text"))
            count = np.concatenate([[0], np.cumsum(_NEEDED[buf])])
            maybe = np.flatnonzero(count[offs[1:]] > count[offs[:-1]])
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            rows = []
            for i in maybe:
                text = texts[int(i)].as_py()
                rows += [(ids[i], k, s, e - s, score, ok, mask(k, text[s:e])) for k, s, e, score, ok in find(text, min_score)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["doc_id", "kind", "start", "length", "score", "confirmed", "masked"])

    return ensure_columns(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, kind string, start bigint, length bigint, score double, confirmed boolean, masked string")


def op4_pii(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
