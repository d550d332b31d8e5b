"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their scores.

Kinds that always stand once confirmed: email, ip (parts at most 255), card (Luhn), phone (9 to 15 digits).  Added kinds
need a score of at least `LEAST_SCORE`: iban (mod 97), local_phone (no country code), secret (an assigned key, whose own
name counts as context) and key_id (keys of a known form), which gain by context words nearby.  An added span that overlaps one of the first four is dropped.

Offsets count code points, ends are exclusive.  Null and empty texts have no span; null texts stay null when redacted.
Rows with equal ids are searched one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks
from logclinic.llm.staging import prepare

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "secret", "key_id")
LEAST_SCORE = 0.5
#: Characters before a span in which context words count.
NEARBY = 40

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3,4}\)?[\x20-][0-9]{3}[\x20-][0-9]{4}(?![0-9-])")
# the key word may end a longer name (client_secret, AWS_SECRET_ACCESS_KEY) and be quoted, as in JSON
SECRET = re.compile(
    r"(?i)(?:token|secret(?:[_-]?key)?|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[\"']?\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9+/_=.-]{16,})"
)
KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])")
#: Texts without any of these hold nothing but e-mail addresses.
WORTHWHILE = "[0-9]|AKIA|gh[pousr]_|AIza"

#: Words before a span that make its kind likelier.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("host", "server", "address", "ip "),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("token", "key", "secret", "passw"),
    "key_id": ("key", "access", "credential"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3, "secret": 0.4, "key_id": 0.7}
CONTEXT_GAIN = 0.3

SPANS = "spans array<struct<kind: string, start: int, end: int, score: double>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        d = ord(digit) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _numbers(text: str):
    for m in IP.finditer(text):
        if all(int(part) <= 255 for part in (p.lstrip("0")[:4] or "0" for p in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _proposed(text: str):
    m = IBAN.search(text)
    while m:
        # upper-case words or a further number may follow: the longest start that the checksum confirms
        onward = m.start() + 1
        for end in range(m.end(), m.start() + 14, -1):
            own = text[m.start() : end].replace(" ", "")
            if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()) and 15 <= len(own) <= 34 and mod97(own):
                yield "iban", m.start(), end
                onward = end
                break
        m = IBAN.search(text, onward)
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in SECRET.finditer(text):
        value = m[1]
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value):
            yield "secret", m.start(1), m.end(1)
    for m in KEY_ID.finditer(text):
        yield "key_id", m.start(), m.end()


def find_spans(text: str, has_at: bool, has_digit: bool) -> list[tuple[str, int, int, float]]:
    """kind, start, end, score, ordered by start and then by kind as listed."""
    sure = [("email", a, b) for a, b in _emails(text)] if has_at else []
    added = []
    if has_digit:
        sure += _numbers(text)
        added = list(_proposed(text))
    if not sure and not added:
        return []
    scored = []
    for kind, start, end in [*sure, *added]:
        before = text[max(0, start - NEARBY) : start].lower()
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in before for w in CONTEXT[kind]))
        scored.append((kind, start, end, round(score, 3)))
    taken = sorted((a, b) for _, a, b in sure)
    furthest = list(accumulate((b for _, b in taken), max))
    kept = scored[: len(sure)]
    for span in scored[len(sure) :]:
        before = bisect_left(taken, (span[2],))  # confirmed spans that start before this one ends
        if span[3] >= LEAST_SCORE and not (before and furthest[before - 1] > span[1]):
            kept.append(span)
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with <KIND> for each span; of overlapping spans the first one names the whole."""
    parts, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _spans_array(found: list[list[tuple[str, int, int, float]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    return pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans] for spans in found], kind)


def _search(column: str, replace: bool):
    def search(batches):
        for block in blocks(batches):
            texts = block.column(column)
            has_at = pc.fill_null(pc.match_substring(texts, "@"), False).to_pylist()
            has_digit = pc.fill_null(pc.match_substring_regex(texts, WORTHWHILE), False).to_pylist()
            rows = [k for k, (a, d) in enumerate(zip(has_at, has_digit, strict=True)) if a or d]
            some = dict(zip(rows, texts.take(pa.array(rows, pa.int64())).to_pylist(), strict=True))
            found = {k: find_spans(text, has_at[k], has_digit[k]) for k, text in some.items()}
            if replace:
                changed = [k for k in rows if found[k]]
                mask = pa.array([bool(found.get(k)) for k in range(len(texts))])
                texts = pc.replace_with_mask(texts, mask, pa.array([masked(some[k], found[k]) for k in changed], texts.type))
                yield block.set_column(block.schema.get_field_index(column), column, texts)
            else:
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), _spans_array([found.get(k, []) for k in range(len(texts))])], ["doc_id", "spans"])

    return search


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end, score) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_search("text", False), f"doc_id long, {SPANS}")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with all spans masked in the text."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_search(text, True), docs.schema)
