"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are kept by their pattern and check alone; the context only
moves their score. Further kinds (iban: mod-97; ssn; secret: a long value of letters and digits that is called a token, password or the like) are kept from ``LEAST_SCORE`` on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
LEAST_SCORE = 0.5
#: Score before the context is read, and code points of context read on either side.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
REACH = 40
HINTS = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "server", "host"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "secret": {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "credential", "credentials", "bearer"},
}
AGAINST = {"version", "isbn", "order", "sku", "build", "example", "test"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# started only where a run of digits starts: from inside a run it would fail as it did from the start
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,256}(?![A-Za-z0-9+/_-])")
_DIGIT, _NOT_DIGIT, _WORD = re.compile("[0-9]"), re.compile("[^0-9]"), re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: the local part is all that may stand before the @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of confirmed spans, in code points, end exclusive."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    found += [("iban", *m.span()) for m in _IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    found += [("secret", *m.span()) for m in _SECRET.finditer(text) if len(_DIGIT.findall(m[0])) >= 3]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall(text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.3 * bool(near & HINTS[kind]) - 0.2 * bool(near & AGAINST))), 3)


def find(text: str) -> list[dict]:
    """The spans of a text in order of start, then kind as listed."""
    scored = [(k, a, b, score(text, k, a, b)) for k, a, b in spans(text)]
    kept = [x for x in scored if x[0] in BASE or x[3] >= LEAST_SCORE]
    return [{"kind": k, "start": a, "end": b, "score": s, "found": text[a:b]} for k, a, b, s in sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))]


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double,found:string>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: kind, start, end, score and the text found.

    Null and empty texts have no spans; equal rows give equal rows; other columns are not read;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["spans"] = [find(t) if isinstance(t, str) else [] for t in pdf["text"]]
            yield pdf[["doc_id", "spans"]]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The counts of base kinds, the spans as strings kind:start:end, and their scores."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(of(*BASE), line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
