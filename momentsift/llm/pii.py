"""Personal data: patterns propose, checksums confirm, context words adjust.

Four base kinds are decided by pattern and validator alone. Further kinds get
a score: that of the kind, more when a checksum or range rule holds, more when
a context word stands near; spans that reach ``THRESHOLD`` are added.
"""

from __future__ import annotations

import hashlib
import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_rows, map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
THRESHOLD = 0.7
#: Characters on each side in which context words count.
CONTEXT_CHARS = 48

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_UPPER = frozenset(string.ascii_uppercase + string.digits)
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
_MORE = re.compile("[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

# IBAN lengths by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}
CONTEXT = {
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
    "ssn": re.compile(r"ssn|social security|tax id|sozialversicherung|seguridad social", re.I),
    "local_phone": re.compile(r"phone|tel|call|mobile|fax|handy|tel[eé]fono|t[eé]l[eé]phone", re.I),
}
#: Words that tell of other numbers: they lower the score where no word of the kind stands near.
AGAINST = re.compile(r"order|invoice|isbn|serial|version|model|tracking|bestellung|rechnung|pedido|commande", re.I)
KIND_SCORE = {"iban": 0.4, "ssn": 0.3, "local_phone": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Every ``@`` with a domain after it and local characters before it, from the left."""
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        nxt = at + 1
        if domain:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = nxt = domain.end()
                spans.append((start, last))
        at = text.find("@", nxt)
    return spans


def ips(text: str) -> list[tuple[int, int]]:
    spans = []
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() >= 7:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
                    spans.append(m.span())
    return spans


def cards(text: str) -> list[tuple[int, int]]:
    spans = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(m.span())
    return spans


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(m[0].count, string.digits)) <= 15]


def _scored(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]
    named = bool(CONTEXT[kind].search(near))
    return KIND_SCORE[kind] + 0.4 * confirmed + 0.3 * named - 0.2 * (not named and bool(AGAINST.search(near)))


def added_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the kinds that the method adds."""
    found = []
    for m in _IBAN.finditer(text):
        need, end, got = IBAN_LENGTHS.get(m[1], 0), m.start(), 0
        while got < need and end < len(text) and (text[end] in _UPPER or text[end] == " " != text[end - 1]):
            got += text[end] != " "
            end += 1
        if need and got == need and not _MORE.match(text, end) and mod97(text[m.start() : end].replace(" ", "")):
            found.append(("iban", m.start(), end, _scored("iban", text, m.start(), end, True)))
    for m in _SSN.finditer(text):
        real = m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
        found.append(("ssn", *m.span(), _scored("ssn", text, *m.span(), real)))
    for m in _LOCAL_PHONE.finditer(text):
        found.append(("local_phone", *m.span(), _scored("local_phone", text, *m.span(), False)))
    return [f for f in found if f[3] >= THRESHOLD]


def scan(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[str, int, int, float]]]:
    """Base spans by kind, and the added ones."""
    mails = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return [mails, [], [], []], []
    return [mails, ips(text), cards(text), phones(text) if "+" in text else []], added_spans(text)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col``, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans.

    Null and empty texts have no spans (the hash is that of an empty list);
    texts of any length are read whole; repeated rows and null ids pass through
    row by row; spans that start together are listed by kind. Columns other
    than the two are ignored, whatever their names; an empty table gives no
    rows.
    """

    def make():
        def step(batch):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans")}
            for text in batch.column("text").to_pylist():
                base, added = scan(text)
                named = [f"{k}:{s}:{e}" for k, spans in zip(BASE_KINDS, base, strict=True) for s, e in spans]
                for k, spans in zip(BASE_KINDS, base, strict=True):
                    out[f"n_{k}"].append(len(spans))
                out["n_added"].append(len(added))
                out["base_sha256"].append(hashlib.sha256(",".join(named).encode()).hexdigest())
                more = sorted(added, key=lambda a: (ADDED_KINDS.index(a[0]), a[1]))
                out["spans"].append(",".join(named + [f"{k}:{s}:{e}" for k, s, e, _ in more]))
            return out | {"id": batch.column("id")}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return map_rows(input_rows(docs, id_col, text_col), schema, make).withColumnRenamed("id", id_col).select(
        F.col(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"
    )
