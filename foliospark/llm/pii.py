"""Personal data: expressions propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import pieces, small_batches

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double,base:boolean>>"

# Anchored forms of the contract's expressions: they match the same spans without trying every start of a
# long run of letters or digits again. An email is found from its @, an address from where digits begin.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])")
#: Characters of an account number, by country.
_IBAN_CHARS = {
    c: n for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items() for c in names.split()
}
_LOCAL_PHONE = re.compile(r"(?<![0-9+.\w-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-])[0-9][0-9 -]{4,10}[0-9](?![0-9\w-])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile("[^0-9]")
_DIGIT = re.compile("[0-9]")

#: Words near a span that speak for its kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "handy", "teléfono", "téléphone", "móvil"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

#: Score of a span that its expression and checks propose, added for a context word near it, and least score of a span that is kept.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "local phone": 0.3, "short card": 0.4}
BONUS, LEAST, WINDOW = 0.3, 0.5, 50


def luhn(digits: str) -> bool:
    """The last digit of ``digits`` (ASCII digits only) checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str):
    """(start, end) of account numbers: an upper-case or digit word after one is no part of it, and one that fails hides none after it."""
    at = 0
    while m := _IBAN.search(text, at):
        whole, size = m[0], _IBAN_CHARS.get(m[0][:2])
        ends = [i for i, c in enumerate(whole) if c == " " and i - whole.count(" ", 0, i) == size] + [len(whole)]
        found = next((e for e in ends if 15 <= len(code := whole[:e].replace(" ", "")) <= 34 and mod97(code)), 0)
        if found:
            yield m.start(), m.start() + found
        at = m.start() + (found or 4)


def _emails(text: str):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = done
        else:
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds in order; failing matches are dropped and not retried."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _near(text: str, kind: str, start: int, end: int) -> bool:
    around = f"{text[max(0, start - WINDOW):start]} | {text[end:end + WINDOW // 2]}".lower()
    return not {*_WORD.findall(around)}.isdisjoint(CONTEXT[kind])


def find_spans(text: str | None) -> list[dict]:
    """All spans of a text, by kind as in KINDS, then start. Base spans always stay; others need a score of LEAST and must not touch a base span."""
    text = text or ""
    base = base_spans(text)
    scored = [(k, s, e, min(1.0, PRIOR[k] + BONUS * _near(text, k, s, e)), True) for k, s, e in base]
    if _DIGIT.search(text):
        more: list[tuple[str, int, int, float]] = []
        more += [("iban", a, e, PRIOR["iban"]) for a, e in _ibans(text)]
        more += [("ssn", m.start(), m.end(), PRIOR["ssn"]) for m in _SSN.finditer(text)]
        for m in _LOCAL_PHONE.finditer(text):
            if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 12:
                more.append(("phone", m.start(), m.end(), PRIOR["local phone"]))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 15 and digits[0] in "3456" and luhn(digits):
                more.append(("card", m.start(), m.end(), PRIOR["short card"]))
        taken = bytearray(len(text) if more else 0)  # one look at each character of a span, however many spans there are
        for _, s, e in base if more else ():
            taken[s:e] = b"\1" * (e - s)
        for k, s, e, p in more:
            if (score := min(1.0, p + BONUS * _near(text, k, s, e))) >= LEAST and taken.find(1, s, e) < 0:
                scored.append((k, s, e, score, False))
                taken[s:e] = b"\1" * (e - s)
    scored.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return [{"kind": k, "start": s, "end": e, "value": text[s:e], "score": p, "base": b} for k, s, e, p, b in scored]


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (code points, end exclusive) for every row; other columns are not read.

    Null and empty texts have no spans; ids may be null or repeat: a row gives a row. Texts of any length
    are read whole, in time linear in their length. An empty table gives no rows.
    """

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([find_spans(t) for t in b.column(1).to_pylist()], _TYPE)], names=["doc_id", "spans"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id long, spans {SPANS}")


def pii_digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_pii``'s result."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
