"""Text functions of the citation contract, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version of the normalisation contract.
NORMALISATION_VERSION = 1

# Fixed values of the contract: removed format characters, and its whitespace.
REMOVED = "﻿​‌‍­"
WHITESPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Fixed values of the contract: the shape of names.
CORPUS_ID = r"^[a-z0-9]+(-[a-z0-9]+)+$"
LANGUAGE = r"^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$"
SHA256 = r"^[0-9a-f]{64}$"
LOCATOR = r"^\S+( \S+)*$"

#: The same whitespace, character by character.
SPACES = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def nfc(text: Column) -> Column:
    """Unicode NFC by the ICU classes that Spark comes with for its collations: texts don't leave the JVM. The text must not be null."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def without_format_characters(text: Column) -> Column:
    return F.translate(text, REMOVED, "")


def trim_space(text: Column) -> Column:
    """Strip the contract's whitespace at both ends; Spark's trim strips U+0020 only."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{WHITESPACE}]")


def squeeze(text: Column) -> Column:
    return _single(F.translate(text, SPACES, " " * len(SPACES)))


def _single(text: Column) -> Column:
    """Runs of U+0020 to one, none at the ends; a plain character is matched much faster than a class of ranges."""
    return F.trim(F.regexp_replace(text, "  +", " "))


def normalise(text: Column) -> Column:
    """The contract's steps in order: remove format characters, NFC, whitespace runs to one space, trim. Nothing else."""
    # one translation removes and turns whitespace to U+0020; NFC composes nothing with either and maps whitespace to whitespace
    return F.when(text.isNotNull(), _single(nfc(F.translate(text, SPACES + REMOVED, " " * len(SPACES)))))


def fingerprint(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def word_count(text: Column) -> Column:
    """Words between whitespace of the contract."""
    flat = squeeze(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def normalisation_report(text: Column) -> dict[str, Column]:
    """What the contract's steps change in a text, as columns by name."""
    stripped = without_format_characters(text)
    composed = F.when(stripped.isNotNull(), nfc(stripped))
    inner = trim_space(composed)
    runs = f"[{WHITESPACE}]+"
    changed = F.filter(F.regexp_extract_all(inner, F.lit(f"({runs})"), 1), lambda r: r != " ")
    return {
        "removed": F.length(text) - F.length(stripped),
        "recomposed": composed != stripped,
        "runs": F.size(changed),
        "line_breaks": F.aggregate(changed, F.lit(0), lambda n, r: n + F.length(r) - F.length(F.replace(r, F.lit("\n"), F.lit("")))),
        "trimmed": inner != composed,
    }


def enum_label(name: Column, prefix: str) -> Column:
    """Label of a contract enum's name; null where the name is unspecified."""
    short = F.regexp_replace(name, f"^{prefix}_", "")
    return F.when(short == "UNSPECIFIED", None).otherwise(F.replace(F.lower(short), F.lit("_"), F.lit("-")))


def roman(numeral: Column) -> Column:
    """Value of a Roman numeral, right to left: a smaller digit before a larger one is subtracted."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    digits = F.transform(F.filter(F.split(F.upper(F.reverse(numeral)), ""), lambda c: c != ""), lambda c: F.element_at(value, c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    step = lambda s, v: F.struct((s["sum"] + F.when(v < s["top"], -v).otherwise(v)).alias("sum"), F.greatest(s["top"], v).alias("top"))
    return F.aggregate(digits, start, step, lambda s: s["sum"])


# How white space is shown.
PILCROW, OPEN_BOX = "¶", "␣"


def visible(text: Column) -> Column:
    """``text`` as HTML in which what normalisation removes or squeezes can be seen; line breaks stay breaks, behind a pilcrow."""
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    gone = {c: f'<span class="gone" title="U+{ord(c):04X}, removed by step 0">U+{ord(c):04X}</span>' for c in REMOVED}
    points = [*range(0x9, 0xA), *range(0xB, 0xE), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    shown = {chr(p): f'<span class="ws" title="U+{p:04X}">{OPEN_BOX}</span>' for p in points}
    shown = gone | shown | {"\n": f'<span class="ws">{PILCROW}</span>\n'}
    marks = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    pieces = F.regexp_extract_all(out, F.lit(f"([{WHITESPACE}{REMOVED}&&[^ ]]|[[^{WHITESPACE}{REMOVED}][ ]]+)"), 1)
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(marks, x), x)), "")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def truthy(text: Column) -> Column:
    """Whether a setting's text switches it on."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "yes", "on")
