import unicodedata

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators.verify import classify_completions, licence_refusal
from foliospark.plans import catalog

WHITESPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
REMOVED = [0xFEFF, 0x200B, 0x200C, 0x200D, 0xAD]
CASES = [
    ("plain words", "plain words"), ("", ""), ("  ", ""), ("a\r\n\tb", "a b"), (" both ends ", "both ends"), ("é", "é"), ("e‍́", "é"), ("ﬁne", "ﬁne"), ("Ａ", "Ａ"),
    ("a\x1c\x1d\x1e\x1fb", "a\x1c\x1d\x1e\x1fb"), ("\x1c", "\x1c"), ("it’s — “so”", "it’s — “so”"), ("CASE stays", "CASE stays"), ("a​ b", "a b"), ("a ​ b", "a b"), ("᠎", "᠎"), ("a⁠b", "a⁠b"),
    ("\U0001f600  \U0001f600", "\U0001f600 \U0001f600"), ("가", "가"), ("Å", "Å"), ("Å", "Å"), ("Å", "Å"), ("﻿", ""),
    *[(f"a{chr(c)}{chr(c)}b{chr(c)}", "a b") for c in WHITESPACE], *[(f"a{chr(c)}b", "ab") for c in REMOVED],
]


@pytest.fixture(scope="module")
def normalised(spark):
    frame = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, x string")
    return {r["i"]: r for r in frame.select("i", t.normalise(F.col("x")).alias("once"), t.normalise(t.normalise(F.col("x"))).alias("twice")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_normalise(normalised, i):
    assert normalised[i]["once"] == CASES[i][1] == normalised[i]["twice"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_small_functions(spark):
    assert one(spark, t.normalise(F.lit(None).cast("string"))) is None
    assert [one(spark, t.roman(F.lit(x))) for x in ("I", "IV", "XIX", "XLII", "MCMXCIV")] == [1, 4, 19, 42, 1994]
    assert one(spark, t.word_count(F.lit("  a  b　c "))) == 3 and one(spark, t.word_count(F.lit(" "))) == 0
    assert one(spark, t.enum_label(F.lit("TIER_BINDING"), "TIER")) == "binding" and one(spark, t.enum_label(F.lit("TIER_UNSPECIFIED"), "TIER")) is None
    assert one(spark, t.is_blank(F.lit("  "))) and not one(spark, t.is_blank(F.lit("\x1c")))
    assert [one(spark, t.truthy(F.lit(x))) for x in (" Yes ", "on", "1", "no", "")] == [True, True, True, False, False]
    assert one(spark, t.quoted(F.lit('a"b\\'))) == '"a\\"b\\\\"'


def test_report(spark):
    frame = spark.createDataFrame([(" a­\n\nb  c é ",)], "x string")
    assert tuple(frame.select(*[c.alias(k) for k, c in t.normalisation_report(F.col("x")).items()]).first()) == (1, True, 2, 2, True)


def test_licences(spark):
    frame = spark.createDataFrame([("public-domain",), ("local-only",), ("refused",), ("odd",), (None,)], "l string")
    got = [tuple(r) for r in frame.select(licence_refusal(F.col("l")).isNull(), licence_refusal(F.col("l"), True).isNull()).collect()]
    assert got == [(True, True), (False, True), (False, False), (False, False), (False, False)]


def test_completions(spark):
    rows = [(0, 0, "stop", "{}"), (1, 1, "length", "{}"), (2, 1, "stop", "{"), (3, 1, "stop", "[1]"), (4, 1, "stop", '"x"'), (5, 1, "stop", "{}"), (6, 1, None, None), (7, None, "length", None)]
    got = {r["request_id"]: r["code"] for r in classify_completions(spark.createDataFrame(rows, "request_id int, choices int, finish_reason string, content string")).collect()}
    assert got == {0: "empty", 1: "truncated", 2: "not-json", 3: "not-an-object", 4: "not-an-object", 5: None, 6: "not-json", 7: "empty"}


def test_every_character_as_unicodedata_has_it(spark):
    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    rows = [(i, "".join(f"{c}-a{c}̣́-" for c in known[i:i + 500])) for i in range(0, len(known), 500)]
    got = {r["i"]: r["y"] for r in spark.createDataFrame(rows, "i int, x string").select("i", t.nfc(F.col("x")).alias("y")).collect()}
    assert got == {i: unicodedata.normalize("NFC", x) for i, x in rows}


@pytest.mark.parametrize("name", ["browse_pages", "chunk_blessed_flag", "omission_check", "render_answer", "apply_text", "stale_vectors"])
def test_texts_stay_in_the_jvm(spark, name):
    """No Python worker is given the whole texts of these queries."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and "ExistingRDD" not in plan
