"""Quotes found by anchors, against a search of every text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import quotes as q


def brute(chunks, wanted):
    return {(i, c) for i, quote in wanted if i is not None and quote is not None for c, text in chunks if c is not None and text is not None and quote in text}


def found(spark, chunks, wanted, **more):
    frame = spark.createDataFrame([(*c, "clash", 1) for c in chunks], "id long, text string, anchor string, quote_id int")
    asked = spark.createDataFrame(wanted, "item long, text string")
    rows = [tuple(r) for r in q.quote_contains(frame, asked, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters", ["ab", "aé日😀", "abcdefghijklmnopqrstuvwxyz     "])
def test_against_a_search_of_every_text(spark, letters):
    draw = random.Random(len(letters))
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    chunks = [(i, text(draw.choice([0, 1, 11, 19, 20, 21, 80, 400]))) for i in range(80)] + [(None, text(50)), (90, None), (91, "ab" * 300), (92, "a" * 700), (92, "other text of the same id")]
    wanted = []
    for i in range(200):
        source = draw.choice(chunks)[1] or ""
        n = draw.choice([0, 1, 2, 11, 12, 19, 20, 21, 22, 30, 60])
        at = draw.randrange(max(1, len(source) - n + 1))
        wanted.append((i, source[at:at + n] + draw.choice(["", "", "", "x"])))
    wanted += [(500, "a" * 20), (501, "ab" * 10), (502, "ba" * 40), (503, None), (None, "a"), (504, "a" * 700), (504, "b"), (500, "a" * 20)]
    assert found(spark, chunks, wanted) == brute(chunks, wanted)


def test_a_text_has_the_anchors_of_all_that_it_holds():
    draw = np.random.default_rng(1)
    points = draw.integers(97, 101, 3000).astype(np.uint64)
    whole = set(q.anchors(points).tolist())
    for n in (q.ANCHORED, q.ANCHORED + 1, 50, 200):
        for at in range(0, 2500, 13):
            own = q.anchors(points[at:at + n])
            assert len(own) and set(own.tolist()) <= whole
    assert len(q.anchors(points[:q.ANCHORED - 1])) == 0 and len(whole) < len(points) / 3  # fewer than places


def test_nothing_asked_and_nothing_there(spark):
    assert found(spark, [(1, "text")], []) == set() and found(spark, [], [(1, "text"), (2, "")]) == set()


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(q, "_bit_table", lambda keys: np.full(1 << (q.BITS - 6), 2**64 - 1, np.uint64))
    chunks = [(i, f"the quick brown fox {i} jumps over the lazy dog {i * 7}") for i in range(40)]
    wanted = [(i, f"brown fox {i} jumps over the l") for i in range(0, 60, 3)] + [(99, "dog 7")]
    assert found(spark, chunks, wanted) == brute(chunks, wanted)


def test_quotes_of_a_passage_that_most_texts_share_are_looked_for_where_they_differ(spark):
    stock = "this stock phrase stands in every text of the whole corpus "
    chunks = [(i, stock + f"and then something of its own, number {i} of many, and no more") for i in range(300)]
    wanted = [(i, stock + f"and then something of its own, number {i} of many, and no") for i in range(300)]
    frame, asked = spark.createDataFrame(chunks, "id long, text string"), spark.createDataFrame(wanted, "item long, text string")
    near = []
    plain = q.F.contains
    try:
        q.F.contains = lambda text, quote: (near.append(1), plain(text, quote))[1]
        rows = q.quote_contains(frame, asked)
    finally:
        q.F.contains = plain
    assert {tuple(r) for r in rows.collect()} == brute(chunks, wanted) and near
    keys = asked.select(F.col("item").cast("string"), "text").mapInArrow(q._own_anchors, "own string, anchor long")
    seen = frame.mapInArrow(q._seen(spark.sparkContext.broadcast(q._bit_table(keys)), []), "id long, anchor long").groupBy("anchor").count()
    rarest = keys.join(seen, "anchor").groupBy("own").agg(F.min("count").alias("n"))
    assert rarest.agg(F.max("n")).first()[0] <= 12  # candidates of a quote, of 300 texts
