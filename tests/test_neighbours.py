"""Neighbours through balls against all pairs."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.functions import vectors as v
from foliospark.operators import neighbours, trace

SCHEMA = "id long, embedding array<float>, ball int, v int"


def brute(rows, queries, k):
    out = set()
    for q, x in queries:
        x = np.array(x, np.float64)
        scores = []
        for i, y in rows:
            if i is None or y is None or len(y) != len(x) or not np.any(y):
                continue
            y = np.array(y, np.float32).astype(np.float64)
            scores.append((-round(float(x @ y / max(np.linalg.norm(x), 1e-300) / np.linalg.norm(y)), 9), i))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(scores)[:k])}
    return out


def clusters(seed, n, centres, spread, dim=8):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return [(i, (c[i % centres] + spread * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 2.0])
@pytest.mark.parametrize("k", [1, 7])
def test_against_all_pairs(spark, monkeypatch, spread, k):
    monkeypatch.setattr(neighbours, "ROWS", 60)
    monkeypatch.setattr(neighbours, "QUERIES", 9)
    monkeypatch.setattr(neighbours, "DECIMALS", 9)
    rows = clusters(3, 700, 12, spread) + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 1.0]) for i in range(90)]  # many equal ones in a ball
    odd = [(2000, None), (2001, [1.0, 2.0]), (2002, [0.0] * 8), (None, [1.0] * 8)]
    queries = rows[::25] + [(-5, [0.0] * 8), (-6, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], SCHEMA)
    asked = spark.createDataFrame([(*q, 1, 2) for q in queries] + [(None, [1.0] * 8, 1, 2), (77, None, 1, 2)], SCHEMA)
    got = neighbours.ball_knn(frame, asked, k, id_col="id")
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == brute(rows + odd, queries, k)


def test_pairs_that_are_pruned(spark, monkeypatch):
    """In clustered vectors a query meets a small part of them."""
    met, plain = [], neighbours._met

    def count(balls, dealt, sizes, k):
        met.append(dealt.groupBy("ball").count().join(balls.groupBy("ball").agg(F.count(F.lit(1)).alias("n")), "ball").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0)
        return plain(balls, dealt, sizes, k)

    monkeypatch.setattr(neighbours, "_met", count)
    rows = clusters(5, 2000, 25, 0.05)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = neighbours.ball_knn(frame, frame.filter("id % 40 = 0"), 5, id_col="id").collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == brute(rows, rows[::40], 5)
    assert 0 < sum(met) < 0.15 * len(rows) * len(rows[::40])


def test_many_queries_take_this_way(spark, monkeypatch):
    monkeypatch.setattr(v, "QUERY_BLOCK", 4)
    rows = clusters(9, 60, 5, 0.3)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    want = brute(rows, rows[:12], 3)
    assert {(r["query_id"], r["id"], r["rank"]) for r in v.knn(frame, frame.filter("id < 12"), 3, id_col="id").collect()} == want
    assert {(r["query_id"], r["id"], r["rank"]) for r in v.knn(frame, rows[:12], 3, id_col="id").collect()} == want


def test_nothing(spark):
    frame = spark.createDataFrame([(1, [1.0], 1, 2)], SCHEMA)
    none = frame.filter("id < 0")
    for rows, queries, k in ((frame, none, 3), (none, frame, 3), (frame, frame, 0)):
        assert neighbours.ball_knn(rows, queries, k, id_col="id").collect() == []


def test_recall_by_label_is_recall_of_pairs(spark):
    labels = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(99, 7)], "chunk_id long, label long")
    queries = spark.createDataFrame([(0, 0), (4, 1), (200, 2), (99, 7)], "query_id long, label long")
    hits = spark.createDataFrame([(q, (q + 5 * r) % 30, r) for q in (0, 4, 200) for r in range(1, 8)], "query_id long, chunk_id long, rank int")
    pairs = queries.join(labels, "label").filter("query_id <> chunk_id").select("query_id", "chunk_id")
    want, got = (sorted(map(tuple, x.collect())) for x in (trace.recall_at_k(hits, pairs, 5), trace.recall_by_label(hits, labels, queries, 5)))
    assert got == want and len(got) == 3


def test_few_queries_by_slices(spark, monkeypatch):
    """Vectors are scored a few at a time, and the best of all slices are kept, equal ones by id."""
    monkeypatch.setattr(v, "SCORES", 64)
    rows = clusters(4, 400, 6, 0.3) + [(1000 - i, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 1.0]) for i in range(90)]
    odd = [(2000, None), (2001, [1.0, 2.0]), (2002, [0.0] * 8)]
    queries = rows[::40] + [(-6, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], SCHEMA)
    got = v.knn(frame, queries, 7, id_col="id")
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == brute(rows + odd, queries, 7)


def test_queries_are_dealt_out_in_slices(monkeypatch):
    """A query that meets all balls takes its vector to each of them, but never more than ROWS of these at once."""
    monkeypatch.setattr(neighbours, "ROWS", 50)
    r = np.random.default_rng(2)
    pivots, asked = r.normal(size=(40, 8)), r.normal(size=(700, 8))
    shared = SimpleNamespace(value=(pivots, np.arange(40), np.zeros(40), np.full(40, np.pi), np.full(40, 3)))
    batch = pa.record_batch([pa.array(range(700)), pa.array(asked.tolist()), pa.array([3.2] * 700)], names=["query_id", "v", "reach"])
    got = list(neighbours._dealt(shared, 1)([batch]))
    assert max(b.num_rows for b in got) <= 50 and sum(b.num_rows for b in got) == 700 * 39
    placed = list(neighbours._placed(SimpleNamespace(value=pivots))([batch]))
    assert max(b.num_rows for b in placed) <= neighbours.SLICE and sum(b.num_rows for b in placed) == 700
