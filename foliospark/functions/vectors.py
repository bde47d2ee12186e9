"""Vector functions, and exact nearest neighbours of a set of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that go to every task at most; more are dealt out with the vectors.
QUERY_BLOCK = 1024
#: Scores that a task makes at once at most, a row of vectors by a query each.
SCORES = 1 << 18
#: Scores are told apart to so many decimals; vectors that are equal to those tie, whatever they are multiplied with at once.
DECIMALS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x / norm))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, queries: DataFrame | list, k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the ``k`` rows of highest cosine for each query, ties to the smaller id; exact.

    ``queries``: a list, or a table of ids and vectors. Up to QUERY_BLOCK go to every task, which scans its vectors
    once, SCORES at a time, and keeps its own best ``k`` of each query, so the shuffle carries k rows a task and query. More are dealt out
    with the vectors (``ball_knn``). Rows without a vector, or of another length than the queries, are no
    neighbours. ``k`` under 1 or no queries give no rows.
    """
    schema = "query_id long, id long, score double"
    spark = vectors.sparkSession
    if isinstance(queries, list) and len(queries) > QUERY_BLOCK:
        queries = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query_id long, v array<double>")
    if not isinstance(queries, list):
        few = queries.limit(QUERY_BLOCK + 1).collect()
        if len(few) > QUERY_BLOCK:
            from foliospark.operators.neighbours import ball_knn

            return ball_knn(vectors, queries, k, id_col, vector_col)
        queries = [(r[0], r[1]) for r in few]
    if k < 1 or not queries:
        return spark.createDataFrame([], f"{schema}, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    step = max(1, SCORES // len(ids))

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        for b in batches:
            keep = np.flatnonzero(pc.fill_null(pc.list_value_length(b.column(1)), -1).to_numpy(zero_copy_only=False) == matrix.shape[1])
            for at in range(0, len(keep), step):
                rows = b.take(pa.array(keep[at:at + step]))
                own = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                norms = np.linalg.norm(data, axis=1)
                scores = np.round((data @ matrix.T) / np.where(norms == 0, np.nan, norms)[:, None], DECIMALS)
                for j, (held, s) in enumerate(zip(best, scores.T, strict=True)):
                    good = np.flatnonzero(~np.isnan(s) if len(held[1]) < k else s >= held[1][-1])
                    if len(good):
                        one, score = np.concatenate((held[0], own[good])), np.concatenate((held[1], s[good]))
                        top = np.lexsort((one, -score))[:k]
                        best[j] = one[top], score[top]
        for q, (one, score) in zip(ids, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), q)), pa.array(one), pa.array(score)], names=["query_id", "id", "score"])

    found = vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, schema)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
