"""Exact nearest neighbours of any number of queries: vectors lie in balls around pivots, and a query meets only the balls that can hold a neighbour.

Angles obey the triangle inequality. A vector belongs to the pivot it makes the least angle with, and a ball is known by
the least and greatest angle of its vectors, so the angle of a query to any of them is at least the gap between the
query's angle to the pivot and that range. A first round searches the balls around the nearest pivots that hold k
vectors together; its k-th angle is an upper bound, and a second round searches the other balls whose gap is not above it.

Pivots are a bounded sample, which changes costs and not results; ranges and sizes of the balls are a row for each. Both
sides are dealt out by ball, balls and their queries of any size in blocks, so a task holds one block of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.storage import written

#: Pivots at most; fewer are taken where their square is more than the vectors.
PIVOTS = 1024
#: Vectors and queries of a block.
ROWS, QUERIES = 4096, 1024
#: Rows of vectors or queries whose angles to all pivots a task holds at once.
SLICE = 256
#: Added to bounds: angles of floating point numbers are that exact.
MARGIN = 1e-6
#: Scores are told apart to so many decimals; vectors that are equal to those tie, and the smaller id comes first.
DECIMALS = 12


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ _unit(y).T, -1, 1))


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _placed(shared):
    """Rows (id, v) -> id, v, ball, angle; vectors without a direction are left out."""

    def run(batches):
        for b in _slices(batches):
            x = _matrix(b.column(1))
            keep = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
            angles = _angles(x[keep], shared.value)
            ball = angles.argmin(axis=1) if len(keep) else np.zeros(0, np.int64)
            rows = b.take(pa.array(keep))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(ball.astype(np.int32)), pa.array(angles[np.arange(len(keep)), ball])], names=["id", "v", "ball", "angle"])

    return run


def _dealt(shared, k: int):
    """Rows (query_id, v, reach) -> query_id, v, ball. Without a reach the balls of the nearest pivots, until they hold k vectors; with one all others that are within it."""

    def run(batches):
        pivots, balls, low, high, size = shared.value
        for b in _slices(batches):
            angles = _angles(_matrix(b.column(1)), pivots)[:, balls]
            whom, where = [], []
            for i, (row, reach) in enumerate(zip(angles, b.column(2).to_pylist(), strict=True)):
                order = np.argsort(row, kind="stable")
                home = order[:np.searchsorted(np.cumsum(size[order]), k) + 1]
                if reach is not None:
                    gap = np.maximum(row - high, low - row)
                    near = gap <= reach + MARGIN
                    near[home] = False
                    home = np.flatnonzero(near)
                whom.append(np.full(len(home), i))
                where.append(balls[home])
            whom, where = np.concatenate(whom), np.concatenate(where).astype(np.int32)
            for at in range(0, len(whom), ROWS):  # a query's vector goes along to each of its balls
                rows = b.take(pa.array(whom[at:at + ROWS]))
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(where[at:at + ROWS])], names=["query_id", "v", "ball"])

    return run


def _best(k: int):
    """A block of vectors and one of queries -> the k best of each query."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        if vectors.num_rows and queries.num_rows:
            ids, asked = (t.column(c).to_numpy() for t, c in ((vectors, "id"), (queries, "query_id")))
            x, q = _matrix(vectors.column("v").combine_chunks()), _matrix(queries.column("v").combine_chunks())
            scores = np.round((x @ _unit(q).T) / np.linalg.norm(x, axis=1)[:, None], DECIMALS)
            for j, own in enumerate(asked):
                s = scores[:, j]
                top = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                top = top[np.lexsort((ids[top], -s[top]))[:k]]
                parts.append((np.full(len(top), own), ids[top], s[top]))
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3)]
        return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["query_id", "id", "score"])

    return run


def _met(balls: DataFrame, dealt: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """query_id, id, score: for each block of a ball (id, v, ball) and of the queries dealt to it (query_id, v, ball; written) the k best."""
    spark = balls.sparkSession
    asked = {r["ball"]: r["n"] for r in dealt.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each ball
    if not asked:
        return spark.createDataFrame([], "query_id long, id long, score double")
    blocks = spark.createDataFrame([(b, -(-sizes[b] // ROWS), -(-n // QUERIES)) for b, n in asked.items()], "ball int, of_rows int, of_queries int")  # at most PIVOTS rows
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = balls.join(F.broadcast(blocks), "ball").select("ball", own("id", "of_rows").alias("i"), each("of_queries").alias("j"), "id", "v")
    right = dealt.join(F.broadcast(blocks), "ball").select("ball", each("of_rows").alias("i"), own("query_id", "of_queries").alias("j"), "query_id", "v")
    key = ["ball", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), "query_id long, id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def ball_knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, id, score, rank: the ``k`` rows of highest cosine for each query (a table of ids and vectors), ties to the smaller id; exact.

    The plan is the same for any number of queries. Rows without a vector, with one of another length than the
    queries' longest, or with one of zeros are no neighbours; of such queries those of zeros score 0 with all rows.
    Null ids are left out. ``k`` under 1 or no queries give no rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, id long, score double, rank int")
    asked, vector = queries.columns[:2]
    queries = queries.select(F.col(asked).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter("query_id IS NOT NULL AND v IS NOT NULL")
    dim = queries.agg(F.max(F.size("v"))).first()[0]
    if k < 1 or not dim:
        return empty
    queries = written(queries.filter(F.size("v") == dim), "knn-queries")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    n = rows.count()
    if not n:
        return empty
    few = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, math.isqrt(n)))).collect()
    centres = np.array([r["v"] for r in few], np.float64)
    balls = written(rows.mapInArrow(_placed(spark.sparkContext.broadcast(centres)), f"id long, v {rows.schema['v'].dataType.simpleString()}, ball int, angle double"), "knn-balls")
    stats = balls.groupBy("ball").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("ball").collect()  # a row for each pivot
    if not stats:
        return empty
    sizes = {r["ball"]: r["n"] for r in stats}
    column = lambda c, kind: np.array([r[c] for r in stats], kind)
    shared = spark.sparkContext.broadcast((centres, column("ball", np.int64), column("low", float), column("high", float), column("n", np.int64)))
    deal = lambda q: written(q.mapInArrow(_dealt(shared, k), "query_id long, v array<double>, ball int"), "knn-dealt")
    members = balls.select("id", "v", "ball")
    first = written(_top(_met(members, deal(queries.withColumn("reach", F.lit(None).cast("double"))), sizes, k), k).drop("rank"), "knn-first")
    least = F.greatest(F.least(F.min("score"), F.lit(1.0)), F.lit(-1.0))
    reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.acos(least)).otherwise(math.pi).alias("reach"))
    again = deal(queries.join(reach, "query_id").select("query_id", "v", "reach"))
    return _top(first.unionByName(_met(members, again, sizes, k)), k)
