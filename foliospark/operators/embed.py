"""Models on chunks: a tokenizer that counts and an embedder that takes padded batches, each loaded once by a worker.

A model is a function of no arguments that returns a function of a list of texts. It is called by the worker that
needs it, once for each of its tasks' streams of batches, so what it loads (weights, vocabularies) never travels with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.operators import corpus, ingest

Tokenizer = Callable[[], Callable[[list[str]], Sequence[int]]]
Embedder = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]

#: Texts that a tokenizer is given at once.
TOGETHER = 500
VECTORS = "chunk_id long, embedding_model string, dim int, embedding array<float>"


def token_counts(chunks: DataFrame, load: Tokenizer, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``words``, the number of tokens of ``text``; a null text has none."""
    rows = chunks.select(*keep, "text")
    schema = rows.drop("text").schema.add("words", "long")

    def run(batches):
        count = load()
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.record_batch([*part.columns[:-1], pa.array([int(n) for n in count(texts)], pa.int64())], names=[*keep, "words"])

    return rows.mapInArrow(run, schema)


def embed(backlog: DataFrame, load: Embedder, dim: int, budget: int = ingest.BATCH_BUDGET) -> DataFrame:
    """chunk_id, embedding of the chunks (id, corpus_id, text): whole padded batches of ``batch_pack`` reach the model, one at a time.

    A batch is held by one task, and never more than one. A model that returns another number of vectors, or vectors of
    another length than ``dim``, fails the task.
    """
    backlog = backlog.select("id", "corpus_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = ingest.batch_pack(backlog, budget).select("id", "batch").join(backlog, "id")
    rows = rows.select("corpus_id", "batch", "id", "text").repartition("corpus_id", "batch").sortWithinPartitions("corpus_id", "batch", "id")
    kind = to_arrow_type(rows.schema["id"].dataType)

    def run(batches):
        model, key, ids, texts = load(), None, [], []

        def done():
            made = [[float(x) for x in v] for v in model(texts)]
            if len(made) != len(texts) or any(len(v) != dim for v in made):
                raise ValueError(f"the model did not return {len(texts)} vectors of {dim} numbers")
            return pa.record_batch([pa.array(ids, kind), pa.array(made, pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

        for b in batches:
            for own, number, one, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (own, number) != key and ids:
                    yield done()
                    ids, texts = [], []
                key = (own, number)
                ids.append(one)
                texts.append(text)
        if ids:
            yield done()

    return rows.mapInArrow(run, f"chunk_id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors written so far; none before the first run."""
    try:
        return spark.read.schema(VECTORS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VECTORS)


def embed_backlog(chunks: DataFrame, load: Embedder, model: str, dim: int, path: str, budget: int = ingest.BATCH_BUDGET, corpora: list[str] | None = None) -> int:
    """Append vectors of ``model`` for the chunks (id, corpus_id, text) that have none under ``path``; how many.

    With ``corpora`` they are worked off in turn, each in an append of its own: a run that fails keeps what it has
    written, and the next one embeds only what is missing.
    """
    spark = chunks.sparkSession
    total = 0
    for part in corpora or [None]:
        mine = chunks if part is None else chunks.filter(F.col("corpus_id") == part)
        missing = corpus.embedding_backlog(mine.withColumn("locator", F.lit("")), read_vectors(spark, path), model).select("id", "corpus_id", "text")
        before = read_vectors(spark, path).filter(F.col("embedding_model") == model).count()
        made = embed(missing, load, dim, budget)
        made.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lit(model).alias("embedding_model"), F.lit(dim).alias("dim"), "embedding").write.mode("append").parquet(path)
        total += read_vectors(spark, path).filter(F.col("embedding_model") == model).count() - before
    return total
