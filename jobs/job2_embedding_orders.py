"""Write the orders of an embedding run: every document without a vector, packed into padded batches of its corpus.

    python -m jobs.job2_embedding_orders --documents PATH --embeddings PATH --output PATH [--config FILE]

Documents that have a vector are left out by an anti-join of ids; the rest go into batches, shortest first, a batch
ending when one more document would pad it beyond ``budget`` words. Under ``output`` it writes

    orders/corpus_id=C    id, words, batch: what an embedding worker takes
    summary               for each corpus: documents, batches, words, padded words, and the share that is padding

Both tables are replaced whole, and follow from the inputs alone: a rerun writes the same rows, one that failed is
run again. Documents without an id or a corpus have no order.
"""

from __future__ import annotations

import argparse
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import corpus, ingest
from foliospark.storage import shared_dir
from jobs import settings

NAME = "job2_embedding_orders"
log = logging.getLogger(NAME)
#: The test tables' vectors are all of one model.
MODEL = "m1"


def backlog(documents: DataFrame, embeddings: DataFrame, config: dict) -> DataFrame:
    """id, corpus_id, text of documents without a vector."""
    parts = [F.col(c).cast("string") for c in config["corpus"]]
    chunks = documents.select(F.col(config["id"]).alias("id"), F.concat(*[x for p in parts for x in (p, F.lit("-"))], F.lit(config["edition"])).alias("corpus_id"), F.lit("").alias("locator"), F.coalesce(config["text"], F.lit("")).alias("text"))
    vectors = embeddings.select(F.col(config["vector_id"]).alias("chunk_id"), F.lit(MODEL).alias("embedding_model"))
    return corpus.embedding_backlog(chunks.filter("id IS NOT NULL AND corpus_id IS NOT NULL"), vectors, MODEL).select("id", "corpus_id", "text")


def summary(orders: DataFrame) -> DataFrame:
    """What each corpus's batches hold, and how much of them is padding."""
    batches = orders.groupBy("corpus_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("longest"), F.sum("words").alias("words"))
    by = batches.groupBy("corpus_id").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("batches"), F.sum("words").alias("words"), F.sum(F.col("n") * F.col("longest")).alias("padded"))
    return by.withColumn("padding", F.when(F.col("padded") > 0, 1 - F.col("words") / F.col("padded")).otherwise(0.0))


def run(spark: SparkSession, documents: str, embeddings: str, output: str, config: dict | None = None) -> None:
    """Replace the orders and their summary under ``output``."""
    config = config or settings.load(NAME)
    waiting = backlog(spark.read.parquet(documents), spark.read.parquet(embeddings), config)
    orders = ingest.batch_pack(waiting, config["budget"])
    # a corpus of any size is written by several tasks; small ones don't leave a file for each task
    dealt = orders.repartition("corpus_id", F.pmod(F.xxhash64("id"), F.lit(config["files_per_corpus"])))
    dealt.sortWithinPartitions("corpus_id", "batch", "id").write.mode("overwrite").partitionBy("corpus_id").parquet(f"{output}/orders")
    wrote = spark.read.schema(orders.schema).parquet(f"{output}/orders")
    summary(wrote).write.mode("overwrite").parquet(f"{output}/summary")
    n = spark.read.parquet(f"{output}/summary").agg(F.count(F.lit(1)).alias("corpora"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "batches", "words", "padded")]).first()
    log.info("%s: read %s and %s; wrote %d documents of %d corpora in %d batches, %d words padded to %d, into %s", NAME, documents, embeddings, n["documents"], n["corpora"], n["batches"], n["words"], n["padded"], output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders after two runs into the same folder."""
    at = f"{shared_dir(spark)}/{NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet", at)
    return spark.read.schema("id long, words long, batch long, corpus_id string").parquet(f"{at}/orders")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog=NAME, description="Write the orders of an embedding run.")
    for name in ("documents", "embeddings", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args(arguments)
    config = settings.load(NAME, given.config)
    spark = settings.session(NAME)
    try:
        run(spark, given.documents, given.embeddings, given.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
