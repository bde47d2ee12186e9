"""Take documents into the corpus as their files arrive.

    python -m jobs.job1_ingest --documents PATH --output PATH --checkpoint PATH [--config FILE]

A file stream reads the files that came since the last run, normalises and fingerprints their texts, compares them
with what the corpus holds, and ends when nothing is left. Under ``output`` it writes

    chunks/batch=N/corpus_id=C    new texts and new versions of texts, with their fingerprints
    tally/batch=N                 for each corpus: inserts, updates, unchanged
    refused/batch=N               documents without an id, a text or a well-formed corpus, or with too long a text, and why

``current`` gives the corpus as it stands: of each locator the version of its last batch. A batch depends on its own
files, which the checkpoint holds, and on earlier batches only, and it replaces nothing but its own folders: one that
failed half-way is done again with the same result. A batch compares hashes of the corpora it touches, never texts.

Of documents with one corpus and locator in a batch the greatest fingerprint counts; between batches the later one.
Nothing is deleted: documents that no longer arrive stay.
"""

from __future__ import annotations

import argparse
import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import ingest
from foliospark.storage import shared_dir
from jobs import settings

NAME = "job1_ingest"
log = logging.getLogger(NAME)

#: Corpora of a batch that are named in a filter on partitions at most; a batch of more reads what is held of all.
MOST_CORPORA = 1000
CHUNKS = "locator string, text string, content_hash string, normalisation_version int, words int, action string, batch long, corpus_id string"


def _problem(config: dict) -> Column:
    """Why a record is refused; null where it is taken."""
    return (
        F.when(F.col("locator").isNull(), "no id").when(F.col("corpus_id").isNull(), "no corpus").when(~F.col("corpus_id").rlike(t.CORPUS_ID), "malformed corpus").when(t.is_blank(F.col("text")), "blank")
        .when(F.col("words") > config["longest_words"], "too long")
    )


def records(documents: DataFrame, config: dict) -> DataFrame:
    """corpus_id, locator, text, content_hash, normalisation_version, words, problem of documents."""
    parts = [F.lower(F.col(c).cast("string")) for c in config["corpus"]]
    rows = documents.select(
        F.concat(*[x for p in parts for x in (p, F.lit("-"))], F.lit(config["edition"])).alias("corpus_id"),  # null where a part is
        F.concat(F.lit(config["locator_prefix"]), F.col(config["id"]).cast("string")).alias("locator"), t.normalise(F.col(config["text"])).alias("text"))
    rows = rows.withColumns({"content_hash": t.fingerprint(F.col("text")), "normalisation_version": F.lit(t.NORMALISATION_VERSION), "words": t.word_count(F.col("text"))})
    return rows.withColumn("problem", _problem(config))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunks at ``path``, or none before the first batch."""
    try:
        return spark.read.schema(CHUNKS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(chunks: DataFrame) -> DataFrame:
    """corpus_id, locator, content_hash and batch of each locator's last version."""
    last = chunks.groupBy("corpus_id", "locator").agg(F.max(F.struct("batch", "content_hash")).alias("last"))
    return last.select("corpus_id", "locator", "last.*")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The corpus as it stands: corpus_id, locator, text, content_hash, normalisation_version, words, batch."""
    chunks = _read(spark, f"{output}/chunks")
    if chunks is None:
        chunks = spark.createDataFrame([], CHUNKS)
    return chunks.join(_latest(chunks).drop("content_hash"), ["corpus_id", "locator", "batch"], "left_semi").drop("action")


def _take(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """Write batch ``number``: its tables depend on its rows and on chunks of smaller numbers only."""
    spark = batch.sparkSession
    rows = records(batch, config).persist()
    try:
        rows.filter("problem IS NOT NULL").select("corpus_id", "locator", "problem").write.mode("overwrite").parquet(f"{output}/refused/batch={number}")
        good = rows.filter("problem IS NULL").drop("problem")
        best = good.groupBy("corpus_id", "locator").agg(F.max("content_hash").alias("content_hash"))
        before = _read(spark, f"{output}/chunks")
        if before is None:
            before = spark.createDataFrame([], CHUNKS)
        before = before.filter(F.col("batch") < number).select("corpus_id", "locator", "batch", "content_hash")
        touched = [r["corpus_id"] for r in best.select("corpus_id").distinct().limit(MOST_CORPORA + 1).collect()]
        if len(touched) <= MOST_CORPORA:  # only these corpora's files are read
            before = before.filter(F.col("corpus_id").isin(touched))
        held = _latest(before).select("corpus_id", "locator", "content_hash", F.lit(True).alias("has_embedding"))
        plan = ingest.ingest_plan(best, held).filter("action <> 'delete'").persist()
        try:
            ingest.plan_tally(plan).select("corpus_id", "inserts", "updates", "unchanged").write.mode("overwrite").parquet(f"{output}/tally/batch={number}")
            changed = plan.filter("action IN ('insert', 'update')").join(best, ["corpus_id", "locator"])
            out = good.dropDuplicates(["corpus_id", "locator", "content_hash"]).join(changed, ["corpus_id", "locator", "content_hash"])
            out.select("locator", "text", "content_hash", "normalisation_version", "words", "action", "corpus_id").write.mode("overwrite").partitionBy("corpus_id").parquet(f"{output}/chunks/batch={number}")
        finally:
            plan.unpersist()
        wrote = spark.read.parquet(f"{output}/tally/batch={number}").agg(F.count(F.lit(1)).alias("corpora"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inserts", "updates", "unchanged")]).first()
        log.info("batch %d: read %d documents of %d corpora; wrote %d new, %d changed; %d unchanged, %d refused", number, rows.count(), wrote["corpora"], wrote["inserts"], wrote["updates"], wrote["unchanged"], rows.filter("problem IS NOT NULL").count())
    finally:
        rows.unpersist()


def _pattern(path: str) -> str:
    """``path`` as a pattern that only it matches: a plain path of a file stream must be a folder, what a pattern matches may be a file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> int:
    """Take all files of ``documents`` that the checkpoint doesn't know; the number of batches that it took."""
    config = config or settings.load(NAME)
    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(documents))
    taken = []

    def take(batch: DataFrame, number: int) -> None:
        _take(batch, number, output, config)
        taken.append(number)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"{NAME}-{uuid.uuid4().hex}").start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("%s: %d batches from %s into %s", NAME, len(taken), documents, output)
    return len(taken)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after two runs over the whole table: the second finds nothing new."""
    at = f"{shared_dir(spark)}/{NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    return current(spark, f"{at}/out").select("corpus_id", "locator", "content_hash", "normalisation_version", "words", F.length("text").alias("chars"))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog=NAME, description="Take documents into the corpus as their files arrive.")
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args(arguments)
    config = settings.load(NAME, given.config)
    spark = settings.session(NAME)
    try:
        run(spark, given.documents, given.output, given.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
