"""Works, chunks and vectors: joins and counts over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as t


def chunk_metadata(chunks: DataFrame, works: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with their work and each of their vectors' models; a chunk without a vector, or without a work, is not seen."""
    have = embeddings.select("chunk_id", "embedding_model", "dim")
    rows = chunks.withColumnRenamed("id", "chunk_id").drop("text").join(works, "corpus_id").join(have, "chunk_id")
    return rows.select("chunk_id", "corpus_id", "locator", "work", "author", "language", "text_form", "license", "content_hash", "normalisation_version", "embedding_model", "dim")


def existing_chunks(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Every chunk, and whether it has a vector of ``model``; the model is filtered before the outer join, so others don't count."""
    have = embeddings.filter(F.col("embedding_model") == model).select(F.col("chunk_id").alias("id"), F.lit(True).alias("has"))
    return chunks.join(have, "id", "left").select("id", "corpus_id", "locator", "content_hash", "normalisation_version", F.coalesce("has", F.lit(False)).alias("has_embedding"))


def embedding_backlog(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of ``model``; a rerun after a crash goes on from whatever was written."""
    have = embeddings.filter(F.col("embedding_model") == model).select(F.col("chunk_id").alias("id"))
    return chunks.join(have, "id", "left_anti").select("id", "corpus_id", "locator", "text")


def works_by_ids(works: DataFrame, ids: DataFrame) -> DataFrame:
    return works.join(ids.select("corpus_id").distinct(), "corpus_id", "left_semi")


def corpus_exists(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Whether each corpus has a chunk that retrieval can see: a half-ingested corpus has none."""
    seen = metadata.select("corpus_id").distinct().withColumn("seen", F.lit(True))
    return ids.select("corpus_id").distinct().join(seen, "corpus_id", "left").select("corpus_id", F.coalesce("seen", F.lit(False)).alias("found"))


def shared_locators(chunks: DataFrame) -> DataFrame:
    """Locators that more than one corpus has."""
    by = chunks.groupBy("locator").agg(F.countDistinct("corpus_id").alias("corpora"), F.min("corpus_id").alias("first_corpus"), F.max("corpus_id").alias("last_corpus"))
    return by.filter("corpora > 1")


def duplicate_locators(records: DataFrame) -> DataFrame:
    return records.groupBy("corpus_id", "locator").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def smallest_first(records: DataFrame) -> DataFrame:
    """Corpora with their chunk counts, the smallest first."""
    return records.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("chunk_count")).orderBy("chunk_count", "corpus_id")


def staged_counts(records: DataFrame, works: DataFrame) -> DataFrame:
    """Staged corpora whose stated chunk count is not the number of their records; loading refuses them."""
    n = records.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("found"))
    both = works.select("corpus_id", F.col("chunk_count").alias("stated")).join(n, "corpus_id", "full_outer")
    return both.select("corpus_id", F.coalesce("stated", F.lit(0)).cast("long").alias("stated"), F.coalesce("found", F.lit(0)).cast("long").alias("found")).filter("stated <> found")


def citation_sources(spec: DataFrame, works: DataFrame, labels: DataFrame) -> DataFrame:
    """Corpora of a filter spec as shown beside citations; those without a work are left out."""
    return spec.join(works, "corpus_id").join(labels, "corpus_id", "left").select("corpus_id", "tier", "work", "author", "license", F.coalesce("label", F.lit("")).alias("label"))


def locator_valid(records: DataFrame) -> DataFrame:
    """Which locators and corpus ids have the contract's shape."""
    return records.select("corpus_id", "locator", F.col("locator").rlike(t.LOCATOR).alias("locator_ok"), F.col("corpus_id").rlike(t.CORPUS_ID).alias("corpus_ok"))


def page_slice(rows: DataFrame, keys: list[str], page: int, size: int = 500) -> DataFrame:
    """The ``page``-th ``size`` rows (from 0) in order of ``keys``: a sorted prefix of bounded length, never a rank over all rows."""
    head = rows.orderBy(*keys).limit((page + 1) * size)
    return head.orderBy(*keys).offset(page * size)


def token_stats(chunks: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Chunks, median and longest word count of each corpus; of the ``words`` of ``counted`` (corpus_id, words), where a tokenizer has counted them."""
    words = counted or chunks.select("corpus_id", t.word_count(F.col("text")).alias("words"))
    return words.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("chunks"), F.percentile("words", 0.5).alias("median_words"), F.max("words").alias("longest_words"))


#: Forms whose counts show how archaic a text is.
REGISTER_FORMS = {"hath": r"(?i)\bhath\b", "doth": r"(?i)\bdoth\b", "eth_verbs": r"(?i)\b\w+eth\b", "has": r"(?i)\bhas\b", "does": r"(?i)\bdoes\b"}


def register_profile(chunks: DataFrame, forms: dict[str, str] = REGISTER_FORMS) -> DataFrame:
    """How often each form occurs in each corpus."""
    return chunks.groupBy("corpus_id").agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(name) for name, p in forms.items()])
