"""Bounded samples of labelled rows, drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int, *more: str) -> DataFrame:
    """text, label and ``more`` columns of at most ``limit`` ids that ``allowed`` (over doc_id) lets in, a row each: of texts that share an id the least, of the other columns the greatest.

    Ids whose labels are null or disagree are left out.
    """
    one = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(allowed & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    one = one.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top")
    drawn = one.orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(limit).select("doc_id", "label")  # at most limit rows, so it can be broadcast
    texts = docs.select("doc_id", "text", *more).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"), *[F.max(c).alias(c) for c in more]).select("text", "label", *more)
