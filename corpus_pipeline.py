"""The corpus pipeline: stages applied one after another to whole tables of documents.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
documents; the last adds what the mix takes of each. Stages call the corpus operators and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import quality
from foliospark.llm.common import bucket, cut, unused
from foliospark.llm.decontaminate import RUN, decontaminate
from foliospark.llm.line_dedup import WHOLE, dedup_lines
from foliospark.llm.mixing import mix
from foliospark.llm.simhash import near_dedup

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5
#: Near-duplicates: shingles of so many words, resemblance at least so high.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, bucket("doc_id", 4) != 2)  # the same fold is held out as in op2
    score = unused(docs, "score")
    return quality.score_quality(docs, model, score_col=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, **WHOLE)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, words=SHINGLE, similarity=SIMILARITY)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), run=RUN)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, keep=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixing", mix_stage),
]

#: A fitted model, similarity joins and a draw are not SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written in the shared folder and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
