"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import conversations_sql, langid, quality, toxicity
from foliospark.llm.common import bucket
from foliospark.llm.conversations import damage, repair
from foliospark.llm.decontaminate import RUN, contamination
from foliospark.llm.exact_dedup import exact_dedup
from foliospark.llm.line_dedup import WHOLE, dedup_lines
from foliospark.llm.mixing import mix
from foliospark.llm.outliers import judge
from foliospark.llm.pii import find_pii, pii_digest
from foliospark.llm.simhash import fingerprint_hex, simhash_groups
from foliospark.llm.warc import archive_pages, page_index, read_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def _judged(scored: DataFrame, held) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), bucket("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return _judged(quality.score_quality(docs.select("doc_id", "text", "n_chars"), model, keep=["doc_id"]), held)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), counts=True, **WHOLE)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.length("text").alias("n_chars"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), bucket("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return _judged(toxicity.score_toxicity(docs, model), held)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), bucket("doc_id", 5) == 0
    model = langid.fit(docs.filter(~held))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), run=RUN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_index(read_warc(spark, archive_pages(table(spark, sf_dir, "pages"))))


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), "doc_id")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")), present="present")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix": op4_mix,
    "op5_toxicity": op5_toxicity,
    "op6_langid": op6_langid,
    "op7_decontaminate": op7_decontaminate,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_outliers": op11_outliers,
    "op12_conversations": op12_conversations,
}


ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm""",
    "op12_conversations": conversations_sql.SQL,
}
