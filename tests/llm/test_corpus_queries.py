"""The registered queries on the smallest tables: those with SQL against it, all for their columns and rows."""

import os

import duckdb
import pytest

import corpus_pipeline
from foliospark.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

COLUMNS = {
    "op1_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op2_quality": {"doc_id", "held_out", "score", "predicted"}, "op4_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op6_langid": {"doc_id", "held_out", "lang_pred", "score"}, "op8_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op9_simhash": {"doc_id", "fingerprint", "component_id"}, "op10_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op11_outliers": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op12_conversations": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}
#: Queries that don't have a row for each document, by the table and the id that they have one for.
ROWS = {"op10_warc": ("pages", "page_id"), "op12_conversations": ("conversations", "conv_id")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert COLUMNS.get(name, {"doc_id"}) <= set(df.columns)
    table, key = ROWS.get(name, ("documents", "doc_id"))
    assert len(rows) == spark.read.parquet(f"{DIR}/{table}.parquet").select(key).distinct().count()
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for table in ("documents", "conversations"):
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
        want = c.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() == out.select("doc_id").distinct().count() > 100
