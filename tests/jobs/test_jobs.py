"""Both jobs over growing copies of the test tables, after failures, and against their SQL."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import job1_ingest, job2_embedding_orders, settings
from jobs.registered import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, path, rows):
    """A further file of documents (doc_id, text, lang, source)."""
    spark.createDataFrame([(*r, 0) for r in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def tally(spark, output):
    rows = spark.read.parquet(f"{output}/tally").groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("inserts", "updates", "unchanged")])
    return {r.batch: tuple(r[1:]) for r in rows.collect()}


def corpus(spark, output):
    return {(r.corpus_id, r.locator): (r.text, r.batch) for r in job1_ingest.current(spark, output).collect()}


def paths(tmp_path):
    return tuple(f"file://{tmp_path}/{x}" for x in ("docs", "out", "checkpoint"))


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = QUERIES[name](spark, DIR)
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    rows = sorted(map(tuple, df.select(*want.columns).collect()))
    assert rows == sorted(want.fetchall()) and (rows or name == job2_embedding_orders.NAME)
    assert before == {k: spark.conf.get(k) for k in before}


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    docs, out, checkpoint = paths(tmp_path)
    add(spark, docs, [(1, "First  text.", "en", "a"), (2, "Second.", "EN", "a"), (3, " ​\n", "en", "a"), (None, "x", "en", "a"), (4, "y", None, "a"), (5, "z", "e n", "a"), (6, "Other.", "de", "b")])
    assert job1_ingest.run(spark, docs, out, checkpoint) == 1
    assert corpus(spark, out) == {("a-en-invented", "DOC 1"): ("First text.", 0), ("a-en-invented", "DOC 2"): ("Second.", 0), ("b-de-invented", "DOC 6"): ("Other.", 0)}
    refused = spark.read.parquet(f"{out}/refused").collect()
    assert sorted((r.locator or "", r.problem) for r in refused) == [("", "no id"), ("DOC 3", "blank"), ("DOC 4", "no corpus"), ("DOC 5", "malformed corpus")]
    assert job1_ingest.run(spark, docs, out, checkpoint) == 0  # nothing new
    add(spark, docs, [(1, "First text.", "en", "a"), (2, "Second, changed.", "en", "a"), (7, "Seventh.", "en", "a"), (7, "Seventh.", "en", "a")])
    assert job1_ingest.run(spark, docs, out, checkpoint) == 1
    assert tally(spark, out) == {0: (3, 0, 0), 1: (1, 1, 1)}
    assert corpus(spark, out) == {("a-en-invented", "DOC 1"): ("First text.", 0), ("a-en-invented", "DOC 2"): ("Second, changed.", 1), ("a-en-invented", "DOC 7"): ("Seventh.", 1), ("b-de-invented", "DOC 6"): ("Other.", 0)}
    assert {f.split("/batch=1/")[1].split("/")[0] for f in spark.read.schema(job1_ingest.CHUNKS).parquet(f"{out}/chunks").inputFiles() if "/batch=1/" in f} == {"corpus_id=a-en-invented"}  # other corpora's files stay as they are


def test_a_batch_that_failed_is_done_again_with_the_same_result(spark, tmp_path, monkeypatch):
    docs, out, checkpoint = paths(tmp_path)
    config = settings.load(job1_ingest.NAME) | {"files_per_batch": 1}
    for i in range(3):
        add(spark, docs, [(1, f"Version {i}.", "en", "a"), (10 + i, f"Own text {i}.", "en", "a")])
    whole = f"file://{tmp_path}/whole"
    assert job1_ingest.run(spark, docs, whole, f"file://{tmp_path}/other", config) == 3
    wants = corpus(spark, whole)
    plain, calls = job1_ingest.ingest.plan_tally, []

    def fails(plan):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no space")
        return plain(plan)

    monkeypatch.setattr(job1_ingest.ingest, "plan_tally", fails)
    with pytest.raises(Exception, match="no space"):
        job1_ingest.run(spark, docs, out, checkpoint, config)
    assert len(corpus(spark, out)) == 2
    assert job1_ingest.run(spark, docs, out, checkpoint, config) == 2
    assert corpus(spark, out) == wants and tally(spark, out) == tally(spark, whole)
    job1_ingest._take(spark.read.schema(DOCS).parquet(sorted(spark.read.parquet(docs).inputFiles())[0]), 3, out, config)  # and a batch that is written twice
    once = corpus(spark, out)
    job1_ingest._take(spark.read.schema(DOCS).parquet(sorted(spark.read.parquet(docs).inputFiles())[0]), 3, out, config)
    assert corpus(spark, out) == once


def test_ingest_of_an_empty_table(spark, tmp_path):
    docs, out, checkpoint = paths(tmp_path)
    add(spark, docs, [])
    job1_ingest.run(spark, docs, out, checkpoint)
    assert corpus(spark, out) == {}


def test_orders_of_growing_tables(spark, tmp_path):
    docs, out, _ = paths(tmp_path)
    vectors = f"file://{tmp_path}/vectors"
    config = settings.load(job2_embedding_orders.NAME) | {"budget": 6}
    spark.createDataFrame([(2, [0.5], 1)], "vec_id long, embedding array<float>, label long").write.parquet(vectors)
    add(spark, docs, [(1, "one two three", "en", "a"), (2, "has a vector", "en", "a"), (3, "one two", "en", "a"), (4, None, "en", "a"), (5, "x y z", "en", "a"), (None, "no id", "en", "a"), (6, "no corpus", None, "a"), (8, "far", "de", "b")])

    def orders():
        job2_embedding_orders.run(spark, docs, vectors, out, config)
        return sorted((r.corpus_id, r.batch, r.id, r.words) for r in spark.read.parquet(f"{out}/orders").collect())

    first = orders()
    assert first == [("a-en-invented", 0, 3, 2), ("a-en-invented", 0, 4, 0), ("a-en-invented", 1, 1, 3), ("a-en-invented", 1, 5, 3), ("b-de-invented", 0, 8, 1)]
    assert orders() == first
    s = {r.corpus_id: r for r in spark.read.parquet(f"{out}/summary").collect()}["a-en-invented"]
    assert (s.documents, s.batches, s.words, s.padded) == (4, 2, 8, 10) and abs(s.padding - 0.2) < 1e-9
    spark.createDataFrame([(8, [0.5], 1)], "vec_id long, embedding array<float>, label long").write.mode("append").parquet(vectors)
    assert [r for r in orders() if r[0].startswith("b")] == []  # a corpus that is done leaves no orders behind
    assert {r.corpus_id for r in spark.read.parquet(f"{out}/summary").collect()} == {"a-en-invented"}


def test_settings(tmp_path):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"budget": 7}))
    assert settings.load(job2_embedding_orders.NAME, str(own))["budget"] == 7
    own.write_text(json.dumps({"bugdet": 7}))
    with pytest.raises(ValueError, match="bugdet"):
        settings.load(job2_embedding_orders.NAME, str(own))


def test_command_lines(monkeypatch, spark, tmp_path):
    docs, out, checkpoint = paths(tmp_path)
    add(spark, docs, [(1, "Text.", "en", "a")])

    class Kept:
        """The tests' session, which a command line must not stop."""

        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            self.stopped = True

    kept = Kept()
    monkeypatch.setattr(settings, "session", lambda name: kept)
    job1_ingest.main(["--documents", docs, "--output", out, "--checkpoint", checkpoint])
    assert len(corpus(spark, out)) == 1 and kept.stopped


@needs_tables
def test_ingest_of_a_table_that_grows_is_the_whole_table(spark, tmp_path):
    """Two runs over copies of the documents, the second with the rest of them, give what SQL says of all."""
    docs, out, checkpoint = paths(tmp_path)
    whole = spark.read.parquet(f"{DIR}/documents.parquet")
    for part in (whole.filter("doc_id % 3 <> 0"), whole.filter("doc_id % 3 = 0")):
        part.coalesce(1).write.mode("append").parquet(docs)
        assert job1_ingest.run(spark, docs, out, checkpoint) == 1
    assert tally(spark, out)[0][0] + tally(spark, out)[1][0] == job1_ingest.current(spark, out).count()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = c.sql(ORACLE_SQL[job1_ingest.NAME])
    got = job1_ingest.current(spark, out).withColumn("chars", F.length("text")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
