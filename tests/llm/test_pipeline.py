import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean prose, junk, exact and near copies, a shared line and benchmark passages."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(1500)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = line(30)
    shared = line(60)
    rows, labels, kind = [], [], {}
    for i in range(240):
        text = "\n".join(line(r.randint(12, 40)) for _ in range(r.randint(2, 5)))
        what = "clean"
        if i % 6 == 1:
            text, what = " ".join(w.upper() + "!!" for w in text.split()), "junk"
        elif i % 24 == 2:
            text, what = f"{text}\n{shared}", "line"
        elif i % 24 == 3:
            text, what = f"{text} {item} {line(8)}", "leak"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(what != "junk"), 0))
        kind[i] = what
    for i in range(0, 40, 6):
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "other"
        for n, t in ((1000, rows[i][1]), (2000, " ".join(words))):
            rows.append((n + i, t, "en", "s0", len(t)))
            kind[n + i] = "copy"
    rows += [(5000, None, None, None, None), (5001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kind, shared, item


def test_stages_take_effect(spark, corpus):
    folder, kind, shared, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, folder)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        seen[name] = before, after
        if name != "source_mixing":
            assert docs.columns == COLUMNS
    before, after = seen["quality_classifier"]
    assert {i for i in before if i not in after and kind.get(i)} == {i for i, k in kind.items() if k == "junk"}
    before, after = seen["line_dedup"]
    assert before.keys() == after.keys() and sum(shared in (t or "") for t in after.values()) == 1
    assert all(after[i] == before[i] for i, k in kind.items() if k == "clean" and i in before)
    before, after = seen["simhash_near_dedup"]
    gone = before.keys() - after.keys()
    for i in gone:
        assert any(len(shingles(before[i]) & shingles(before[j])) >= 0.7 * len(shingles(before[i]) | shingles(before[j])) for j in after)
    assert all(i in after for i, k in kind.items() if k == "clean" and i in before)
    before, after = seen["benchmark_decontamination"]
    assert {i for i in before if item in (before[i] or "")} == before.keys() - after.keys()
    before, after = seen["source_mixing"]
    assert before.keys() == after.keys()
    totals = docs.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 60 for r in totals)


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == [*COLUMNS, "size", "source_size", "target", "copies", "taken"]
    assert out.count() == out.select("doc_id").distinct().count() > 100


def test_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
