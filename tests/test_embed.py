"""The model surface with invented models: batches, reruns after a failure, token counts of a hook."""

import hashlib

import pytest

from foliospark.operators import corpus, embed

SCHEMA = "id long, corpus_id string, text string, words int"


def _models():
    """Functions of functions, so that they travel to workers by value: a deterministic embedder, for which batches over 12 words are too large, and a tokenizer."""

    def invented():
        def model(texts):
            longest = max(len(t.split()) for t in texts)
            assert len(texts) == 1 or longest * len(texts) <= 12, texts
            return [[b / 255 for b in hashlib.md5(t.encode()).digest()[:4]] for t in texts]

        return model

    def letters():
        return lambda texts: [len(t) for t in texts]

    return invented, letters


invented, letters = _models()


@pytest.fixture
def chunks(spark):
    rows = [(i, f"c{i % 3}", " ".join(["w"] * (i % 9)) + f" t{i}") for i in range(60)] + [(100, "c0", None), (101, "c1", "long " * 40)]
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def test_vectors_of_a_backlog(spark, chunks, tmp_path):
    path = f"file://{tmp_path}/vectors"
    assert embed.embed_backlog(chunks, invented, "m", 4, path, budget=12) == 62
    rows = {r.chunk_id: r.embedding for r in embed.read_vectors(spark, path).collect()}
    for r in chunks.collect():
        assert rows[r.id] == pytest.approx(invented()([r.text or ""])[0], abs=1e-6)
    assert embed.embed_backlog(chunks, invented, "m", 4, path, budget=12) == 0  # nothing is missing
    assert embed.embed_backlog(chunks.filter("id < 5"), invented, "other", 4, path, budget=12) == 5  # another model's vectors don't count


def test_a_rerun_embeds_only_what_is_missing(spark, chunks, tmp_path):
    path = f"file://{tmp_path}/vectors"

    def fails():
        plain = invented()

        def model(texts):
            if any("t1" in t.split() for t in texts):  # of c1
                raise OSError("out of memory")
            return plain(texts)

        return model

    with pytest.raises(Exception, match="out of memory"):
        embed.embed_backlog(chunks, fails, "m", 4, path, budget=12, corpora=["c0", "c1", "c2"])
    held = {r.chunk_id for r in embed.read_vectors(spark, path).collect()}
    assert held == {r.id for r in chunks.filter("corpus_id = 'c0'").collect()}
    assert embed.embed_backlog(chunks, invented, "m", 4, path, budget=12, corpora=["c0", "c1", "c2"]) == 62 - len(held)
    ids = [r.chunk_id for r in embed.read_vectors(spark, path).collect()]
    assert len(ids) == len(set(ids)) == 62


def test_wrong_vectors_fail(spark, chunks, tmp_path):
    with pytest.raises(Exception, match="vectors of 3 numbers"):
        embed.embed_backlog(chunks, invented, "m", 3, f"file://{tmp_path}/vectors", budget=12)


def test_tokenizer_hook(spark, chunks):
    counted = embed.token_counts(chunks, letters, "id", "corpus_id")
    assert {r.id: r.words for r in counted.collect()} == {r.id: len(r.text or "") for r in chunks.collect()}
    got = {r.corpus_id: r.longest_words for r in corpus.token_stats(chunks, counted).collect()}
    assert got["c1"] == 200 and embed.token_counts(chunks.limit(0), letters, "id").collect() == []
