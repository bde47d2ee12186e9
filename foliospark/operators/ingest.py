"""Ingestion: what staged records change in the tables, refusals, and the changed tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.storage import written

#: Fixed value: padded tokens of an embedding batch.
BATCH_BUDGET = 16_384
SAMPLE = 10


def fingerprint_diff(committed: DataFrame, acquired: DataFrame) -> DataFrame:
    """Locators on one side only, or with different fingerprints, by class; empty if both sides agree."""
    a = committed.select("corpus_id", "locator", F.col("sha256").alias("committed"))
    b = acquired.select("corpus_id", "locator", F.col("sha256").alias("acquired"))
    both = a.join(b, ["corpus_id", "locator"], "full_outer")
    kind = F.when(F.col("acquired").isNull(), "missing").when(F.col("committed").isNull(), "unexpected").when(F.col("committed") != F.col("acquired"), "mismatched")
    return both.withColumn("class", kind).filter("class IS NOT NULL").select("corpus_id", "locator", "class")


def diff_summary(diff: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Size of each class and its first ``sample`` locators, bytewise; ranks stop at the sample, so no class is gathered whole."""
    first = diff.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("locator", "corpus_id"))).filter(F.col("r") <= sample)
    shown = first.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "locator"))), lambda x: x["locator"]), ", ").alias("sample"))
    return diff.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(shown, "class")


def verify_report(diff: DataFrame, committed: DataFrame, acquired: DataFrame, manifests: DataFrame | None = None, fetched: DataFrame | None = None) -> DataFrame:
    """For each corpus of either side: counts of the three classes, whether chunk counts agree, and whether all is well.

    With ``manifests`` (corpus_id, diagnostic, expected_sha256, upstream_sha256) and ``fetched`` (corpus_id,
    upstream_sha256) also edition (matches, changed, gone, or unblessed without a manifest), which must match,
    and whether the bytes upstream are others, which is reported and fails nothing.
    """
    n = lambda df, name: df.groupBy("corpus_id").agg(F.count(F.lit(1)).alias(name))
    classes = diff.groupBy("corpus_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("missing", "unexpected", "mismatched")])
    rows = n(committed, "committed_count").join(n(acquired, "acquired_count"), "corpus_id", "full_outer").join(classes, "corpus_id", "left").na.fill(0)
    clean = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("mismatched") == 0)
    same = F.col("committed_count") == F.col("acquired_count")
    columns = ["corpus_id", "committed_count", "acquired_count", "missing", "unexpected", "mismatched", same.alias("count_ok")]
    if manifests is None:
        return rows.select(*columns, (clean & same).alias("ok"))
    held = acquired.select("corpus_id", F.col("locator").alias("diagnostic"), F.col("sha256").alias("found"))
    read = manifests.join(held, ["corpus_id", "diagnostic"], "left").select("corpus_id", "expected_sha256", "found", "upstream_sha256")
    rows = rows.join(read, "corpus_id", "left").join(fetched.select("corpus_id", F.col("upstream_sha256").alias("now")), "corpus_id", "left")
    edition = F.when(F.col("expected_sha256").isNull(), "unblessed").when(F.col("found").isNull(), "gone").when(F.col("found") != F.col("expected_sha256"), "changed").otherwise("matches")
    return rows.withColumn("edition", edition).select(
        *columns, "edition", F.coalesce(F.col("now") != F.col("upstream_sha256"), F.lit(False)).alias("upstream_drifted"), (clean & same & (F.col("edition") == "matches")).alias("ok"))


def manifest_mismatches(manifests: DataFrame, adapters: DataFrame, fields: list[str]) -> DataFrame:
    """corpus_id, field: where a blessed manifest and the code that acquires its corpus disagree; one was changed without the other."""
    other = adapters.select("corpus_id", *[F.col(f).alias(f"their_{f}") for f in fields])
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"their_{f}")), F.lit(f)) for f in fields]))
    return manifests.join(other, "corpus_id").select("corpus_id", F.explode(wrong).alias("field"))


def ingest_refusals(staged: DataFrame, committed: DataFrame) -> DataFrame:
    """corpus_id, refusal of staged corpora that may not be ingested: never blessed, or not what was blessed.

    Hashes are taken over the staged texts, not believed. A corpus with any missing, unexpected or mismatched
    locator is refused, and nothing of it is written.
    """
    corpora = staged.select("corpus_id").distinct()
    ours = committed.join(corpora, "corpus_id", "left_semi")
    now = staged.select("corpus_id", "locator", t.fingerprint(F.col("text")).alias("sha256"))
    n = fingerprint_diff(ours, now).groupBy("corpus_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("missing", "unexpected", "mismatched")])
    rows = corpora.join(ours.select("corpus_id").distinct().withColumn("known", F.lit(True)), "corpus_id", "left").join(n, "corpus_id", "left")
    moved = F.format_string("disagrees with what was blessed: %d missing, %d unexpected, %d mismatched", "missing", "unexpected", "mismatched")
    refusal = F.when(F.col("known").isNull(), "never blessed").when(F.col("missing").isNotNull(), moved)
    return rows.select("corpus_id", refusal.alias("refusal")).filter("refusal IS NOT NULL")


def corpus_status(committed: DataFrame, acquired: DataFrame) -> DataFrame:
    """unblessed, blessed or drifted, of each acquired corpus."""
    diff = fingerprint_diff(committed, acquired).select("corpus_id").distinct().withColumn("drift", F.lit(True))
    known = committed.select("corpus_id").distinct().withColumn("known", F.lit(True))
    rows = acquired.select("corpus_id").distinct().join(known, "corpus_id", "left").join(diff, "corpus_id", "left")
    return rows.select("corpus_id", F.when(F.col("known").isNull(), "unblessed").when(F.col("drift"), "drifted").otherwise("blessed").alias("status"))


def blessed_flag(staged: DataFrame, committed: DataFrame) -> DataFrame:
    """Whether each staged chunk's hash is the committed one; null where its locator has none."""
    c = committed.select("corpus_id", "locator", "sha256")
    return staged.join(c, ["corpus_id", "locator"], "left").select("corpus_id", "locator", (F.col("sha256") == F.col("content_hash")).alias("blessed"))


def ingest_plan(staged: DataFrame, existing: DataFrame) -> DataFrame:
    """insert, update, delete, unchanged or unembedded (unchanged, but without a vector), for each locator."""
    a = staged.select("corpus_id", "locator", F.col("content_hash").alias("new"))
    b = existing.select("corpus_id", "locator", F.col("content_hash").alias("old"), "has_embedding")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").when(~F.col("has_embedding"), "unembedded").otherwise("unchanged")
    return a.join(b, ["corpus_id", "locator"], "full_outer").select("corpus_id", "locator", action.alias("action"))


def plan_tally(plan: DataFrame) -> DataFrame:
    """Counts of a plan for each corpus; unembedded chunks count as unchanged too, and the backlog is what needs a vector."""
    n = {a: F.count_if(F.col("action") == a) for a in ("insert", "update", "delete", "unchanged", "unembedded")}
    return plan.groupBy("corpus_id").agg(
        n["insert"].alias("inserts"), n["update"].alias("updates"), n["delete"].alias("deletes"), (n["unchanged"] + n["unembedded"]).alias("unchanged"), n["unembedded"].alias("unembedded"),
        (n["insert"] + n["update"] + n["unembedded"]).alias("backlog"), (n["insert"] + n["update"] + n["delete"]).alias("writes"),
        ((n["insert"] + n["update"] + n["delete"] + n["unembedded"]) == 0).alias("converged"),
    )


def contract_change(existing: DataFrame, version: int = t.NORMALISATION_VERSION) -> DataFrame:
    """Corpora whose chunks all have one contract version, and another than ``version``."""
    by = existing.groupBy("corpus_id").agg(F.min("normalisation_version").alias("stored"), F.max("normalisation_version").alias("top"))
    return by.filter((F.col("stored") == F.col("top")) & (F.col("stored") != version)).select("corpus_id", "stored", F.lit(version).alias("staged"))


def over_limit(staged: DataFrame, limit: int) -> DataFrame:
    """Corpora to refuse, with their numbers of chunks over ``limit`` words and the first SAMPLE of them by locator."""
    words = staged.select("corpus_id", "locator", t.word_count(F.col("text")).alias("words"))
    total = words.groupBy("corpus_id").agg(F.count_if(F.col("words") > limit).alias("over"), F.count(F.lit(1)).alias("chunks")).filter("over > 0")
    first = words.filter(F.col("words") > limit).withColumn("r", F.row_number().over(Window.partitionBy("corpus_id").orderBy("locator"))).filter(F.col("r") <= SAMPLE)
    shown = first.groupBy("corpus_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "locator", "words"))), lambda x: F.concat(x["locator"], F.lit(" ("), x["words"], F.lit(")"))), ", ").alias("sample"))
    return total.join(shown, "corpus_id")


def apply_text(chunks: DataFrame, staged: DataFrame, version: int = t.NORMALISATION_VERSION) -> DataFrame:
    """The chunks after ingestion of ``staged``: updated in place, deleted where no longer staged, new ones with ids above all others.

    New ids follow (corpus_id, locator); the ranks come from a distributed sort, not from one task. Where both sides come
    without texts, so do the chunks; with them, what is staged is read with its texts once.
    """
    text = [c for c in ("text",) if c in staged.columns]
    old = chunks.select("id", "corpus_id", "locator", *[F.col(c).alias("o_text") for c in text], F.col("content_hash").alias("o_hash"), F.col("normalisation_version").alias("o_version"))
    rows = staged.select("corpus_id", "locator", *text, "content_hash").join(old, ["corpus_id", "locator"], "left")
    same = F.col("content_hash") == F.col("o_hash")
    top = chunks.agg(F.max("id")).first()[0] or 0
    # places in a distributed sort: of the row in its partition, after the rows of the partitions before
    keys = rows.filter("id IS NULL").select("corpus_id", "locator").orderBy("corpus_id", "locator").withColumn("at", F.monotonically_increasing_id())
    keys = written(keys, "new-chunks").withColumns({"part": F.shiftright("at", 33), "in_part": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    ids = keys.join(before, "part").select("corpus_id", "locator", (F.col("in_part") + F.col("before") + top + 1).alias("id"))
    rows = rows.join(ids.withColumnRenamed("id", "new_id"), ["corpus_id", "locator"], "left")  # which has only locators that have no id
    return rows.select(
        F.coalesce("id", "new_id").alias("id"), "corpus_id", "locator", *[F.when(same, F.col("o_text")).otherwise(F.col(c)).alias(c) for c in text], "content_hash",
        F.when(same, F.col("o_version")).otherwise(F.lit(version)).alias("normalisation_version"))


def stale_vectors(embeddings: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Vectors to drop: of chunks that went, and of chunks whose text is another now; an update does not take them along by itself."""
    fresh = before.select("id", "content_hash").join(after.select("id", "content_hash"), ["id", "content_hash"], "left_semi").select(F.col("id").alias("chunk_id"))
    return embeddings.join(fresh, "chunk_id", "left_anti").select("chunk_id", "embedding_model")


def works_upsert(works: DataFrame, staged: DataFrame) -> DataFrame:
    """Works after an upsert by corpus_id: staged facts win, null ones too; ingested_at stays where there was one."""
    facts = [c for c in staged.columns if c != "corpus_id"]
    new = staged.select("corpus_id", F.struct(*facts).alias("new"))
    old = works.select("corpus_id", F.struct(*facts).alias("old"), "ingested_at")
    rows = new.join(old, "corpus_id", "full_outer")
    return rows.select("corpus_id", *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in facts], "ingested_at")


def _fold(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """One corpus's counts by length -> the batch number and fill in which each length begins."""
    batch, fill, rows = 0, 0, []
    for words, n in sorted(zip(pdf["words"].tolist(), pdf["n"].tolist(), strict=True)):
        room = max(1, budget // max(words, 1)) if words else n + fill
        rows.append((pdf["corpus_id"].iloc[0], words, batch, fill, room))
        if fill and fill >= room:
            batch, fill = batch + 1, 0
        free = room - fill
        if n <= free:
            fill += n
        else:
            more, last = divmod(n - free, room)
            batch, fill = (batch + more + 1, last) if last else (batch + more, room)
    return pd.DataFrame(rows, columns=["corpus_id", "words", "batch0", "fill0", "room"])


#: Ids of a stretch, within which rows of a length are numbered by one task.
STRETCH = 1 << 16


def batch_pack(backlog: DataFrame, budget: int = BATCH_BUDGET) -> DataFrame:
    """id, corpus_id, words, batch: shortest first, a batch ends when one more would pad it beyond ``budget`` words.

    Batches follow from the counts of each length, which are folded corpus by corpus; rows then find their
    batch by their rank among those of their length: the rows of earlier stretches of ids, and their place in
    their own. So neither a corpus nor a length is gathered.
    """
    rows = written(backlog.select("id", "corpus_id", t.word_count(F.col("text")).cast("long").alias("words"), F.floor(F.col("id") / STRETCH).alias("stretch")), "batch-words")
    parts = rows.groupBy("corpus_id", "words", "stretch").agg(F.count(F.lit(1)).alias("n"))
    counts = parts.groupBy("corpus_id", "words").agg(F.sum("n").alias("n"))
    starts = counts.groupBy("corpus_id").applyInPandas(lambda pdf: _fold(pdf, budget), "corpus_id string, words long, batch0 long, fill0 long, room long")
    before = F.sum("n").over(Window.partitionBy("corpus_id", "words").orderBy("stretch")) - F.col("n")
    starts = parts.select("corpus_id", "words", "stretch", before.alias("before")).join(starts, ["corpus_id", "words"])
    place = F.row_number().over(Window.partitionBy("corpus_id", "words", "stretch").orderBy("id")) - 1
    ranked = rows.withColumn("place", place).join(starts, ["corpus_id", "words", "stretch"])
    full = (F.col("fill0") > 0) & (F.col("fill0") >= F.col("room"))
    seat = F.col("before") + F.col("place") + F.when(full, 0).otherwise(F.col("fill0"))
    batch = F.col("batch0") + F.when(full, 1).otherwise(0) + F.floor(seat / F.col("room"))
    return ranked.select("id", "corpus_id", "words", batch.cast("long").alias("batch"))


def write_embeddings(vectors: DataFrame, model: str, dim: int, path: str) -> None:
    """Append a batch of vectors (chunk_id, embedding) of ``model``: all of it or, if a vector has another length than ``dim`` or the write fails, nothing."""
    if odd := vectors.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).take(1):
        raise ValueError(f"the vector of chunk {odd[0]['chunk_id']} does not have {dim} numbers")
    rows = vectors.select("chunk_id", F.lit(model).alias("embedding_model"), F.lit(dim).alias("dim"), F.col("embedding").cast("array<float>"))
    rows.write.mode("append").parquet(path)
