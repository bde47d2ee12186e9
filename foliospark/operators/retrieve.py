"""Retrieval: filtered neighbours, pinned rulings and the context budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.vectors import knn

# Context window, what is reserved in it, and characters of a token.
RESERVED_TOKENS, CHARS_PER_TOKEN = 2816, 3.5


def passage_budget(context: int = 8192) -> int:
    """Characters of passages that fit a context window."""
    return max(0, int((context - RESERVED_TOKENS) * CHARS_PER_TOKEN))


def search(embeddings: DataFrame, chunks: DataFrame, queries: DataFrame | list, spec: DataFrame, model: str, k: int) -> DataFrame:
    """query_id, chunk_id, corpus_id, locator, score, rank: the nearest chunks among those of the spec's corpora.

    Model and corpora are filtered before anything is ranked; texts are not read.
    """
    inside = chunks.select(F.col("id").alias("chunk_id"), "corpus_id", "locator").join(spec.select("corpus_id"), "corpus_id", "left_semi")
    pool = embeddings.filter(F.col("embedding_model") == model).select("chunk_id", "embedding").join(inside, "chunk_id", "left_semi")
    found = knn(pool, queries, k).withColumnRenamed("id", "chunk_id")
    return found.join(inside, "chunk_id").select("query_id", "chunk_id", "corpus_id", "locator", "score", "rank")


def pinned_rulings(loci: DataFrame, chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks that rulings point at; a ruling that resolves to no chunk with a vector is dropped."""
    have = embeddings.filter(F.col("embedding_model") == model).select(F.col("chunk_id").alias("id"))
    rows = chunks.join(loci, ["corpus_id", "locator"]).join(have, "id", "left_semi")
    return rows.select("locus", F.col("id").alias("chunk_id"), "corpus_id", "locator")


def context_budget(hits: DataFrame, pinned: DataFrame, spec: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """query_id, rank, chunk_id, corpus_id, locator, score, included, exclusion_reason of every candidate in order.

    Pinned chunks come first and always fit; then hits by score. A hit that doesn't fit costs nothing, and a
    later shorter one may still fit: that is a fold over a query's candidates, of which there are at most
    the search depth and the loci. A chunk counts once, at its first place.
    """
    sizes = chunks.select(F.col("id").alias("chunk_id"), F.length("text").alias("chars"))
    queries = hits.select("query_id").distinct()
    rulings = pinned.agg(F.collect_set(F.struct("chunk_id", "corpus_id", "locator")).alias("rulings"))  # one row: every query is given a profile's few rulings
    first = queries.crossJoin(rulings).select("query_id", F.explode("rulings").alias("r")).select("query_id", "r.*")
    rows = hits.select("query_id", "chunk_id", "corpus_id", "locator", "score", F.lit(1).alias("turn"), F.col("rank").alias("place"))
    rows = rows.unionByName(first.select("query_id", "chunk_id", "corpus_id", "locator", F.lit(None).cast("double").alias("score"), F.lit(0).alias("turn"), F.col("chunk_id").cast("int").alias("place")))
    once = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("turn", "place", "corpus_id", "locator")).alias("c"), F.max("score").alias("score"))
    tiers = spec.groupBy("corpus_id").agg(F.max_by("tier", "position").alias("tier"))
    wide = once.select("query_id", "chunk_id", "c.*", "score").join(sizes, "chunk_id").join(tiers, "corpus_id", "left")
    item = F.struct("turn", "place", "chunk_id", "corpus_id", "locator", "score", "chars", F.col("tier").isNotNull().alias("known"))
    lists = wide.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(s, x):
        fits = x["known"] & ((x["turn"] == 0) | (s["used"] + x["chars"] <= budget))
        return F.struct((s["used"] + F.when(fits, x["chars"]).otherwise(0)).cast("long").alias("used"), F.concat(s["fits"], F.array(fits)).alias("fits"))

    folded = lists.select("query_id", "items", F.aggregate("items", start, step, lambda s: s["fits"]).alias("fits"))
    out = folded.select("query_id", F.posexplode(F.arrays_zip("items", "fits")).alias("pos", "x"))
    reason = F.when(F.col("x.fits"), "").when(~F.col("x.items.known"), "corpus not in the filter spec").otherwise("context budget")
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "x.items.chunk_id", "x.items.corpus_id", "x.items.locator", "x.items.score", F.col("x.fits").alias("included"), reason.alias("exclusion_reason"))


def prompt_passages(candidates: DataFrame, chunks: DataFrame, delimiter: str = "<<<") -> DataFrame:
    """Passage blocks of each query's included candidates in order, and whether a text holds the delimiter, which refuses the prompt."""
    texts = chunks.select(F.col("id").alias("chunk_id"), "text")
    rows = candidates.filter("included").join(texts, "chunk_id")
    block = F.struct("rank", F.concat(F.lit("["), "corpus_id", F.lit(" "), "locator", F.lit("]\n"), "text").alias("block"))
    by = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.max(F.contains("text", F.lit(delimiter))).alias("refused"))
    return by.select("query_id", F.size("blocks").alias("passages"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("prompt"), "refused")


# How a prompt names its parts.
SCOPE_TITLE, OPEN_TITLE = "CORPORA IN SCOPE, AND THE STANCE TAKEN TOWARD EACH", "QUESTIONS THIS TRADITION HOLDS OPEN"
NO_PASSAGES = "No passages were retrieved for this question."


def build_prompts(queries: DataFrame, passages: DataFrame, spec: DataFrame, loci: DataFrame, rules: str, guidance: str = "", begin: str = "<<<", end: str = ">>>", failures: DataFrame | None = None) -> DataFrame:
    """query_id, system, user, refused: the two turns that are sent to a generator.

    queries (query_id, query); passages (query_id, rank, corpus_id, locator, tier, work, text) in order of rank;
    spec (corpus_id, tier, position) and loci (locus, corpus_id, locator) are what the system turn states after
    ``rules``, with ``guidance`` on open questions; failures (query_id, ord, line) are the last attempt's. A
    passage that holds a delimiter can't be framed and refuses its prompt.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "corpus_id", "locator")).cast("string")
    framed = F.concat(
        F.lit("PASSAGE "), place, F.lit("\ncorpus_id: "), "corpus_id", F.lit("\nlocator: "), "locator", F.lit("\ntier: "), F.coalesce("tier", F.lit("unspecified")),
        F.lit("\nwork: "), F.coalesce("work", F.lit("")), F.lit(f"\n{begin}\n"), "text", F.lit(f"\n{end}"),
    )
    rows = passages.select("query_id", "rank", "corpus_id", "locator", framed.alias("block"), (F.contains("text", F.lit(begin)) | F.contains("text", F.lit(end))).alias("holds"))
    inner = F.struct("rank", "corpus_id", "locator", "block")
    shown = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(inner)), lambda x: x["block"]), "\n\n").alias("shown"), F.max("holds").alias("refused"))
    listed = lambda df, order, line: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias("x"))
    scope = listed(spec, ["position", "corpus_id"], F.concat(F.lit("- "), "corpus_id", F.lit(" ("), "tier", F.lit(")"))).withColumnRenamed("x", "scope")
    held = listed(loci, ["locus"], F.concat(F.lit("- "), "locus", F.lit(": established by "), "corpus_id", F.lit(" "), "locator")).withColumnRenamed("x", "held")
    about = F.when(F.col("held") != "", F.concat(F.lit(f"{OPEN_TITLE}\n"), "held", F.lit(f"\n{guidance}" if guidance else "")))
    system = F.concat_ws("\n\n", F.lit(rules), F.concat(F.lit(f"{SCOPE_TITLE}\n"), "scope"), about)
    out = queries.join(shown, "query_id", "left").crossJoin(scope).crossJoin(held)  # two rows: a profile's lines, the same for every query
    parts = [F.coalesce("shown", F.lit(NO_PASSAGES)), F.concat(F.lit("QUESTION\n"), F.trim("query"))]
    if failures is not None:
        last = failures.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("failed"))
        out, parts = out.join(last, "query_id", "left"), [F.col("failed"), *parts]
    return out.select("query_id", system.alias("system"), F.concat_ws("\n\n", *parts).alias("user"), F.coalesce("refused", F.lit(False)).alias("refused"))
