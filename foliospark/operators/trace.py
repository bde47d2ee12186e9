"""The audit trace: its tables, their constraints, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark import schema as s
from foliospark.storage import written


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def _iff(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def constraints() -> dict[str, dict[str, Column]]:
    """What must hold of every row, by table and name of the constraint."""
    outcome = F.col("overall_result")
    failed = outcome == "generation-failed"
    return {
        "responses": {
            "responses_answer_absent_iff_generation_failed": _iff(F.col("answer").isNull(), failed),
            "responses_attempts_check": F.col("attempts").isin(1, 2),
            "responses_confidence_absent_iff_generation_failed": _iff(F.col("confidence_level").isNull(), failed),
            "responses_confidence_reason_not_blank": F.col("confidence_level").isNull() | ~_blank("confidence_reason"),
            "responses_degraded_is_second_attempt": (outcome != "degraded") | (F.col("attempts") == 2),
            "responses_gateway_version_present": ~_blank("gateway_version"),
            "responses_generation_failed_is_second_attempt": ~failed | (F.col("attempts") == 2),
            "responses_profile_check": ~_blank("profile"),
            "responses_query_check": ~_blank("query"),
            "responses_regenerated_is_second_attempt": (outcome != "regenerated") | (F.col("attempts") == 2),
            "responses_verified_is_first_attempt": (outcome != "verified") | (F.col("attempts") == 1),
        },
        "traces": {
            "traces_attempt_check": F.col("attempt").isin(1, 2),
            "traces_dim_check": F.col("dim") > 0,
            "traces_embed_ms_check": F.col("embed_ms") >= 0,
            "traces_embedding_model_check": ~_blank("embedding_model"),
            "traces_generate_ms_check": F.col("generate_ms") >= 0,
            "traces_generation_model_check": ~_blank("generation_model"),
            "traces_rewritten_query_check": ~_blank("rewritten_query"),
            "traces_search_ms_check": F.col("search_ms") >= 0,
            "traces_top_k_check": F.col("top_k") > 0,
            "traces_verify_us_non_negative": F.col("verify_us").isNull() | (F.col("verify_us") >= 0),
        },
        "candidates": {
            "candidates_corpus_id_check": ~_blank("corpus_id"),
            "candidates_locator_check": ~_blank("locator"),
            "candidates_rank_check": F.col("rank") > 0,
            "candidates_reason_iff_excluded": _iff(F.col("included"), _blank("exclusion_reason")),
        },
        "verification_results": {
            "verification_results_detail_iff_failure": _iff(F.col("locator_resolved") & F.col("quote_matched") & F.col("tier_permitted") & F.col("license_permitted"), _blank("failure_detail")),
        },
        "answer_failures": {
            "answer_failures_detail_check": ~_blank("detail"),
            "answer_failures_ref_is_whole_or_absent": _iff(_blank("corpus_id"), _blank("locator")),
            "answer_failures_slot_check": ~_blank("slot"),
        },
        "generation_failures": {
            "generation_failures_completion_tokens_check": F.col("completion_tokens") >= 0,
            "generation_failures_detail_check": ~_blank("detail"),
        },
    }


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, constraint, request_id of every broken constraint; a write is refused unless this is empty. Each table is read once."""
    out = None
    for table, rules in constraints().items():
        if table not in tables:
            continue
        broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
        rows = tables[table].select(F.lit(table).alias("table"), F.explode(F.array_compact(broken)).alias("constraint"), "request_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def trace_tables(turns: DataFrame) -> dict[str, DataFrame]:
    """The trace tables of turns (request_id, profile, query, overall_result, answer, confidence, gateway_version, attempts array).

    Ranks are positions as sent, never an order by score.
    """
    a = turns.select("request_id", F.explode("attempts").alias("a"))
    of = lambda field: a.select("request_id", "a.attempt", F.posexplode(f"a.{field}").alias("pos", "x"))
    return {
        "responses": turns.select("request_id", "profile", "query", "answer", "overall_result", "confidence_level", "confidence_reason", F.size("attempts").alias("attempts"), "gateway_version"),
        "traces": a.select("request_id", "a.attempt", *[f"a.{c}" for c in ("rewritten_query", "embedding_model", "dim", "generation_model", "top_k", "embed_ms", "search_ms", "generate_ms", "verify_us")]),
        "candidates": of("candidates").select("request_id", "attempt", (F.col("pos") + 1).alias("rank"), "x.*"),
        "verification_results": of("results").select("request_id", "attempt", "x.*"),
        "answer_failures": of("failures").select("request_id", "attempt", "x.*"),
        "generation_failures": a.filter("a.failure IS NOT NULL").select("request_id", "a.attempt", "a.failure.*"),
    }


def orphans(children: dict[str, DataFrame], parents: DataFrame, key: str = "request_id") -> DataFrame:
    """Rows of each child table that no parent has; all are 0 after a cascade."""
    out = None
    for name, child in children.items():
        n = child.join(parents.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def candidate_summary(candidates: DataFrame, key: str = "query_id") -> DataFrame:
    return candidates.groupBy(key).agg(F.count(F.lit(1)).alias("considered"), F.count_if("included").alias("included"))


def outcome_rates(outcomes: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return outcomes.agg(n.alias("turns"), *[F.round(F.count_if(F.col("outcome") == o) / n, 6).alias(o.replace("-", "_")) for o in s.OUTCOMES])


CHECKS = ("locator_resolved", "quote_matched", "tier_permitted", "license_permitted")


def check_rates(results: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return results.agg(n.alias("citations"), *[F.round(F.count_if(~F.col(c)) / n, 6).alias(f"{c}_failed") for c in CHECKS])


def failures_by_code(failures: DataFrame) -> DataFrame:
    return failures.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def retrieval_share(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each corpus's share of included candidates beside its share of the index, and their ratio."""
    total = Window.partitionBy()  # over one row for each corpus
    index = chunks.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("indexed"))
    got = candidates.filter("included").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("retrieved"))
    rows = index.join(got, "corpus_id", "left").na.fill(0, ["retrieved"])
    i, r = F.col("indexed") / F.sum("indexed").over(total), F.col("retrieved") / F.sum("retrieved").over(total)
    return rows.select("corpus_id", F.round(i, 6).alias("index_share"), F.round(r, 6).alias("retrieved_share"), F.round(r / i, 6).alias("ratio"))


def recall_at_k(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Share of each query's relevant chunks among its first ``k`` candidates."""
    found = hits.filter(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")).join(found, "query_id", "left").na.fill(0, ["hits"])
    return rows.select("query_id", "relevant", "hits", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"))


def recall_by_label(hits: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``recall_at_k`` where a query (query_id, label) is relevant to all other chunks (chunk_id, label) of its label: counted by label, pairs are never made."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    own = queries.join(labels.select(F.col("chunk_id").alias("query_id"), "label"), ["query_id", "label"], "left_semi").select("query_id", F.lit(1).alias("own"))
    met = hits.filter((F.col("rank") <= k) & (F.col("chunk_id") != F.col("query_id"))).select("query_id", "chunk_id").join(labels, "chunk_id").join(queries, ["query_id", "label"], "left_semi")
    rows = queries.join(n, "label").join(own, "query_id", "left").join(met.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits")), "query_id", "left").na.fill(0, ["own", "hits"])
    rows = rows.withColumn("relevant", F.col("of_label") - F.col("own")).filter("relevant > 0")
    return rows.select("query_id", "relevant", "hits", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"))


def nearest_rank(samples: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Percentiles without interpolation: the sample at (0-based) n * p // 100 in order.

    Distinct values with their counts are dealt out by ranges; a range's values follow on the counts of those before it,
    so neither a group nor a value that many samples share is gathered, however values are spread.
    """
    rows = samples.filter(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    dealt = written(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranks")
    of = Window.partitionBy("g")  # a row for each part
    parts = dealt.groupBy("g", "part").agg(F.sum("n").alias("held"))
    parts = parts.select(F.col("g").alias("of"), F.col("part").alias("in_part"), (F.sum("held").over(of.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(of).alias("all"))
    placed = dealt.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "part").orderBy("v"))).join(parts, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    placed = placed.withColumn("upto", F.col("upto") + F.col("before")).withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("rank", F.floor(F.col("all") * F.col("p") / 100))
    found = placed.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    return found.groupBy(F.col("g").alias(by)).agg(F.max("all").alias("samples"), *[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def render_candidates(candidates: DataFrame, tiers: DataFrame) -> DataFrame:
    """A line for each candidate: rank, score, state, tier, names, and why it was dropped."""
    state = F.when(F.col("included"), "included").otherwise("dropped")
    reason = F.when(F.trim("exclusion_reason") == "", "").otherwise(F.concat(F.lit("  ("), F.trim("exclusion_reason"), F.lit(")")))
    line = F.format_string("    %3d  %.4f  %-8s [%s] %s %s", "rank", F.coalesce("score", F.lit(0.0)), state, F.coalesce("tier", F.lit("unspecified")), "corpus_id", "locator")
    return candidates.join(tiers.select("corpus_id", "tier"), "corpus_id", "left").select("query_id", "rank", F.concat(line, reason).alias("line"))


def profile_violations(profile: dict, ingested: set[str]) -> list[tuple[str, str]]:
    """(rule, subject) of everything that keeps a profile from loading; a profile is a small file and is read on the driver."""
    found = []
    scripture = profile.get("scripture") or {}
    if not profile.get("profile"):
        found.append(("name-required", ""))
    if not scripture.get("corpus_id"):
        found.append(("scripture-required", ""))
    if scripture.get("stance", "binding") not in s.TIERS[:3]:
        found.append(("scripture-stance", scripture.get("stance", "")))
    scope = [scripture.get("corpus_id", "")]
    for c in profile.get("corpora") or []:
        name, stance = c.get("id", ""), c.get("stance", "")
        if not name:
            found.append(("corpus-id-required", ""))
            continue
        if name in scope:
            found.append(("corpus-twice", name))
        if stance not in s.TIERS:
            found.append(("unknown-stance", name))
        if stance in s.TIERS[3:] and not c.get("label"):
            found.append(("label-required", name))
        scope.append(name)
    held: set[str] = set()
    for c in profile.get("contested") or []:
        locus, ruling = c.get("locus", ""), c.get("ruling_source") or {}
        if not locus:
            found.append(("locus-required", ruling.get("locator", "")))
        if not ruling.get("locator"):
            found.append(("locator-required", locus))
        if locus in held:
            found.append(("locus-twice", locus))
        held.add(locus)
        if ruling.get("corpus_id") not in scope:
            found.append(("ruling-out-of-scope", locus))
    return found + [("not-ingested", c) for c in dict.fromkeys(scope) if c and c not in ingested]


def resolve_profile(profile: dict) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Filter spec (scripture first, then corpora in order) and contested loci of a valid profile."""
    scripture = profile["scripture"]
    spec = [(scripture["corpus_id"], scripture.get("stance", "binding"))] + [(c["id"], c["stance"]) for c in profile.get("corpora") or []]
    loci = [(c["locus"], c["ruling_source"]["corpus_id"], c["ruling_source"]["locator"]) for c in profile.get("contested") or []]
    return spec, loci
