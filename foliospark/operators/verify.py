"""Verification of structured answers: checks of each citation, rules of each answer, confidence and turn outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import schema as s
from foliospark.functions import text as t

# Least length of a quote, longest reason for no answer, and the tiers that may argue and that establish.
QUOTE_FLOOR, REASON_CAP = 40, 200
ARGUING, AUTHORITY = ("binding", "governing", "advisory"), ("binding", "governing")

# Slots in the order in which citations are read.
SLOTS = ("arguments", "descriptions", "contrary_positions", "contested")

# Details of failing checks.
DETAIL = {
    "unresolved": "no chunk carries %s at %s",
    "no quote": "the quote could not be checked: the locator resolved to no chunk",
    "short": "the quote is %d characters after normalisation and the floor is %d",
    "miss": "the quote does not appear verbatim in that chunk after normalisation",
    "skew": "; the chunk was ingested under normalisation contract version %d and this build normalises at version %d, which is the likelier cause than the quote",
    "out of scope": "%s was not in the filter spec sent for this turn",
    "tier": "%s sits at %s under the resolved profile, and an affirmative claim never rests on it",
    "no licence": "the licence could not be checked: the locator resolved to no chunk",
    "unknown licence": 'licence "%s" is not one this build knows, and an unknown licence cannot be read as permitting anything',
    "refused": "the licence is `refused`, which permits serving under no configuration",
    "local-only": "the licence is `local-only` and the deployer opt-in is unset, so the default deny applies",
}


def licence_refusal(licence: Column, opt_in: bool = False) -> Column:
    """Why a licence may not be served; null if it may. Unknown ones may not."""
    known = F.coalesce(licence.isin(*s.LICENSES), F.lit(False))
    local = F.lit(None) if opt_in else F.when(licence == "local-only", DETAIL["local-only"])
    return F.when(~known, F.format_string(DETAIL["unknown licence"], F.coalesce(licence, F.lit("")))).when(licence == "refused", DETAIL["refused"]).otherwise(local)


def exploded(answers: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each citation of ``answers`` (keys, answer), with slot_order, slot, i, j: one generator over all slots in order."""
    citation = lambda n, i, j, c: F.struct(F.lit(n).alias("slot_order"), F.lit(SLOTS[n]).alias("slot"), i.alias("i"), j.alias("j"), *[c[k].alias(k) for k in ("corpus_id", "locator", "quote")])
    none = F.array().cast(f"array<struct<slot_order:int,slot:string,i:int,j:int,corpus_id:string,locator:string,quote:string>>")
    several = lambda n: F.flatten(F.transform(F.col(f"answer.{SLOTS[n]}"), lambda a, i: F.transform(F.coalesce(a["citations"], F.array().cast(f"array<{s.CITATION.simpleString()}>")), lambda c, j: citation(n, i, j, c))))
    contested = F.transform(F.col("answer.contested.citations"), lambda c, j: citation(3, F.lit(0), j, c))
    lists = [F.coalesce(x, none) for x in (several(0), several(1), several(2), contested)]
    out = answers.select(*keys, F.explode(F.concat(*lists)).alias("c")).select(*keys, "c.*")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("corpus_id", "locator", "quote")})


def verify_citations(citations: DataFrame, chunks: DataFrame, works: DataFrame, spec: DataFrame, opt_in: bool = False) -> DataFrame:
    """The four checks of each citation (corpus_id, locator, quote, slot), each on its own terms, and the joined details.

    The chunk is looked up by corpus and locator, with or without a vector; tiers are those of the spec that was
    sent, the last entry of a corpus. All citations are resolved by one join.
    """
    tiers = spec.groupBy("corpus_id").agg(F.max_by("tier", "position").alias("spec_tier"))
    have = chunks.select("corpus_id", "locator", F.col("text").alias("chunk_text"), "normalisation_version").join(works.select("corpus_id", "license"), "corpus_id")
    rows = citations.join(have, ["corpus_id", "locator"], "left").join(tiers, "corpus_id", "left")
    quote = t.normalise(F.col("quote"))
    rows = rows.withColumn("norm_quote", quote).withColumn("norm_chunk", t.normalise(F.col("chunk_text")))
    resolved = F.col("chunk_text").isNotNull()
    long_enough = F.length("norm_quote") >= QUOTE_FLOOR
    matched = resolved & long_enough & F.coalesce(F.contains("norm_chunk", "norm_quote"), F.lit(False))
    scoped = F.col("spec_tier").isNotNull()
    permitted = scoped & ((F.col("slot") != "arguments") | F.col("spec_tier").isin(*ARGUING))
    refusal = licence_refusal(F.col("license"), opt_in)
    licensed = resolved & refusal.isNull()
    name = t.quoted(F.col("corpus_id"))
    version = F.col("normalisation_version")
    miss = F.concat(F.lit(DETAIL["miss"]), F.when(version != t.NORMALISATION_VERSION, F.format_string(DETAIL["skew"], version, F.lit(t.NORMALISATION_VERSION))).otherwise(""))
    details = F.concat_ws(
        "; ",
        F.when(~resolved, F.format_string(DETAIL["unresolved"], name, t.quoted(F.col("locator")))),
        F.when(~resolved, DETAIL["no quote"]).when(~long_enough, F.format_string(DETAIL["short"], F.length("norm_quote"), F.lit(QUOTE_FLOOR))).when(~matched, miss),
        F.when(~scoped, F.format_string(DETAIL["out of scope"], name)).when(~permitted, F.format_string(DETAIL["tier"], name, F.col("spec_tier"))),
        F.when(~resolved, DETAIL["no licence"]).otherwise(refusal),
    )
    checks = {"locator_resolved": resolved, "quote_matched": matched, "tier_permitted": F.coalesce(permitted, F.lit(False)), "license_permitted": licensed, "failure_detail": details}
    return rows.select(*[F.col(c) for c in citations.columns], *[c.alias(k) for k, c in checks.items()])


def looked_up(answers: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """``answers`` with ``name``: a map from the corpora that an answer cites to their rows in ``table`` (corpus_id, others). A table of any size is joined, never a literal."""
    a = F.col("answer")
    none = F.array().cast("array<string>")
    of = lambda slot: F.coalesce(F.flatten(F.transform(a[slot], lambda x: F.coalesce(F.transform(x["citations"], lambda c: c["corpus_id"]), none))), none)
    cited = F.array_distinct(F.concat(*map(of, SLOTS[:3]), F.coalesce(F.transform(a["contested"]["citations"], lambda c: c["corpus_id"]), none)))
    row = F.struct(*[c for c in table.columns if c != "corpus_id"])
    named = answers.select(key, F.explode(cited).alias("corpus_id")).join(table, "corpus_id").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("corpus_id", row))).alias(name))
    return answers.join(named, key, "left")


def _tiers(spec: DataFrame) -> DataFrame:
    """Tier of each corpus of a filter spec (corpus_id, tier, position); later lines win."""
    return spec.groupBy("corpus_id").agg(F.max_by("tier", "position").alias("tier"))


def _tier(corpus: Column) -> Column:
    return F.element_at(F.col("tiers"), corpus)["tier"]


def answer_failures(answers: DataFrame, results: DataFrame, spec: DataFrame, loci: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, ord, code, slot, corpus_id, locator: the answer-level rules that each answer breaks, in order of emission.

    ``spec`` (corpus_id, tier, position) and ``loci`` (locus, corpus_id, locator) are tables, and both are joined; of
    several rulings of a locus the first by corpus and locator counts. A ruling counts as cited while uncontested
    only where its citation passed all four checks in ``results``.
    """
    tier, answers = _tier, looked_up(answers, _tiers(spec), key, "tiers")
    a = F.col("answer")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rulings = loci.groupBy("locus").agg(F.min(F.struct("corpus_id", "locator")).alias("__ruling"))
    refs = results.filter("failure_detail = ''").join(loci.select("corpus_id", "locator").distinct(), ["corpus_id", "locator"], "left_semi")  # of rulings only
    refs = refs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot_order", "i", "j", "corpus_id", "locator"))).alias("refs"))
    rows = answers.join(refs, key, "left").withColumn("__locus", F.coalesce(a["contested"]["locus"], F.lit("")))
    rows = rows.join(rulings.withColumnRenamed("locus", "__locus"), "__locus", "left")
    fail = lambda code, slot, corpus=None, locator=None: F.struct(F.lit(code).alias("code"), (slot if isinstance(slot, Column) else F.lit(slot)).alias("slot"), (F.lit("") if corpus is None else corpus).alias("corpus_id"), (F.lit("") if locator is None else locator).alias("locator"))
    kind = "array<struct<code:string,slot:string,corpus_id:string,locator:string>>"
    when = lambda cond, f: F.when(cond, F.array(f)).otherwise(F.array().cast(kind))

    def numbered(slot):
        return lambda x, i: F.struct(F.concat(F.lit(f"{slot}["), i.cast("string"), F.lit("]")).alias("slot"), x["citations"].alias("citations"))

    def of_argument(x):
        strong = F.exists(x["citations"], lambda c: F.coalesce(tier(c["corpus_id"]).isin(*AUTHORITY), F.lit(False)))
        return F.when(size(x["citations"]) == 0, F.array(fail("citations-required", x["slot"]))).when(~strong, F.array(fail("argument-lacks-authority", x["slot"]))).otherwise(F.array().cast(kind))

    def uncited(slot):
        rows_of = F.transform(F.coalesce(a[slot], F.array().cast(s.ANSWER[slot].dataType.simpleString())), numbered(slot))
        return F.transform(F.filter(rows_of, lambda x: size(x["citations"]) == 0), lambda x: fail("citations-required", x["slot"]))

    arguments = F.flatten(F.transform(F.transform(F.coalesce(a["arguments"], F.array().cast(s.ANSWER["arguments"].dataType.simpleString())), numbered("arguments")), of_argument))
    contested, n_arguments = F.coalesce(a["contested"]["is_contested"], F.lit(False)), size(a["arguments"])
    ruling = F.col("__ruling")
    cited = F.try_element_at(F.filter(a["contested"]["citations"], lambda c: (c["corpus_id"] == ruling["corpus_id"]) & (c["locator"] == ruling["locator"])), F.lit(1))
    debate = F.coalesce(a["contested"]["state_of_debate"], F.lit(""))
    rows = rows.withColumns({"__debate": t.normalise(debate), "__quote": t.normalise(F.coalesce(cited["quote"], F.lit("")))})
    debated = F.contains("__debate", "__quote")
    held = F.array_distinct(F.transform(F.coalesce("refs", F.array().cast("array<struct<slot_order:int,i:int,j:int,corpus_id:string,locator:string>>")), lambda r: F.struct(r["corpus_id"].alias("corpus_id"), r["locator"].alias("locator"))))
    omitted = F.when(contested, F.array().cast(kind)).otherwise(F.transform(held, lambda r: fail("ruling-cited-while-uncontested", "contested.is_contested", r["corpus_id"], r["locator"])))
    reason = F.coalesce(a["no_answer_reason"], F.lit(""))
    content = (n_arguments > 0) | (size(a["descriptions"]) > 0) | (size(a["contrary_positions"]) > 0)
    silent = ~t.is_blank(reason)
    broken = F.concat(
        arguments, uncited("descriptions"), uncited("contrary_positions"),
        when(~t.is_blank(a["position"]) & (n_arguments == 0), fail("position-without-arguments", "position")),
        when(contested & (n_arguments > 0), fail("contested-with-arguments", "arguments")),
        F.when(~contested, F.array().cast(kind)).when(ruling.isNull(), F.array(fail("contested-locus-unknown", "contested.locus"))).when(cited.isNull(), F.array(fail("contested-ruling-uncited", "contested.citations", ruling["corpus_id"], ruling["locator"])))
        .when(~debated, F.array(fail("contested-ruling-unquoted", "contested.state_of_debate", ruling["corpus_id"], ruling["locator"]))).otherwise(F.array().cast(kind)),
        when(~contested & ~t.is_blank(debate), fail("state-of-debate-without-contest", "contested.state_of_debate")),
        omitted,
        when(silent & (F.length(reason) > REASON_CAP), fail("no-answer-reason-too-long", "no_answer_reason")),
        when(silent & (content | contested), fail("no-answer-reason-not-alone", "no_answer_reason")),
        when(~silent & ~content & ~contested, fail("empty-answer", "no_answer_reason")),
    )
    return rows.select(key, F.posexplode(broken).alias("ord", "f")).select(key, "ord", "f.*")


def confidence(answers: DataFrame, spec: DataFrame, key: str = "answer_id", attempt: str = "attempt") -> DataFrame:
    """Level and reason, from distinct authoritative citations of arguments, the attempt, and what kind of answer it is."""
    tier, answers = _tier, looked_up(answers, _tiers(spec), key, "tiers")
    a = F.col("answer")
    cited = F.flatten(F.transform(F.coalesce(a["arguments"], F.array().cast(s.ANSWER["arguments"].dataType.simpleString())), lambda x: F.coalesce(x["citations"], F.array().cast(f"array<{s.CITATION.simpleString()}>"))))
    strong = F.filter(cited, lambda c: F.coalesce(tier(c["corpus_id"]).isin(*AUTHORITY), F.lit(False)))
    n = F.size(F.array_distinct(F.transform(strong, lambda c: F.struct(c["corpus_id"], c["locator"]))))
    contested, silent = F.coalesce(a["contested"]["is_contested"], F.lit(False)), ~t.is_blank(a["no_answer_reason"])
    locus = F.coalesce(a["contested"]["locus"], F.lit(""))
    level = F.when(contested | silent | (n == 0), "low").when((n >= 2) & (F.col(attempt) == 1), "high").otherwise("medium")
    count = F.when(n == 0, "no binding or governing citations").when(n == 1, "1 binding or governing citation").otherwise(F.concat(n.cast("string"), F.lit(" binding or governing citations")))
    reason = F.concat_ws(
        ", ", count, F.when(F.col(attempt) > 1, "regenerated").otherwise("first attempt"),
        F.when(contested & (locus == ""), "contested").when(contested, F.concat(F.lit("contested locus "), locus)).otherwise("not contested"), F.when(silent, "no_answer_reason set"),
    )
    return answers.select(key, level.alias("level"), reason.alias("reason"), n.alias("authoritative"))


#: Fixed value: confidence of a turn that shipped nothing.
DEGRADED_REASON = "no content was verified on either attempt, so nothing was shown"


def turn_outcomes(attempts: DataFrame, key: str = "request_id") -> DataFrame:
    """Outcome of each turn from its attempts (key, attempt, status of passed, failed or generation-failed).

    The first attempt passes: verified. Else the second decides: regenerated, generation-failed or degraded. A
    turn whose only attempt did not pass is not finished and gives no row. Two attempts are two rows of one
    aggregate, not a loop.
    """
    status = lambda n: F.max(F.when(F.col("attempt") == n, F.col("status")))
    by = attempts.filter("attempt IN (1, 2)").groupBy(key).agg(status(1).alias("one"), status(2).alias("two"))
    outcome = F.when(F.col("one") == "passed", "verified").when(F.col("two") == "passed", "regenerated").when(F.col("two") == "generation-failed", "generation-failed").when(F.col("two") == "failed", "degraded")
    used = F.when(F.col("one") == "passed", 1).otherwise(2)
    return by.select(key, outcome.alias("outcome"), used.alias("attempts"), (F.col("one") == "generation-failed").alias("first_generation_failed")).filter("outcome IS NOT NULL")


def classify_completions(raw: DataFrame) -> DataFrame:
    """Why a completion (request_id, choices, finish_reason, content) is no answer object; null where it is one. Tests run in this order."""
    text = F.coalesce("content", F.lit(""))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    code = F.when(F.coalesce("choices", F.lit(0)) < 1, "empty").when(F.col("finish_reason") == "length", "truncated").when(parsed.isNull(), "not-json").when(~F.startswith(kind, F.lit("OBJECT")), "not-an-object")
    return raw.select("request_id", code.alias("code"))
