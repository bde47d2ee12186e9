import random

import pytest

from foliospark.functions.vectors import knn
from foliospark.operators import ingest, retrieve, segment, trace
from foliospark.operators import pages, refusals
from foliospark.operators.quotes import quote_contains
from foliospark.operators.verify import turn_outcomes


def basis(i, n=8):
    return [float(i == j) for j in range(n)]


def test_neighbours_of_basis_vectors(spark):
    rows = [(i, basis(i % 4)) for i in range(12)] + [(50, None), (51, [0.0] * 8), (52, [1.0])]
    frame = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    got = knn(frame, [(1, basis(0)), (2, [1.0, 1.0, *[0.0] * 6])], 4).collect()
    assert [r["id"] for r in sorted((r for r in got if r["query_id"] == 1), key=lambda r: r["rank"])] == [0, 4, 8, 1]
    assert [r["id"] for r in sorted((r for r in got if r["query_id"] == 2), key=lambda r: r["rank"])] == [0, 1, 4, 5]
    assert knn(frame, [(1, basis(0))], 0).count() == 0 and knn(frame, [], 3).count() == 0


def budget(spark, sizes, pinned, limit, corpora=("a-b",)):
    chunks = spark.createDataFrame([(i, "a-b" if i < 90 else "x-y", f"L {i}", "w" * n) for i, n in sizes.items()], "id long, corpus_id string, locator string, text string")
    hits = spark.createDataFrame([(1, i, "a-b" if i < 90 else "x-y", f"L {i}", 1.0 - i / 100, r) for r, i in enumerate(sizes, 1)], "query_id long, chunk_id long, corpus_id string, locator string, score double, rank int")
    pins = spark.createDataFrame([("locus", i, "a-b", f"L {i}") for i in pinned], "locus string, chunk_id long, corpus_id string, locator string")
    spec = spark.createDataFrame([(c, "binding", i) for i, c in enumerate(corpora)], "corpus_id string, tier string, position int")
    return [(r["chunk_id"], r["included"], r["exclusion_reason"]) for r in retrieve.context_budget(hits, pins, spec, chunks, limit).orderBy("rank").collect()]


def test_budget_skips_what_does_not_fit(spark):
    assert [x[1] for x in budget(spark, {1: 5, 2: 4, 3: 3, 4: 1}, [], 8)] == [True, False, True, False]
    assert budget(spark, {1: 5, 2: 4}, [2], 4) == [(2, True, ""), (1, False, "context budget")]
    assert budget(spark, {1: 1, 95: 1}, [], 10) == [(1, True, ""), (95, False, "corpus not in the filter spec")]
    assert retrieve.passage_budget() == 18816 and retrieve.passage_budget(1000) == 0


def test_batches_against_the_plain_fold(spark):
    r = random.Random(1)
    rows = [(i, f"c{i % 2}", " ".join(["w"] * r.choice([0, 1, 2, 3, 3, 3, 7, 20, 40]))) for i in range(400)]
    got = {x["id"]: x["batch"] for x in ingest.batch_pack(spark.createDataFrame(rows, "id long, corpus_id string, text string"), 30).collect()}
    for c in ("c0", "c1"):
        batch, fill = 0, 0
        for n, i in sorted((len(t.split()), i) for i, k, t in rows if k == c):
            if fill and (fill + 1) * n > 30:
                batch, fill = batch + 1, 0
            fill += 1
            assert got[i] == batch, (c, n, i)


CHUNKS = "id long, corpus_id string, locator string, text string, content_hash string, normalisation_version int"


def test_ingestion_converges(spark):
    old = spark.createDataFrame([(1, "a-b", "L 1", "x", "h1", 1), (2, "a-b", "L 2", "y", "h2", 1), (3, "a-b", "L 3", "z", "h3", 1)], CHUNKS)
    staged = spark.createDataFrame([("a-b", "L 1", "x", "h1"), ("a-b", "L 2", "new", "h9"), ("a-b", "L 10", "n", "h4")], "corpus_id string, locator string, text string, content_hash string")
    vectors = spark.createDataFrame([(1, "m"), (2, "m"), (3, "m")], "chunk_id long, embedding_model string")
    after = ingest.apply_text(old, staged)
    assert sorted((r["id"], r["locator"], r["text"]) for r in after.collect()) == [(1, "L 1", "x"), (2, "L 2", "new"), (4, "L 10", "n")]
    assert sorted(r[0] for r in ingest.stale_vectors(vectors, old, after).collect()) == [2, 3]
    existing = after.selectExpr("*", "true AS has_embedding")
    assert {r["action"] for r in ingest.ingest_plan(staged, existing).collect()} == {"unchanged"}
    assert ingest.plan_tally(ingest.ingest_plan(staged, existing)).first()["converged"]
    assert ingest.apply_text(after, staged).exceptAll(after).count() == 0


def test_quotes(spark):
    frame = spark.createDataFrame([(1, "abc abc"), (2, "ab"), (3, None)], "id long, text string")
    assert sorted(map(tuple, quote_contains(frame, [(7, "abc"), (8, "b"), (9, ""), (10, "b")]).collect())) == [(7, 1), (8, 1), (8, 2), (9, 1), (9, 2), (10, 1), (10, 2)]


def test_turns(spark):
    rows = [(1, 1, "passed"), (2, 1, "failed"), (2, 2, "passed"), (3, 1, "failed"), (3, 2, "failed"), (4, 1, "failed"), (4, 2, "generation-failed"), (5, 1, "generation-failed"), (5, 2, "passed"), (6, 1, "failed")]
    got = {r["request_id"]: (r["outcome"], r["attempts"], r["first_generation_failed"]) for r in turn_outcomes(spark.createDataFrame(rows, "request_id long, attempt int, status string")).collect()}
    assert got == {1: ("verified", 1, False), 2: ("regenerated", 2, False), 3: ("degraded", 2, False), 4: ("generation-failed", 2, False), 5: ("regenerated", 2, True)}


BASE = {
    "responses": dict(request_id=1, profile="p", query="q", answer="{}", overall_result="verified", confidence_level="high", confidence_reason="a, b", attempts=1, gateway_version="v"),
    "traces": dict(request_id=1, attempt=1, rewritten_query="q", embedding_model="m", dim=4, generation_model="g", top_k=2, embed_ms=0, search_ms=0, generate_ms=0, verify_us=0),
    "candidates": dict(request_id=1, rank=1, corpus_id="a-b", locator="L", included=True, exclusion_reason=""),
    "verification_results": dict(request_id=1, locator_resolved=True, quote_matched=True, tier_permitted=True, license_permitted=True, failure_detail=""),
    "answer_failures": dict(request_id=1, slot="s", corpus_id="", locator="", detail="d"),
    "generation_failures": dict(request_id=1, detail="d", completion_tokens=0),
}
BREAKS = [
    ("responses", dict(answer=None), {"responses_answer_absent_iff_generation_failed"}), ("responses", dict(attempts=3), {"responses_attempts_check", "responses_verified_is_first_attempt"}),
    ("responses", dict(confidence_level=None), {"responses_confidence_absent_iff_generation_failed"}), ("responses", dict(confidence_reason=" "), {"responses_confidence_reason_not_blank"}),
    ("responses", dict(overall_result="degraded"), {"responses_degraded_is_second_attempt"}), ("responses", dict(gateway_version=""), {"responses_gateway_version_present"}),
    ("responses", dict(overall_result="generation-failed", answer=None, confidence_level=None), {"responses_generation_failed_is_second_attempt"}), ("responses", dict(profile="  "), {"responses_profile_check"}),
    ("responses", dict(query="  "), {"responses_query_check"}), ("responses", dict(overall_result="regenerated"), {"responses_regenerated_is_second_attempt"}), ("responses", dict(attempts=2), {"responses_verified_is_first_attempt"}),
    ("responses", dict(overall_result="generation-failed", attempts=2), {"responses_answer_absent_iff_generation_failed", "responses_confidence_absent_iff_generation_failed"}),
    ("traces", dict(attempt=3), {"traces_attempt_check"}), ("traces", dict(dim=0), {"traces_dim_check"}), ("traces", dict(embed_ms=-1), {"traces_embed_ms_check"}), ("traces", dict(embedding_model=" "), {"traces_embedding_model_check"}),
    ("traces", dict(generate_ms=-1), {"traces_generate_ms_check"}), ("traces", dict(generation_model=" "), {"traces_generation_model_check"}), ("traces", dict(rewritten_query=" "), {"traces_rewritten_query_check"}),
    ("traces", dict(search_ms=-1), {"traces_search_ms_check"}), ("traces", dict(top_k=0), {"traces_top_k_check"}), ("traces", dict(verify_us=-1), {"traces_verify_us_non_negative"}),
    ("candidates", dict(corpus_id=" "), {"candidates_corpus_id_check"}), ("candidates", dict(locator=" "), {"candidates_locator_check"}), ("candidates", dict(rank=0), {"candidates_rank_check"}),
    ("candidates", dict(included=False), {"candidates_reason_iff_excluded"}), ("candidates", dict(exclusion_reason="context budget"), {"candidates_reason_iff_excluded"}),
    ("verification_results", dict(quote_matched=False), {"verification_results_detail_iff_failure"}), ("verification_results", dict(failure_detail="x"), {"verification_results_detail_iff_failure"}),
    ("answer_failures", dict(detail=" "), {"answer_failures_detail_check"}), ("answer_failures", dict(corpus_id="a-b"), {"answer_failures_ref_is_whole_or_absent"}), ("answer_failures", dict(locator="L"), {"answer_failures_ref_is_whole_or_absent"}),
    ("answer_failures", dict(slot=""), {"answer_failures_slot_check"}), ("generation_failures", dict(completion_tokens=-1), {"generation_failures_completion_tokens_check"}), ("generation_failures", dict(detail=" "), {"generation_failures_detail_check"}),
]
TYPES = {int: "long", str: "string", bool: "boolean"}


def tables(spark, changed=None, values=None):
    out = {}
    for name, row in BASE.items():
        row = row | (values or {} if name == changed else {})
        out[name] = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {TYPES[type(BASE[name][k])]}" for k in row))
    return out


def test_a_valid_turn_breaks_nothing(spark):
    assert trace.violations(tables(spark)).count() == 0
    assert sum(map(len, trace.constraints().values())) == 31


@pytest.mark.parametrize("table,values,broken", BREAKS, ids=[f"{b[0]}-{'-'.join(b[1])}-{i}" for i, b in enumerate(BREAKS)])
def test_one_break_at_a_time(spark, table, values, broken):
    assert {r["constraint"] for r in trace.violations({table: tables(spark, table, values)[table]}).collect()} == broken


def test_every_constraint_is_broken_once():
    assert set().union(*(b[2] for b in BREAKS)) == {n for rules in trace.constraints().values() for n in rules}


def test_nearest_rank(spark):
    frame = spark.createDataFrame([("a", float(i % 7)) for i in range(40)] + [("b", 3.0), ("b", None)], "k string, v double")
    values = sorted(float(i % 7) for i in range(40))
    got = {r["k"]: (r["samples"], r["p50"], r["p95"]) for r in trace.nearest_rank(frame, "k", "v").collect()}
    assert got == {"a": (40, values[20], values[38]), "b": (1, 3.0, 3.0)}


def test_nearest_rank_in_bins(spark):
    r = random.Random(2)
    values = {k: [r.gauss(0, 1) ** 5 for _ in range(n)] for k, n in (("a", 3000), ("b", 1), ("c", 7))}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {x["k"]: (x["p1"], x["p50"], x["p99"]) for x in trace.nearest_rank(frame, "k", "v", (1, 50, 99)).collect()}
    assert got == {k: tuple(sorted(vs)[len(vs) * p // 100] for p in (1, 50, 99)) for k, vs in values.items()}


def test_quotes_and_queries_in_blocks(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "abcd"), (2, "bcx")], "id long, text string")
    quotes = spark.createDataFrame([(i, "b" if i % 2 else "cd") for i in range(7)] + [(9, None)], "q long, text string")
    assert {tuple(r) for r in quote_contains(frame, quotes).collect()} == {(i, c) for i in range(7) for c in ((1, 2) if i % 2 else (1,))}
    monkeypatch.setattr("foliospark.functions.vectors.QUERY_BLOCK", 2)
    rows = spark.createDataFrame([(i, basis(i % 8)) for i in range(16)], "chunk_id long, embedding array<float>")
    got = knn(rows, rows.filter("chunk_id < 5"), 2).collect()
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == [(i, i + 8 * k, k + 1) for i in range(5) for k in (0, 1)]


def test_vectors_are_written_whole_or_not(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "chunk_id long, embedding array<double>")
    ingest.write_embeddings(rows, "m", 2, f"{tmp_path}/v")
    ingest.write_embeddings(rows.withColumn("chunk_id", rows["chunk_id"] + 2), "m", 2, f"{tmp_path}/v")
    with pytest.raises(ValueError, match="chunk"):
        ingest.write_embeddings(rows, "m", 3, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 4


def test_profiles():
    good = {"profile": "p", "scripture": {"corpus_id": "s-t"}, "corpora": [{"id": "a-b", "stance": "contrary", "label": "l"}], "contested": [{"locus": "x", "ruling_source": {"corpus_id": "s-t", "locator": "L"}}]}
    assert trace.profile_violations(good, {"a-b", "s-t"}) == []
    assert trace.profile_violations(good, {"a-b"}) == [("not-ingested", "s-t")]
    assert trace.resolve_profile(good) == ([("s-t", "binding"), ("a-b", "contrary")], [("x", "s-t", "L")])


def docs(spark, text):
    return spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")


def segments(frame):
    return {r["locator"]: r["text"] for r in frame.collect()}


def test_segments(spark):
    assert segments(segment.segment_sections(docs(spark, "CHAPTER 1\n1. One\nmore\n\n2. Two\nCHAPTER 2\n1. Three"))) == {"WCF 1.1": "One\nmore", "WCF 1.2": "Two", "WCF 2.1": "Three"}
    assert segments(segment.segment_questions(docs(spark, "TITLE\nQ. 1. What?\nA. That.\nAnd so.\nDIVISION II\nQ. 2. Who?\nA. They."))) == {"WSC Q&A 1": "What?\nThat.\nAnd so.", "WSC Q&A 2": "Who?\nThey."}
    assert segments(segment.segment_paragraphs(docs(spark, "CHAPTER 1\nA title\n1-1. One\nmore\n1-2. Two\nCHAPTER 2\n(Vacated)"))) == {"BCO 1-1": "One more", "BCO 1-2": "Two"}
    assert segments(segment.segment_verses(docs(spark, "GEN 1:1 In it\nGEN 1:2\nbad"))) == {"GEN 1:1": "In it"}
    assert segments(segment.segment_paragraphs(docs(spark, "CHAPTER 36\n36-7. One\n36\n-8. Two\nmore"))) == {"BCO 36-7": "One", "BCO 36-8": "Two more"}
    assert [r["text"] for r in segment.text_region(docs(spark, "a\nSTART\nb[12]\n-----\nc\nEND\nd"), "START", "END").collect()] == ["b\n\nc"]
    bad = segment.checked(spark.createDataFrame([(1, "L 1", ""), (1, "L  2", "x"), (1, "L 3", "x"), (1, "L 3", "y")], "doc_id long, locator string, text string"))
    assert {k: v.count() for k, v in bad.items()} == {"empty": 1, "bad_locator": 1, "duplicate": 1}


def test_books(spark):
    text = "   1. Dedication\n\nof it\nINSTITUTES\nBOOK FIRST.\n CHAPTER 1\n   1. First title\n   2. Second title\n\n   1. Body one\ngoes on.\nARGUMENT.\nstill\n\nNext paragraph.\n   7. a list\n   2. Body two\nCHAPTER [x]\n   1. Alone\nBOOK SECOND\nCHAPTER 1\n   1. New"
    assert segments(segment.segment_books(docs(spark, text))) == {
        "Inst. Pref.1.p1": "Dedication", "Inst. Pref.1.p2": "of it", "Inst. 1.1.1.p1": "Body one goes on. still", "Inst. 1.1.1.p2": "Next paragraph. 7. a list", "Inst. 1.1.2.p1": "Body two", "Inst. 1.2.1.p1": "Alone", "Inst. 2.1.1.p1": "New",
    }


def test_roman_sections(spark):
    text = "Chapter I\nI. One\nmore\nPrevious | Next | Contents\nII. Two\nCHAPTER II. Of it\nUnnumbered text.\ngoes on"
    assert segments(segment.segment_roman_sections(docs(spark, text))) == {"WCF 1.1": "One\nmore", "WCF 1.2": "Two", "WCF 2.1": "Unnumbered text.\ngoes on"}


def test_headings(spark):
    long = "# " + "b" * 121
    text = f"front\n# I. Part\nP one.\n\nP two.\n# A. Sub\nP three.\n# 1. Third\nP four.\n# Conclusion\nP five.\n{long}\n# B. Next\nP six.\n# II. Other\nP seven.\n# Recommendations\nWe recommend:\n1. First.\n2. Second."
    assert segments(segment.segment_headed(docs(spark, text))) == {
        "GA28 I.1": "P one.", "GA28 I.2": "P two.", "GA28 I.A.1": "P three.", "GA28 I.A.1.1": "P four.", "GA28 I.A.1.2": "P five.", "GA28 I.A.1.3": "b" * 121, "GA28 I.B.1": "P six.", "GA28 II.1": "P seven.",
        "GA28 Rec.1": "First.", "GA28 Rec.2": "Second.",
    }


def test_canonical_order(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(("GEN", "GEN", "EXO"))] + [(2, i, c) for i, c in enumerate(("EXO", "GEN"))] + [(3, 0, "GEN")], "doc_id long, n int, code string")
    got = segment.out_of_order(rows, "doc_id", "n", "code", ["GEN", "EXO"]).collect()
    assert sorted(map(tuple, got)) == [(2, "EXO", 0, "GEN"), (3, None, 1, "EXO")]


def test_contiguity_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(segment, "STRETCH", 4)
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 3, 4, 5, 9, 10, 30)] + [("b", 2), ("b", 3)], "g string, n long")
    assert sorted(map(tuple, segment.contiguity(rows, "g", "n").collect())) == [("a", 9, 6), ("a", 30, 11), ("b", 2, 1)]


def test_rendered_answers(spark):
    from foliospark import schema as s
    from foliospark.operators.render import top_k, render_answers

    c = ("a-b", "L 1", "binding", " a quote ")
    full = ("It is so.", [("Claim", " why ", [c])], [], [("Else", ["these", "those"], [])], (False, "", [], ""), "", ("high", "two"))
    rows = [(1, "verified", full), (2, "degraded", (None, None, None, None, None, None, ("low", "none"))), (3, "generation-failed", None), (4, "verified", ("", [], [], [], None, "nothing", ("low", "silent")))]
    frame = spark.createDataFrame(rows, "request_id int, outcome string, answer " + s.ANSWER.simpleString())
    out: dict = {}
    for r in render_answers(frame, spark.createDataFrame([("a-b", "binding", "W", "1st", "seen")], "corpus_id string, tier string, work string, edition string, label string")).orderBy("request_id", "line_no").collect():
        out.setdefault(r["request_id"], []).append(r["line"])
    assert out[1] == ["position", "  It is so.", "", "arguments", "  1. Claim", "     why", "     [binding] a-b L 1", "       W (1st)", "       binding: seen", '       "a quote"', "", "contrary positions", "  1. Else", "     held by: these, those", "", "confidence", "  high — two"]
    assert out[2] == ["I can't source this adequately.", "", "confidence", "  low — none"] and out[3] == ["I couldn't produce an answer for this question."]
    assert out[4] == ["The sources in scope are silent on this question.", "  nothing", "", "confidence", "  low — silent"]
    assert top_k(None) == 20 and top_k(" 7 ") == 7
    for bad in ("0", "-1", "x", str(2**31)):
        with pytest.raises(ValueError):
            top_k(bad)


def test_problems_of_sections_and_reports(spark):
    docs = spark.createDataFrame([
        (1, "CHAPTER 1\n1. One.\ngoes on\n2. Two.\nCHAPTER 2\n1. Three."), (2, "loose\nCHAPTER 2\nintro\n1. A\n\n3. B\n4. C\nCHAPTER 3\n2. D"), (3, "1. No chapter."), (4, None), (5, ""), (6, "CHAPTER 99999999999999999999\n1. x"),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.problem for r in refusals.section_problems(docs).collect()}
    assert got == {
        (2, 0): "text before any chapter", (2, 1): "chapter 2 where 1 was expected", (2, 2): "text outside a section", (2, 5): "chapter 2 section 3 where 2 was expected", (2, 8): "chapter 3 section 2 where 1 was expected",
        (3, 0): "a section before any chapter", (6, 0): "text before any chapter", (6, 1): "a section before any chapter",
    }
    docs = spark.createDataFrame([
        (1, "# I. One\ntext\n# RECOMMENDATIONS\nWe:\n1. A\n2. B"), (2, "before\n# Title\nstill before\n# II. Two\n# RECOMMENDATIONS\n2. A\n3. B"), (3, None), (4, "# I. " + "long " * 40),
    ], "doc_id long, text string")
    rows = refusals.report_problems(docs, 2).collect()
    assert {(r.doc_id, r.line_no, r.problem) for r in rows} == {
        (2, 0, "text before any section heading"), (2, 2, "text before any section heading"), (2, 5, "recommendation 2 where 1 was expected"),
        (3, None, "0 recommendations, 2 were expected"), (4, None, "0 recommendations, 2 were expected"), (4, 0, "text before any section heading"),
    }
    assert [tuple(r) for r in refusals.too_long(spark.createDataFrame([(1, "A 1", "abc"), (1, "A 2", "abcd")], "doc_id long, locator string, text string"), 3).collect()] == [(1, "A 2", 4)]


def test_pages_read_the_parts_that_hold_them(spark, tmp_path):
    n = 1000
    frame = spark.createDataFrame([(f"c{i % 3}", i * 37 % n) for i in range(n)], "corpus_id string, k long")
    want = sorted(map(tuple, frame.collect()))
    path = f"file://{tmp_path}/pages"
    pages.write_pages(frame, ["corpus_id", "k"], path, part=100)
    index = spark.read.parquet(f"{path}/index").orderBy("part").collect()
    assert len(index) > 5 and index[-1].before + index[-1].n == n
    for page, size in ((0, 7), (9, 50), (19, 50), (3, 300), (50, 50)):
        got = pages.read_page(spark, path, ["corpus_id", "k"], page, size)
        assert sorted(map(tuple, got.collect())) == want[page * size:(page + 1) * size]
    last = index[-1]
    spark.createDataFrame([("zz", 1)], "corpus_id string, k long").write.mode("overwrite").parquet(f"{path}/rows/part={last.part}")
    assert sorted(map(tuple, pages.read_page(spark, path, ["corpus_id", "k"], 5, 50).collect())) == want[250:300]  # what comes after isn't read
    assert pages.page_slice(frame.filter("k < 0"), ["k"], 0, 5).collect() == []


def test_places_in_groups(spark):
    frame = spark.createDataFrame([("a", f"{i:04d}") for i in range(500)] + [("b", "x"), ("b", "y"), ("c", "z")], "g string, k string").repartition(5)
    got = {(r.g, r.k): (r.place, r.of) for r in pages.numbered(frame, "g", ["k"]).collect()}
    assert got == {("a", f"{i:04d}"): (i, 500) for i in range(500)} | {("b", "x"): (0, 2), ("b", "y"): (1, 2), ("c", "z"): (0, 1)}


def test_browse_withholds_and_flags(spark):
    chunks = spark.createDataFrame([("a", f"L {i}", f"t{i}", f"h{i}") for i in range(5)] + [("b", "L 1", "secret", "h"), ("c", "L 1", "odd", "h")], "corpus_id string, locator string, text string, content_hash string")
    works = spark.createDataFrame([("a", "cc-by"), ("b", "local-only"), ("c", None)], "corpus_id string, license string")
    prints = spark.createDataFrame([("a", "L 2", "h2"), ("a", "L 3", "other")], "corpus_id string, locator string, sha256 string")
    got = {(r.corpus_id, r.locator): r for r in pages.browse(chunks, works, prints, 1, 2).collect()}
    assert set(got) == {("a", "L 2"), ("a", "L 3"), ("b", "L 1"), ("c", "L 1")}
    assert got["a", "L 2"].blessed is True and got["a", "L 3"].blessed is False and got["b", "L 1"].blessed is None and got["a", "L 2"].text == "t2"
    assert got["b", "L 1"].text is None and got["b", "L 1"].withheld and got["c", "L 1"].text is None and (got["a", "L 2"].page, got["a", "L 2"].pages, got["b", "L 1"].page) == (1, 3, 0)
    assert {r.text for r in pages.browse(chunks, works, prints, 0, 2, opt_in=True).collect() if r.corpus_id == "b"} == {"secret"}


def test_nearest_rank_of_skewed_values(spark):
    values = {"a": [0.0] * 5000 + [1e300, -1e300] + [float(i) for i in range(50)], None: [3.0, 1.0, 2.0], "b": [5.0]}
    frame = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("b", None)], "k string, v double").repartition(6)
    got = {x["k"]: (x["samples"], x["p50"], x["p99"], x["p100"]) for x in trace.nearest_rank(frame, "k", "v", (50, 99, 100)).collect()}
    at = lambda vs, p: (sorted(vs)[len(vs) * p // 100] if p < 100 else None)
    assert got == {k: (len(vs), *(at(vs, p) for p in (50, 99, 100))) for k, vs in values.items()}


def test_books_are_dealt_out_once(spark):
    """Lines are made and dealt out once, by document, and no filter counts sections anew for every number."""
    docs = spark.createDataFrame([(1, "INSTITUTES\nBOOK FIRST\nCHAPTER 1\n   1. one\n   2. two\n\nmore\n")], "doc_id long, text string")
    got = segment.segment_books(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate posexplode") == 1 and "Join" not in plan
    assert not [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in x and "array_append" in x]
    assert {tuple(r) for r in got.collect()} == {(1, "Inst. 1.1.1.p1", "one"), (1, "Inst. 1.1.2.p1", "two"), (1, "Inst. 1.1.2.p2", "more")}
