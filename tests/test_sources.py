import json
import zipfile

import pytest

from foliospark.operators.trace import trace_tables
from foliospark.sources import files, html


def test_staged_records_round_trip(spark, tmp_path):
    rows = [("a-b", "L 1", "tëxt", "h1"), ("a-b", "L 2", "line\nbreak", "h2")]
    frame = spark.createDataFrame(rows, "corpus_id string, locator string, text string, content_hash string")
    first = files.write_staged(frame, f"file://{tmp_path}/s")
    second = files.write_staged(frame.limit(1), f"file://{tmp_path}/s")
    assert first != second and files.read_current(spark, f"file://{tmp_path}/s").count() == 1
    assert sorted(map(tuple, files.read_staged(spark, f"file://{tmp_path}/s/{first}").collect())) == rows


def test_blank_lines_are_skipped_and_broken_ones_stop(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"corpus_id": "a-b", "locator": "L"}\n\n{"corpus_id": "a-b", "locator": "M", "other": 1}\n')
    assert files.read_staged(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"corpus_id": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        files.read_staged(spark, str(tmp_path / "b.jsonl")).collect()


def test_fingerprint_files(spark):
    h = "a" * 64
    lines = [("a-b", f"WSC Q&A 1  {h}"), ("a-b", f"x  y  {h}"), ("a-b", f"L {h}"), ("a-b", f"D  {h}"), ("a-b", f"D  {h}"), ("a-b", "")]
    got = [(r["locator"], r["problem"]) for r in files.parse_fingerprints(spark.createDataFrame(lines, "corpus_id string, value string")).collect()]
    assert sorted(got) == [("", "malformed"), ("D", "duplicate"), ("D", "duplicate"), ("WSC Q&A 1", ""), ("x  y", "")]
    records = spark.createDataFrame([("a-b", x, h) for x in ("WCF 2.1", "é", "WCF 10.1", "z")], "corpus_id string, locator string, content_hash string")
    assert [r["locator"] for r in files.render_fingerprints(records).collect()] == ["WCF 10.1", "WCF 2.1", "z", "é"]


def test_html():
    page = '<nav>no</nav><div class="x text"><h2>Head</h2><p>One <b>two</b><br>three &amp; <sup>1</sup>four<table><tr><td>a<td>b</tr><tr><td>c<td>d</tr></table><script>x()</script><div>in</div></p></div><p>after</p>'
    assert html.html_lines(page, "div", "text") == ["Head", "One two", "three & four", "a", "c", "b", "d", "in"]
    assert html.html_lines(None) == [] and html.html_lines("<article>open") == ["open"]
    assert html.html_lines("<div class=a>x<nav><div>n</div></nav>y</div><div>after</div>", "div", "a") == ["xy"]


def test_main_block():
    page = lambda body: f'<div class="header"><p>Nav.</p></div><div class="mainBlock"><h1>Title</h1>{body}</div><div class="foot"><p>Foot.</p></div>'
    lines = lambda body: html.main_lines(page(body))
    assert lines("<ol><li>Index.</li></ol><p>Body.<sup>[a]</sup></p>") == ["Body."]
    assert lines("<h3>CHAPTER 1<br /><i>Of it</i></h3><p>First.<br />\nSecond.</p>") == ["CHAPTER 1 Of it", "First.", "Second."]
    assert lines("<p>Closed.</p><p>Never closed.") == ["Closed.", "Never closed."]
    assert lines("<center>Mid</p></center><table><tr><td>1</td><td>4</td></tr><tr><td>2</td></tr><tr><td>3</td><td>5</td></tr></table>tail") == ["Mid", "1", "2", "3", "4", "5", "tail"]
    assert html.main_lines("<p>no container</p>") == []


def test_report_and_built_pages():
    raw = '<p><b>REPORT</b></p><table><tr><td>index</td></tr></table><p>REPORT</p><p><b>I. Part <i>one</i></b></p><p>It\x92s <b>bold</b> here.<a href="#_ftn1" name="_ftnref1">[1]</a></p><div id="ftn1"><p>note</p></div>'.encode("latin-1")
    assert html.report_lines(raw, "REPORT") == ["# I. Part one", "It\u2019s bold here."]
    page = '<h1 class="t big">Chapter I</h1><p>menu</p><div class="body"><p>I. One<a href="x.html#fn3">[3]</a></p><div><p>two</p></div></div><h1 class="t">Chapter II</h1>'
    assert html.built_lines(page, "t", "body") == ["Chapter I", "I. One", "two", "Chapter II"]


def test_archives_and_blobs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.txt", "béta")
        z.writestr("a.txt", "alpha")
        z.writestr("c.bin", "no")
    assert [(r["member"], r["text"]) for r in files.read_zip_members(spark, str(tmp_path / "a.zip")).collect()] == [("a.txt", "alpha"), ("b.txt", "béta")]
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae").write_text("foo")
    (tmp_path / "blobs" / "other").write_text("foo")
    assert sorted(r["intact"] for r in files.read_blobs(spark, str(tmp_path / "blobs")).collect()) == [False, True]


MANIFEST = """
corpus_id: a-b
source_url: http://x
archive_url: http://y
retrieved: 2026-01-02
upstream_sha256: HASH
license: cc-by
license_terms: terms
attribution: someone
normalisation_version: 1
chunk_count: 2
edition_check:
  diagnostic: L 1
  expected_sha256: HASH
  verified_by: a reader
  verified: 2026-01-03
""".replace("HASH", "a" * 64)


def test_manifests_and_profiles(spark, tmp_path):
    pytest.importorskip("yaml")
    good = files.read_manifest(MANIFEST)
    assert files.manifest_problems(good) == [] and good["retrieved"] == "2026-01-02"
    bad = good | {"corpus_id": "bare", "license": "x", "chunk_count": "3", "odd": 1, "attribution": " ", "edition_check": {"diagnostic": "L 1"}}
    assert files.manifest_problems(bad) == [
        "missing edition_check.expected_sha256", "missing edition_check.verified_by", "missing edition_check.verified", "unknown odd", "empty attribution", "malformed chunk_count", "malformed corpus_id", "unknown licence"]
    with pytest.raises(ValueError, match="unknown odd"):
        files.read_manifest(MANIFEST + "odd: 1\n")
    profile = files.read_profile("profile: p\nscripture: {corpus_id: s-x}\ncorpora: [{id: a-b, stance: advisory}]\n")
    assert profile["scripture"] == {"corpus_id": "s-x", "stance": "binding"}
    with pytest.raises(ValueError, match="unknown corpora.stanse"):
        files.read_profile("corpora: [{id: a-b, stanse: x}]")
    records = spark.createDataFrame([("a-b", "L 2", "b" * 64), ("a-b", "L 1", "a" * 64), ("c-d", "L 1", "a" * 64)], "corpus_id string, locator string, content_hash string")
    files.bless(spark, records, good, f"file://{tmp_path}")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/a-b/fingerprints").collect()] == [f"L 1  {'a' * 64}", f"L 2  {'b' * 64}"]
    for wrong in (good | {"chunk_count": 3}, good | {"edition_check": good["edition_check"] | {"diagnostic": "L 2"}}):
        with pytest.raises(ValueError):
            files.bless(spark, records, wrong, f"file://{tmp_path}/no")


def test_staged_ids(spark, tmp_path):
    frame = spark.createDataFrame([("a-b", "L 1")], "corpus_id string, locator string")
    for name in ("z-y", "a-b"):
        files.write_staged(frame, f"file://{tmp_path}/{name}")
    (tmp_path / "unfinished").mkdir()
    assert files.staged_ids(spark, f"file://{tmp_path}") == ["a-b", "z-y"] and files.staged_ids(spark, f"file://{tmp_path}/none") == []


def test_answer_schema():
    schema = json.loads(files.answer_json_schema())
    of = schema["properties"]
    assert "confidence" not in of and schema["additionalProperties"] is False and schema["required"] == []
    assert of["contested"]["properties"]["is_contested"] == {"type": "boolean"} and of["contested"]["required"] == []
    cited = of["arguments"]["items"]["properties"]["citations"]["items"]
    assert cited["required"] == ["corpus_id", "locator", "tier", "quote"] and cited["properties"]["tier"]["enum"][:2] == ["TIER_UNSPECIFIED", "TIER_BINDING"]


TURN = """request_id long, profile string, query string, overall_result string, answer string, confidence_level string, confidence_reason string, gateway_version string, created_at timestamp, attempts array<struct<attempt:int,rewritten_query:string,embedding_model:string,dim:int,
generation_model:string,top_k:int,embed_ms:long,search_ms:long,generate_ms:long,verify_us:long,candidates:array<struct<corpus_id:string,locator:string,score:double,included:boolean,exclusion_reason:string>>,
results:array<struct<corpus_id:string,locator:string,locator_resolved:boolean,quote_matched:boolean,tier_permitted:boolean,license_permitted:boolean,failure_detail:string>>,
failures:array<struct<code:string,slot:string,corpus_id:string,locator:string,detail:string>>,failure:struct<code:string,detail:string,completion_tokens:int>>>"""


def turn(i, query="q"):
    from datetime import datetime

    attempt = (1, "q", "m", 4, "g", 2, 0, 0, 0, 0, [("a-b", "L 1", 0.9, True, ""), ("a-b", "L 2", 0.95, False, "context budget")], [("a-b", "L 1", True, True, True, True, "")], [], None)
    return (i, "p", query, "verified", "{}", "high", "a, b", "v", datetime(2024, 1, 1, 0, i), [attempt])


def test_turns_stream_to_tables(spark, tmp_path):
    from foliospark.streaming.trace_sink import write_turns

    source = f"{tmp_path}/in"
    spark.createDataFrame([turn(1), turn(2), turn(1)], TURN).write.parquet(source)
    write_turns(spark.readStream.schema(TURN).parquet(source), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([turn(3)], TURN).write.mode("append").parquet(source)
    write_turns(spark.readStream.schema(TURN).parquet(source), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["request_id"] for r in spark.read.parquet(f"{tmp_path}/out/responses").collect()) == [1, 2, 3]
    ranks = spark.read.parquet(f"{tmp_path}/out/candidates").filter("request_id = 3").orderBy("rank").collect()
    assert [(r["rank"], r["locator"]) for r in ranks] == [(1, "L 1"), (2, "L 2")]
    assert trace_tables(spark.createDataFrame([turn(1)], TURN))["generation_failures"].count() == 0


def test_a_broken_turn_is_refused(spark, tmp_path):
    from foliospark.streaming.trace_sink import write_turns

    spark.createDataFrame([turn(1, " ")], TURN).write.parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="responses_query_check"):
        write_turns(spark.readStream.schema(TURN).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()


def test_pages_of_many_and_of_deep_tables():
    cell = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert html.html_lines(f"<article>{cell * 5000}</article>") == ["a", "c", "b"] * 5000
    assert html.html_lines("<article>" + "<table>" * 3000 + "x" + "</table>" * 3000 + "y</article>") == ["x", "y"]
    assert html.html_lines("<article>" + "<table><tr><td>" * 3000 + "x</article>") == ["x"]
    assert html.html_lines("<article>before<table><tr><td>one<tr><td>two</table>after</article>") == ["before", "one", "two", "after"]


def test_unclosed_tags_end_with_what_they_stand_in():
    assert html.html_lines("<article><p>x<sup>1</p><p>y</p></article>") == ["x", "y"]
    assert html.html_lines("<article><div>x<nav>menu</div>text</article>") == ["x", "text"]
    assert html.html_lines("<article><p>a<b>bold</p><p>c</b></p></article>") == ["abold", "c"]
    assert html.html_lines("<div><article>in<script>1</article>out</div>") == ["in"]
