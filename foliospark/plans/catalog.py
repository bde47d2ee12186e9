"""All queries of the engine by name, and SQL that expresses the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schema
from foliospark.functions import text as t
from foliospark.functions import vectors
from foliospark.operators import corpus, embed, ingest, neighbours, pages, quotes, reconcile, refusals, render, retrieve, segment, trace, verify
from foliospark.plans.fixtures import MODEL, TOP_K, Fixtures, blank, norm, with_tables
from foliospark.sources import files, html
from foliospark.storage import shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; the function takes fixtures."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


BUDGET = retrieve.passage_budget()
PACK = 4096

# --- texts -----------------------------------------------------------------


@query(f"SELECT doc_id, {norm('text')} AS text FROM documents")
def normalise(x):
    return x.read("documents").select("doc_id", t.normalise(F.col("text")).alias("text"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprint(x):
    return x.read("documents").select("doc_id", t.fingerprint(F.col("text")).alias("sha256"))


_TRIMMED = norm("text")


@query(r"""WITH t AS (SELECT doc_id, text, nfc_normalize(text) AS c, regexp_replace(text, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS inner_text FROM documents)
SELECT doc_id, 0 AS removed, c <> text AS recomposed, len(list_filter(regexp_extract_all(inner_text, '[\t\n\x0B\f\r ]+'), lambda r: r <> ' '))::int AS runs,
    coalesce(list_sum(list_transform(list_filter(regexp_extract_all(inner_text, '[\t\n\x0B\f\r ]+'), lambda r: r <> ' '), lambda r: length(r) - length(replace(r, chr(10), '')))), 0)::int AS line_breaks, inner_text <> c AS trimmed FROM t""")
def normalisation_report(x):
    return x.read("documents").select("doc_id", *[c.alias(k) for k, c in t.normalisation_report(F.col("text")).items()])


@query("SELECT event_type AS name, lower(replace(replace(event_type, 'EVENT_', ''), '_', '-')) AS label FROM (SELECT DISTINCT 'EVENT_' || upper(event_type) AS event_type FROM events)")
def enum_label(x):
    names = x.read("events").select(F.concat(F.lit("EVENT_"), F.upper("event_type")).alias("name")).distinct()
    return names.select("name", t.enum_label(F.col("name"), "EVENT").alias("label"))


_NUMERALS = ("repeat('M', n // 1000) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1]")


def _numeral(n):
    digit = lambda place, names: F.element_at(F.array(*map(F.lit, names.split(","))), (F.floor(n / place) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, ",C,CC,CCC,CD,D,DC,DCC,DCCC,CM"), digit(10, ",X,XX,XXX,XL,L,LX,LXX,LXXX,XC"), digit(1, ",I,II,III,IV,V,VI,VII,VIII,IX"))


@query(f"SELECT n::int AS n, {_NUMERALS} AS numeral, n::int AS value FROM (SELECT DISTINCT n_chars % 3999 + 1 AS n FROM documents)")
def roman(x):
    n = x.read("documents").select((F.col("n_chars") % 3999 + 1).cast("int").alias("n")).distinct()
    return n.select("n", _numeral(F.col("n")).alias("numeral")).withColumn("value", t.roman(F.col("numeral")))


@query(with_tables("SELECT corpus_id, count(*) AS chunks, median(words) AS median_words, max(words)::int AS longest_words FROM (SELECT corpus_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words FROM chunks) GROUP BY 1", "chunks"))
def token_stats(x):
    return corpus.token_stats(x.raw_chunks)


@query(with_tables(r"""SELECT corpus_id, sum(len(regexp_extract_all(text, '(?i)\bthe\b'))) AS hath, sum(len(regexp_extract_all(text, '(?i)\bhe\b'))) AS doth, sum(len(regexp_extract_all(text, '(?i)\b[0-9A-Za-z_]+ing\b'))) AS eth_verbs,
    sum(len(regexp_extract_all(text, '(?i)\bis\b'))) AS has, sum(len(regexp_extract_all(text, '(?i)\band\b'))) AS does FROM chunks GROUP BY 1""", "chunks"))
def register_profile(x):
    """The counted forms don't occur in the invented texts, so other words stand in for them."""
    word = "[0-9A-Za-z_]"
    forms = {name: f"(?i)(?<!{word}){form}(?!{word})" for name, form in zip(corpus.REGISTER_FORMS, ("the", "he", f"{word}+ing", "is", "and"), strict=True)}
    return corpus.register_profile(x.chunks, forms)


def _visible() -> str:
    out = "text"
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"), (None, None)):
        out = f"replace({out}, '{plain}', '{escaped}')" if plain else f"""replace(replace({out}, chr(10), '<span class="ws">¶</span>' || chr(10)), chr(9), '<span class="ws" title="U+0009">␣</span>')"""
    return out


@query(f"SELECT doc_id, {_visible()} AS html FROM documents")
def visible_whitespace(x):
    return x.read("documents").select("doc_id", t.visible(F.col("text")).alias("html"))


@query("SELECT * FROM (VALUES ('tr', 'named'), ('critical', 'named'), ('majority', 'named')) v(value, only_in)")
def enum_domain(x):
    """Text forms that are named and of which no work is; no work has one that isn't named."""
    return schema.domain_differences(list(schema.TEXT_FORMS), x.works, "text_form")


# --- corpus ------------------------------------------------------------------


@query(with_tables("SELECT id, corpus_id, locator, length(text)::int AS chars, content_hash, normalisation_version FROM chunks", "chunks"))
def scan_chunks(x):
    return x.chunks.select("id", "corpus_id", "locator", F.length("text").alias("chars"), "content_hash", "normalisation_version")


@query(with_tables("SELECT c.id AS chunk_id, corpus_id, locator, work, author, language, text_form, license, content_hash, normalisation_version, embedding_model, dim FROM chunks c JOIN works USING (corpus_id) JOIN vectors v ON v.chunk_id = c.id", "chunks", "works", "vectors"))
def chunk_metadata(x):
    return corpus.chunk_metadata(x.chunks, x.works, x.embeddings)


@query(with_tables("SELECT id, corpus_id, locator, content_hash, normalisation_version, id IN (SELECT chunk_id FROM vectors) AS has_embedding FROM existing", "existing", "vectors"))
def existing_chunks(x):
    return corpus.existing_chunks(x.existing, x.embeddings, MODEL)


@query(with_tables("SELECT id, corpus_id, locator, text FROM chunks WHERE id NOT IN (SELECT chunk_id FROM vectors)", "chunks", "vectors"))
def embedding_backlog(x):
    return corpus.embedding_backlog(x.chunks, x.embeddings, MODEL)


@query(with_tables("SELECT corpus_id, work, author, license, n FROM works WHERE corpus_id IN (SELECT corpus_id FROM spec WHERE tier = 'binding')", "works", "spec"))
def works_by_ids(x):
    return corpus.works_by_ids(x.works.select("corpus_id", "work", "author", "license", "n"), x.spec.filter("tier = 'binding'"))


@query(with_tables("SELECT corpus_id, corpus_id IN (SELECT c.corpus_id FROM chunks c JOIN vectors v ON v.chunk_id = c.id) AS found FROM works", "works", "chunks", "vectors"))
def corpus_exists(x):
    return corpus.corpus_exists(x.works, corpus.chunk_metadata(x.chunks, x.works, x.embeddings))


@query(with_tables("SELECT 'DOC ' || id % 100 AS locator, count(DISTINCT corpus_id) AS corpora, min(corpus_id) AS first_corpus, max(corpus_id) AS last_corpus FROM chunks GROUP BY 1 HAVING count(DISTINCT corpus_id) > 1", "chunks"))
def shared_locators(x):
    return corpus.shared_locators(x.narrow_chunks.withColumn("locator", F.concat(F.lit("DOC "), (F.col("id") % 100).cast("string"))))


@query(with_tables("SELECT corpus_id, 'DOC ' || id % 100 AS locator, count(*) AS n FROM chunks GROUP BY 1, 2 HAVING count(*) > 1", "chunks"))
def duplicate_locators(x):
    return corpus.duplicate_locators(x.narrow_chunks.withColumn("locator", F.concat(F.lit("DOC "), (F.col("id") % 100).cast("string"))))


@query(with_tables("SELECT corpus_id, count(*) AS chunk_count FROM chunks GROUP BY 1", "chunks"))
def discover_smallest_first(x):
    return corpus.smallest_first(x.narrow_chunks)


@query(with_tables("SELECT corpus_id, count(*) + CASE WHEN corpus_id LIKE 'src1%' THEN 1 ELSE 0 END AS stated, count(*) AS found FROM chunks WHERE corpus_id LIKE 'src1%' GROUP BY 1", "chunks"))
def staged_count_check(x):
    n = x.narrow_chunks.groupBy("corpus_id").agg((F.count(F.lit(1)) + F.when(F.col("corpus_id").startswith("src1"), 1).otherwise(0)).alias("chunk_count"))
    return corpus.staged_counts(x.narrow_chunks, n)


@query(with_tables("SELECT corpus_id, tier, position FROM spec", "spec"))
def filter_spec(x):
    return x.spec


@query(with_tables("SELECT corpus_id, locator FROM chunks ORDER BY corpus_id, locator LIMIT 50", "chunks"))
def sample_refs(x):
    return corpus.page_slice(x.narrow_chunks.select("corpus_id", "locator"), ["corpus_id", "locator"], 0, 50)


@query(with_tables("SELECT corpus_id, locator FROM chunks ORDER BY corpus_id, locator LIMIT 20 OFFSET 60", "chunks"))
def page_slice(x):
    return pages.page_slice(x.narrow_chunks.select("corpus_id", "locator"), ["corpus_id", "locator"], 3, 20)


@query(with_tables("SELECT corpus_id, locator FROM chunks QUALIFY (row_number() OVER (ORDER BY corpus_id, locator) - 1) // 50 = (SELECT count(*) * 2 // 3 // 50 FROM chunks)", "chunks"))
def page_beyond_the_middle(x):
    rows = x.narrow_chunks.select("corpus_id", "locator")
    return pages.page_slice(rows, ["corpus_id", "locator"], rows.count() * 2 // 3 // 50, 50)


@query(with_tables("""SELECT p.corpus_id, page, pages, place, p.locator, CASE WHEN license NOT IN ('refused', 'local-only') THEN p.text END AS text, e.content_hash = p.content_hash AS blessed,
    CASE WHEN license = 'refused' THEN 'the licence is `refused`, which permits serving under no configuration' WHEN license = 'local-only' THEN 'the licence is `local-only` and the deployer opt-in is unset, so the default deny applies' END AS withheld
    FROM (SELECT *, (n + 3) // 4 AS pages, least(2, (n + 3) // 4 - 1) AS page FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY locator) - 1 AS place, count(*) OVER (PARTITION BY corpus_id) AS n FROM staged)) p
    JOIN works w ON w.corpus_id = p.corpus_id LEFT JOIN existing e ON e.corpus_id = p.corpus_id AND e.locator = p.locator WHERE place // 4 = page""", "staged", "existing", "works"))
def browse_pages(x):
    """The third page of each corpus, or its last."""
    staged = x.staged
    return pages.browse(staged, x.works, x.prints(x.existing), 2, 4)


@query(with_tables(r"SELECT corpus_id, l AS locator, regexp_full_match(l, '\S+( \S+)*') AS locator_ok, regexp_full_match(corpus_id, '[a-z0-9]+(-[a-z0-9]+)+') AS corpus_ok FROM (SELECT corpus_id, CASE id % 4 WHEN 0 THEN locator WHEN 1 THEN ' ' || locator WHEN 2 THEN 'DOC  ' || id ELSE '' END AS l FROM chunks)", "chunks"))
def locator_valid(x):
    name = F.col("locator")
    odd = F.when(F.col("id") % 4 == 0, name).when(F.col("id") % 4 == 1, F.concat(F.lit(" "), name)).when(F.col("id") % 4 == 2, F.concat(F.lit("DOC  "), F.col("id").cast("string"))).otherwise("")
    return corpus.locator_valid(x.narrow_chunks.withColumn("locator", odd))


@query(with_tables("SELECT corpus_id, tier, work, author, license, CASE WHEN tier IN ('contrary', 'excluded') THEN 'label of ' || corpus_id ELSE '' END AS label FROM spec JOIN works USING (corpus_id)", "spec", "works"))
def citation_sources(x):
    labels = x.spec.filter("tier IN ('contrary', 'excluded')").select("corpus_id", F.concat(F.lit("label of "), "corpus_id").alias("label"))
    return corpus.citation_sources(x.spec.select("corpus_id", "tier"), x.works, labels)


# --- ingestion -----------------------------------------------------------------

_DIFF = """SELECT coalesce(a.corpus_id, b.corpus_id) AS corpus_id, coalesce(a.locator, b.locator) AS locator, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unexpected' ELSE 'mismatched' END AS class
FROM existing a FULL JOIN staged b ON a.corpus_id = b.corpus_id AND a.locator = b.locator WHERE a.content_hash IS DISTINCT FROM b.content_hash"""


def _diff(x):
    return ingest.fingerprint_diff(x.prints(x.existing), x.prints(x.staged))


@query(with_tables(_DIFF, "existing", "staged"))
def fingerprint_diff(x):
    return _diff(x)


@query(with_tables(_DIFF, "existing", "staged"))
def stored_diff(x):
    at = f"{shared_dir(x.spark)}/prints-{uuid.uuid4().hex}"
    for name, rows in (("committed", x.existing), ("acquired", x.staged)):
        reconcile.write_prints(x.prints(rows), f"{at}/{name}", 1)
    return reconcile.stored_diff(x.spark, f"{at}/committed", f"{at}/acquired", 1)


@query(with_tables("""SELECT class, count(*) AS n, (SELECT string_agg(locator, ', ' ORDER BY locator, corpus_id) FROM (SELECT * FROM d e WHERE e.class = d.class ORDER BY locator, corpus_id LIMIT 10)) AS sample FROM d GROUP BY class""", "existing", "staged", d=_DIFF))
def diff_summary(x):
    return ingest.diff_summary(_diff(x))


_COUNTED = """SELECT corpus_id, coalesce(a, 0) AS committed_count, coalesce(b, 0) AS acquired_count, coalesce(m, 0) AS missing, coalesce(u, 0) AS unexpected, coalesce(i, 0) AS mismatched
    FROM (SELECT corpus_id, count(*) AS a FROM existing GROUP BY 1) FULL JOIN (SELECT corpus_id, count(*) AS b FROM staged GROUP BY 1) USING (corpus_id)
    LEFT JOIN (SELECT corpus_id, count_if(class = 'missing') AS m, count_if(class = 'unexpected') AS u, count_if(class = 'mismatched') AS i FROM d GROUP BY 1) USING (corpus_id)"""
_EDITION = """SELECT e.corpus_id, CASE WHEN s.content_hash IS NULL THEN 'gone' WHEN s.content_hash <> e.expected_sha256 THEN 'changed' ELSE 'matches' END AS edition
    FROM manifests e LEFT JOIN staged s ON s.corpus_id = e.corpus_id AND s.locator = e.diagnostic"""


@query(with_tables("""SELECT n.*, committed_count = acquired_count AS count_ok, coalesce(edition, 'unblessed') AS edition, edition IS NOT NULL AND corpus_id LIKE 'src2%' AS upstream_drifted,
    committed_count = acquired_count AND missing + unexpected + mismatched = 0 AND coalesce(edition, '') = 'matches' AS ok FROM n LEFT JOIN w USING (corpus_id)""", "existing", "staged", "manifests", d=_DIFF, n=_COUNTED, w=_EDITION))
def verify_report(x):
    return ingest.verify_report(_diff(x), x.prints(x.existing), x.prints(x.staged), x.manifests, x.fetched)


@query(with_tables("""SELECT DISTINCT s.corpus_id, CASE WHEN s.corpus_id NOT IN (SELECT corpus_id FROM k) THEN 'unblessed' WHEN s.corpus_id IN (SELECT corpus_id FROM e) THEN 'drifted' ELSE 'blessed' END AS status FROM staged s""", "existing", "staged",
                   k="SELECT * FROM existing WHERE corpus_id NOT LIKE 'src3-%' AND (corpus_id NOT LIKE 'src1%')",
                   k2="SELECT * FROM staged WHERE corpus_id LIKE 'src4-%'",
                   e="""SELECT coalesce(a.corpus_id, b.corpus_id) AS corpus_id FROM (SELECT corpus_id, locator, content_hash FROM k WHERE corpus_id NOT LIKE 'src4-%' UNION ALL SELECT corpus_id, locator, content_hash FROM k2) a
                   FULL JOIN staged b ON a.corpus_id = b.corpus_id AND a.locator = b.locator WHERE a.content_hash IS DISTINCT FROM b.content_hash"""))
def corpus_status(x):
    known = x.prints(x.existing).filter("corpus_id NOT LIKE 'src3-%' AND corpus_id NOT LIKE 'src1%' AND corpus_id NOT LIKE 'src4-%'")
    return ingest.corpus_status(known.unionByName(x.prints(x.staged).filter("corpus_id LIKE 'src4-%'")), x.prints(x.staged))


@query(with_tables("SELECT s.corpus_id, s.locator, e.content_hash = s.content_hash AS blessed FROM staged s LEFT JOIN existing e ON e.corpus_id = s.corpus_id AND e.locator = s.locator", "existing", "staged"))
def chunk_blessed_flag(x):
    return ingest.blessed_flag(x.staged, x.prints(x.existing))


_STORED = "SELECT id, locator, CASE WHEN id % 7 = 0 THEN 'old ' || text ELSE text END AS text FROM staged"


@query(with_tables(f"SELECT o.id AS doc_id, {norm('d.text')} = o.text AS matches FROM o JOIN documents d ON 'DOC ' || d.doc_id = o.locator", "staged", o=_STORED))
def raw_matches_stage(x):
    """What is staged, some of it of an older edition, against the raw table."""
    stored = x.staged.select("locator", F.when(F.col("id") % 7 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")).alias("stored"))
    raw = x.read("documents").select("doc_id", F.concat(F.lit("DOC "), F.col("doc_id").cast("string")).alias("locator"), "text")
    return raw.join(stored, "locator").select("doc_id", (t.normalise(F.col("text")) == F.col("stored")).alias("matches"))


_BLESSED = "SELECT * FROM existing WHERE corpus_id NOT LIKE 'src3-%'"


@query(with_tables("""SELECT corpus_id, refusal FROM (SELECT s.corpus_id, CASE WHEN s.corpus_id NOT IN (SELECT corpus_id FROM b) THEN 'never blessed'
    WHEN m + u + i > 0 THEN 'disagrees with what was blessed: ' || m || ' missing, ' || u || ' unexpected, ' || i || ' mismatched' END AS refusal FROM (SELECT DISTINCT corpus_id FROM staged) s LEFT JOIN
    (SELECT corpus_id, count_if(a IS NULL) AS u, count_if(z IS NULL) AS m, count_if(a <> z) AS i FROM (SELECT coalesce(b.corpus_id, s.corpus_id) AS corpus_id, b.content_hash AS a, sha256(s.text) AS z FROM b FULL JOIN staged s ON b.corpus_id = s.corpus_id AND b.locator = s.locator) GROUP BY 1) USING (corpus_id)) WHERE refusal IS NOT NULL""",
    "existing", "staged", b=_BLESSED))
def ingest_refusals(x):
    """The hashes that staged records carry are all wrong here: they are not looked at."""
    return ingest.ingest_refusals(x.staged.withColumn("content_hash", F.lit("not this")), x.prints(x.existing).filter("corpus_id NOT LIKE 'src3-%'"))


@query(with_tables("""SELECT corpus_id, unnest(list_filter([CASE WHEN n % 3 = 0 THEN 'license' END, CASE WHEN n % 4 = 0 AND author IS NOT NULL OR n % 4 = 1 AND author IS NULL THEN 'author' END], lambda f: f IS NOT NULL)) AS field FROM
    (SELECT corpus_id, n, author FROM works)""", "works"))
def manifest_mismatch(x):
    other = x.works.select("corpus_id", F.when(F.col("n") % 3 == 0, "other").otherwise(F.col("license")).alias("license"), F.when(F.col("n") % 4 == 0, None).when((F.col("n") % 4 == 1) & F.col("author").isNull(), "someone").otherwise(F.col("author")).alias("author"))
    return ingest.manifest_mismatches(x.works, other, ["license", "author"])


_PLAN = """SELECT coalesce(s.corpus_id, e.corpus_id) AS corpus_id, coalesce(s.locator, e.locator) AS locator, CASE WHEN e.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN 'delete' WHEN e.content_hash <> s.content_hash THEN 'update'
    WHEN e.id NOT IN (SELECT chunk_id FROM vectors) THEN 'unembedded' ELSE 'unchanged' END AS action FROM staged s FULL JOIN existing e ON e.corpus_id = s.corpus_id AND e.locator = s.locator"""


def _plan(x):
    return ingest.ingest_plan(x.staged, corpus.existing_chunks(x.existing, x.embeddings, MODEL))


@query(with_tables(_PLAN, "staged", "existing", "vectors"))
def ingest_plan(x):
    return _plan(x)


@query(with_tables("""SELECT corpus_id, count_if(action = 'insert') AS inserts, count_if(action = 'update') AS updates, count_if(action = 'delete') AS deletes, count_if(action IN ('unchanged', 'unembedded')) AS unchanged,
    count_if(action = 'unembedded') AS unembedded, count_if(action IN ('insert', 'update', 'unembedded')) AS backlog, count_if(action IN ('insert', 'update', 'delete')) AS writes, count_if(action <> 'unchanged') = 0 AS converged FROM p GROUP BY 1""", "staged", "existing", "vectors", p=_PLAN))
def plan_tally(x):
    return ingest.plan_tally(_plan(x))


@query(with_tables("SELECT corpus_id, 2 AS stored, 1 AS staged FROM chunks GROUP BY 1 HAVING count_if(corpus_id NOT LIKE 'src2%' AND normalisation_version <> 2) = 0", "chunks"))
def contract_change(x):
    """All chunks of some corpora are of the older contract, of others some."""
    version = F.when(F.col("corpus_id").startswith("src2"), 2).when(F.col("id") % 50 == 0, 2).otherwise(1)
    return ingest.contract_change(x.narrow_chunks.withColumn("normalisation_version", version))


@query(with_tables("""SELECT corpus_id, count_if(words > 600) AS over, count(*) AS chunks, array_to_string(list_transform(list_slice(list_sort(list({'l': locator, 'w': words}) FILTER (WHERE words > 600)), 1, 10), lambda r: r.l || ' (' || r.w || ')'), ', ') AS sample FROM w GROUP BY 1 HAVING count_if(words > 600) > 0""", "staged",
                   w="SELECT corpus_id, locator, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words FROM staged"))
def over_limit(x):
    return ingest.over_limit(x.raw_chunks.filter("id % 10 <> 2"), 600)


_APPLIED = """SELECT s.text, coalesce(e.id, (SELECT max(id) FROM existing) + row_number() OVER (PARTITION BY e.id IS NULL ORDER BY s.corpus_id, s.locator)) AS id, s.corpus_id, s.locator, s.content_hash,
    CASE WHEN e.content_hash = s.content_hash THEN e.normalisation_version ELSE 1 END AS normalisation_version FROM staged s LEFT JOIN existing e ON e.corpus_id = s.corpus_id AND e.locator = s.locator"""


@query(with_tables(_APPLIED, "staged", "existing"))
def apply_text(x):
    return ingest.apply_text(x.existing, x.staged)


@query(with_tables("SELECT chunk_id, embedding_model FROM vectors WHERE chunk_id NOT IN (SELECT a.id FROM a JOIN existing e ON e.id = a.id AND e.content_hash = a.content_hash)", "staged", "existing", "vectors", a=_APPLIED))
def stale_vectors(x):
    staged, existing = x.hashed()
    return ingest.stale_vectors(x.embeddings, existing, ingest.apply_text(existing, staged))


@query(with_tables("""SELECT corpus_id, CASE WHEN n % 4 <> 1 THEN work || ' new' ELSE work END AS work, CASE WHEN n % 4 <> 1 THEN NULL ELSE author END AS author, CASE WHEN n % 4 <> 2 THEN 'then' END AS ingested_at FROM works""", "works"))
def works_upsert(x):
    old = x.works.filter("n % 4 <> 2").select("corpus_id", "work", "author", F.lit("then").alias("ingested_at"))
    new = x.works.filter("n % 4 <> 1").select("corpus_id", F.concat("work", F.lit(" new")).alias("work"), F.lit(None).cast("string").alias("author"))
    return ingest.works_upsert(old, new)


@query(with_tables("SELECT id, corpus_id, words, batch FROM f", "chunks", recursive=True,
                   w="SELECT id, corpus_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words FROM chunks",
                   o="SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY words, id) AS r FROM w",
                   f=f"""SELECT id, corpus_id, words, r, 0::bigint AS batch, 1::bigint AS fill FROM o WHERE r = 1 UNION ALL
                   SELECT o.id, o.corpus_id, o.words, o.r, CASE WHEN (f.fill + 1) * o.words > {PACK} THEN f.batch + 1 ELSE f.batch END, CASE WHEN (f.fill + 1) * o.words > {PACK} THEN 1 ELSE f.fill + 1 END FROM f JOIN o ON o.corpus_id = f.corpus_id AND o.r = f.r + 1"""))
def batch_pack(x):
    return ingest.batch_pack(x.raw_chunks, PACK)


def _quarters():
    """An invented tokenizer: words in pieces of four letters."""
    return lambda texts: [sum(-(-len(w) // 4) for w in x.split(" ")) for x in texts]


@query(with_tables("SELECT corpus_id, count(*) AS chunks, median(words) AS median_words, max(words)::bigint AS longest_words FROM (SELECT corpus_id, coalesce(list_sum(list_transform(string_split(text, ' '), lambda w: (length(w) + 3) // 4)), 0)::bigint AS words FROM chunks) GROUP BY 1", "chunks"))
def token_stats_hook(x):
    return corpus.token_stats(x.chunks, embed.token_counts(x.chunks, _quarters, "corpus_id"))


def _sizes():
    """An invented embedder: words and characters of a text, and the texts of a batch do not matter."""
    return lambda texts: [[float(len(x.split())), float(len(x))] for x in texts]


@query(with_tables("SELECT id AS chunk_id, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END)::double AS words, length(text)::double AS chars FROM chunks WHERE id NOT IN (SELECT chunk_id FROM vectors)", "chunks", "vectors"))
def embedded_backlog(x):
    waiting = written(corpus.embedding_backlog(x.chunks, x.embeddings, MODEL), "backlog")  # texts are read twice, and normalised once
    made = embed.embed(waiting, _sizes, 2, PACK)
    return made.select("chunk_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("words", "chars"))])


@query(with_tables("SELECT corpus_id, locator, locator || '  ' || content_hash AS value FROM chunks", "chunks"))
def fingerprint_render(x):
    return files.render_fingerprints(x.chunks)


@query(with_tables("SELECT corpus_id, CASE WHEN id % 9 = 0 THEN '' ELSE 'DOC ' || id % 500 END AS locator, CASE WHEN id % 9 = 0 THEN '' ELSE content_hash END AS sha256, CASE WHEN id % 9 = 0 THEN 'malformed' WHEN count(*) FILTER (WHERE id % 9 <> 0) OVER (PARTITION BY corpus_id, id % 500) > 1 THEN 'duplicate' ELSE '' END AS problem FROM chunks", "chunks"))
def fingerprint_parse(x):
    line = F.concat(F.lit("DOC "), (F.col("id") % 500).cast("string"), F.when(F.col("id") % 9 == 0, " ").otherwise("  "), "content_hash")
    return files.parse_fingerprints(x.chunks.select("corpus_id", line.alias("value")))


# --- retrieval -----------------------------------------------------------------

_SCORES = "SELECT q.vec_id AS query_id, v.chunk_id, c.corpus_id, c.locator, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS score FROM embeddings q, vectors v JOIN chunks c ON c.id = v.chunk_id WHERE q.vec_id % 100 = 0"
_HITS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE corpus_id IN (SELECT corpus_id FROM spec)) WHERE rank <= {TOP_K}"


def _hits(x):
    return retrieve.search(x.embeddings, x.narrow_chunks, x.queries, x.spec, MODEL, TOP_K)


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 6) AS score, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20""")
def knn_topk(x):
    found = neighbours.ball_knn(x.read("embeddings"), x.queries, TOP_K, id_col="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query(with_tables("SELECT query_id, chunk_id, corpus_id, locator, round(score, 6) AS score, rank::int AS rank FROM h", "chunks", "vectors", "spec", s=_SCORES, h=_HITS))
def knn_filtered(x):
    return _hits(x).withColumn("score", F.round("score", 6))


@query(with_tables("SELECT locus, c.id AS chunk_id, l.corpus_id, l.locator FROM loci l JOIN chunks c ON c.corpus_id = l.corpus_id AND c.locator = l.locator WHERE c.id IN (SELECT chunk_id FROM vectors)", "loci", "vectors"))
def pinned_rulings(x):
    return retrieve.pinned_rulings(x.loci, x.narrow_chunks, x.embeddings, MODEL)


_CANDIDATES = f"""o AS (SELECT query_id, chunk_id, corpus_id, locator, score, pinned, chars, known, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, CASE WHEN pinned THEN chunk_id ELSE rank END) AS rank FROM (
    SELECT q.query_id, c.id AS chunk_id, c.corpus_id, c.locator, h.score, c.id IN (12, 14) AS pinned, length(c.text) AS chars, h.rank, c.corpus_id IN (SELECT corpus_id FROM spec) AS known
    FROM (SELECT DISTINCT query_id FROM h) q CROSS JOIN chunks c LEFT JOIN h ON h.query_id = q.query_id AND h.chunk_id = c.id WHERE h.chunk_id IS NOT NULL OR (c.id IN (12, 14) AND c.id IN (SELECT chunk_id FROM vectors)))),
f AS (SELECT *, known AND (pinned OR chars <= {BUDGET}) AS included, CASE WHEN known AND (pinned OR chars <= {BUDGET}) THEN chars ELSE 0 END AS used FROM o WHERE rank = 1 UNION ALL
    SELECT o.*, o.known AND (o.pinned OR f.used + o.chars <= {BUDGET}), f.used + CASE WHEN o.known AND (o.pinned OR f.used + o.chars <= {BUDGET}) THEN o.chars ELSE 0 END FROM f JOIN o ON o.query_id = f.query_id AND o.rank = f.rank + 1)"""
_FOLD = with_tables("SELECT 1", "chunks", "vectors", "spec", recursive=True, s=_SCORES, h=_HITS).rpartition("\n")[0] + ",\n" + _CANDIDATES


def _candidates(x):
    pinned = retrieve.pinned_rulings(x.loci, x.narrow_chunks, x.embeddings, MODEL)
    return retrieve.context_budget(_hits(x), pinned, x.spec, x.chunks, BUDGET)


@query(_FOLD + " SELECT query_id, rank::int AS rank, chunk_id, corpus_id, locator, round(score, 6) AS score, included, CASE WHEN included THEN '' WHEN NOT known THEN 'corpus not in the filter spec' ELSE 'context budget' END AS exclusion_reason FROM f")
def context_budget(x):
    return _candidates(x).withColumn("score", F.round("score", 6))


@query(_FOLD + " SELECT query_id, chunk_id, rank::int AS rank FROM f")
def candidates_rank(x):
    return _candidates(x).select("query_id", "chunk_id", "rank")


@query(_FOLD + " SELECT query_id, count(*) AS considered, count_if(included) AS included FROM f GROUP BY 1")
def candidate_summary(x):
    return trace.candidate_summary(_candidates(x))


@query(_FOLD + """ SELECT query_id, rank::int AS rank, printf('    %3d  %.4f  %-8s [%s] %s %s', rank::int, coalesce(score, 0.0), CASE WHEN included THEN 'included' ELSE 'dropped' END, coalesce(tier, 'unspecified'), corpus_id, locator)
    || CASE WHEN included THEN '' WHEN NOT known THEN '  (corpus not in the filter spec)' ELSE '  (context budget)' END AS line FROM f LEFT JOIN spec USING (corpus_id)""")
def render_trace(x):
    return trace.render_candidates(_candidates(x), x.spec)


@query(_FOLD + """, i AS (SELECT corpus_id, count(*) AS a FROM chunks GROUP BY 1), r AS (SELECT corpus_id, count(*) AS b FROM f WHERE included GROUP BY 1), j AS (SELECT corpus_id, a, coalesce(b, 0) AS b FROM i LEFT JOIN r USING (corpus_id))
    SELECT corpus_id, round(a / sum(a) OVER (), 6) AS index_share, round(b / sum(b) OVER (), 6) AS retrieved_share, round((b / sum(b) OVER ()) / (a / sum(a) OVER ()), 6) AS ratio FROM j""")
def retrieval_share(x):
    return trace.retrieval_share(_candidates(x), x.narrow_chunks)


@query(_FOLD + """ SELECT f.query_id, count(*) AS passages, string_agg('[' || f.corpus_id || ' ' || f.locator || chr(93) || chr(10) || c.text, chr(10) || chr(10) ORDER BY f.rank) AS prompt, bool_or(contains(c.text, '%%%')) AS refused FROM f JOIN chunks c ON c.id = f.chunk_id WHERE included GROUP BY 1""")
def prompt_passages(x):
    return retrieve.prompt_passages(_candidates(x), x.chunks, "%%%").withColumn("passages", F.col("passages").cast("long"))


_PROMPT = f"""{_FOLD}, p AS (SELECT f.*, t.tier, w.work, c.text, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS i FROM f JOIN chunks c ON c.id = f.chunk_id LEFT JOIN spec t ON t.corpus_id = f.corpus_id LEFT JOIN works w ON w.corpus_id = f.corpus_id WHERE included),
b AS (SELECT query_id, string_agg('PASSAGE ' || i || chr(10) || 'corpus_id: ' || corpus_id || chr(10) || 'locator: ' || locator || chr(10) || 'tier: ' || coalesce(tier, 'unspecified') || chr(10) || 'work: ' || coalesce(work, '') || chr(10) || '<<<' || chr(10) || text || chr(10) || '>>>', chr(10) || chr(10) ORDER BY i) AS shown,
    bool_or(contains(text, '<<<') OR contains(text, '>>>')) AS refused FROM p GROUP BY 1),
l AS (SELECT CASE WHEN id = 12 THEN 'locus-a' ELSE 'locus-b' END AS locus, corpus_id, locator FROM chunks WHERE id IN (12, 14) UNION ALL SELECT 'locus-c', 'src0-en-invented', 'DOC -1')
SELECT q.vec_id AS query_id, 'Cite.' || chr(10) || chr(10) || 'CORPORA IN SCOPE, AND THE STANCE TAKEN TOWARD EACH' || chr(10) || (SELECT string_agg('- ' || corpus_id || ' (' || tier || ')', chr(10) ORDER BY position, corpus_id) FROM spec) || chr(10) || chr(10)
    || 'QUESTIONS THIS TRADITION HOLDS OPEN' || chr(10) || (SELECT string_agg('- ' || locus || ': established by ' || corpus_id || ' ' || locator, chr(10) ORDER BY locus) FROM l) || chr(10) || 'Take no side.' AS system,
    CASE WHEN q.vec_id % 200 = 0 THEN '- it failed' || chr(10) || chr(10) ELSE '' END || coalesce(shown, 'No passages were retrieved for this question.') || chr(10) || chr(10) || 'QUESTION' || chr(10) || 'what is ' || q.vec_id AS "user", coalesce(refused, false) AS refused
    FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN b ON b.query_id = q.vec_id"""


@query(_PROMPT)
def build_prompt(x):
    queries = x.queries.select(F.col("vec_id").alias("query_id"), F.concat(F.lit(" what is "), F.col("vec_id").cast("string")).alias("query"))
    rows = _candidates(x).filter("included").select("query_id", "rank", "chunk_id", "corpus_id", "locator")
    texts = x.raw_chunks.select(F.col("id").alias("chunk_id"), "text")
    rows = rows.join(texts, "chunk_id").withColumn("text", t.normalise(F.col("text"))).join(x.spec.select("corpus_id", "tier"), "corpus_id", "left").join(x.works.select("corpus_id", "work"), "corpus_id", "left")
    failures = queries.filter("query_id % 200 = 0").select("query_id", F.lit(0).alias("ord"), F.lit("- it failed").alias("line"))
    return retrieve.build_prompts(queries, rows, x.spec, x.loci, "Cite.", "Take no side.", failures=failures)


@query(with_tables("""SELECT query_id, relevant, hits, round(hits / relevant, 6) AS recall FROM (SELECT g.query_id, count(*) AS relevant, count(h.chunk_id) AS hits
    FROM (SELECT q.vec_id AS query_id, v.chunk_id FROM embeddings q JOIN vectors v ON v.label = q.label AND v.chunk_id <> q.vec_id WHERE q.vec_id % 100 = 0) g LEFT JOIN (SELECT * FROM h WHERE rank <= 10) h ON h.query_id = g.query_id AND h.chunk_id = g.chunk_id GROUP BY 1)""", "chunks", "vectors", "spec", s=_SCORES, h=_HITS))
def recall_at_k(x):
    labels = x.embeddings.select("chunk_id", "label")
    queries = x.read("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return trace.recall_by_label(_hits(x), labels, queries, 10)


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x * 3.0)::double * (x * 3.0)::double)) / list_sum(list_transform(embedding, lambda x: (x * 3.0)::double * (x * 3.0)::double)), 6) AS norm, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) AS first FROM embeddings""")
def l2_normalise(x):
    unit = vectors.l2_normalise(F.transform("embedding", lambda v: v.cast("double") * 3.0))
    return x.read("embeddings").select("vec_id", unit.alias("u")).select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"))


# --- verification -----------------------------------------------------------------


def _checked(citations: str, keys: str, opt_in: bool = False) -> str:
    """The four checks and details over a flat table of citations."""
    local = "" if opt_in else "WHEN license = 'local-only' THEN 'the licence is `local-only` and the deployer opt-in is unset, so the default deny applies'"
    return f"""SELECT {keys}, corpus_id, locator, slot, quote, resolved AS locator_resolved, matched AS quote_matched, permitted AS tier_permitted, resolved AND refusal IS NULL AS license_permitted,
    concat_ws('; ', CASE WHEN NOT resolved THEN 'no chunk carries "' || corpus_id || '" at "' || locator || '"' END,
        CASE WHEN NOT resolved THEN 'the quote could not be checked: the locator resolved to no chunk' WHEN length(q) < 40 THEN 'the quote is ' || length(q) || ' characters after normalisation and the floor is 40'
             WHEN NOT matched THEN 'the quote does not appear verbatim in that chunk after normalisation' || CASE WHEN version <> 1 THEN '; the chunk was ingested under normalisation contract version ' || version || ' and this build normalises at version 1, which is the likelier cause than the quote' ELSE '' END END,
        CASE WHEN tier IS NULL THEN '"' || corpus_id || '" was not in the filter spec sent for this turn' WHEN NOT permitted THEN '"' || corpus_id || '" sits at ' || tier || ' under the resolved profile, and an affirmative claim never rests on it' END,
        CASE WHEN NOT resolved THEN 'the licence could not be checked: the locator resolved to no chunk' ELSE refusal END) AS failure_detail
    FROM (SELECT *, resolved AND length(q) >= 40 AND contains(body, q) AS matched, tier IS NOT NULL AND (slot <> 'arguments' OR tier IN ('binding', 'governing', 'advisory')) AS permitted,
            CASE WHEN license = 'refused' THEN 'the licence is `refused`, which permits serving under no configuration' {local} END AS refusal
        FROM (SELECT x.*, h.id IS NOT NULL AS resolved, coalesce(h.text, '') AS body, {norm('x.quote')} AS q, s.tier, w.license, h.normalisation_version AS version
            FROM {citations} x LEFT JOIN chunks h ON h.corpus_id = x.corpus_id AND h.locator = x.locator LEFT JOIN works w ON w.corpus_id = h.corpus_id LEFT JOIN spec s ON s.corpus_id = x.corpus_id))"""


_ITEMS = with_tables("SELECT * FROM v", "citations", "works", "spec", v=_checked("citations", "item_id"))


def _verified(x, opt_in=False):
    return verify.verify_citations(x.citations, x.raw_chunks, x.works, x.spec, opt_in)


def _pick(columns: str) -> str:
    return with_tables(f"SELECT {columns} FROM v", "citations", "works", "spec", v=_checked("citations", "item_id"))


@query(_ITEMS)
def verify_citations(x):
    return _verified(x).select("item_id", "corpus_id", "locator", "slot", "quote", *trace.CHECKS, "failure_detail")


@query(_pick("item_id, corpus_id, locator, locator_resolved"))
def check1_resolve(x):
    return _verified(x).select("item_id", "corpus_id", "locator", "locator_resolved")


@query(_pick("item_id, quote_matched"))
def check2_quote(x):
    return _verified(x).select("item_id", "quote_matched")


@query(_pick("item_id, slot, tier_permitted"))
def check3_tier(x):
    return _verified(x).select("item_id", "slot", "tier_permitted")


@query(with_tables("SELECT item_id, license_permitted, failure_detail FROM v", "citations", "works", "spec", v=_checked("citations", "item_id", True)))
def check4_license_opt_in(x):
    return _verified(x, True).select("item_id", "license_permitted", "failure_detail")


@query(with_tables("""SELECT corpus_id, license, CASE WHEN license = 'refused' THEN 'the licence is `refused`, which permits serving under no configuration' WHEN license = 'local-only' THEN 'the licence is `local-only` and the deployer opt-in is unset, so the default deny applies' END AS refusal FROM works""", "works"))
def license_gate(x):
    return x.works.select("corpus_id", "license", verify.licence_refusal(F.col("license")).alias("refusal"))


@query(with_tables("SELECT q.item_id AS quote_id, c.id FROM quotes q JOIN chunks c ON contains(c.text, q.text)", "quotes", "chunks"))
def quote_contains(x):
    return quotes.quote_contains(written(x.chunks.select("id", "text"), "texts"), x.quotes)


@query(_pick("count(*) AS citations, round(count_if(NOT locator_resolved) / count(*), 6) AS locator_resolved_failed, round(count_if(NOT quote_matched) / count(*), 6) AS quote_matched_failed, round(count_if(NOT tier_permitted) / count(*), 6) AS tier_permitted_failed, round(count_if(NOT license_permitted) / count(*), 6) AS license_permitted_failed"))
def check_rates(x):
    return trace.check_rates(_verified(x))


_PLACED = "SELECT answer_id, slot_order, slot, CASE WHEN slot = 'contested' THEN 0 ELSE place END AS i, CASE WHEN slot = 'contested' THEN place ELSE 0 END AS j, corpus_id, locator, quote FROM placed"


@query(with_tables(_PLACED, "placed"))
def citations_exploded(x):
    return verify.exploded(x.answers, ["answer_id"]).select("answer_id", "slot_order", "slot", "i", "j", "corpus_id", "locator", "quote")


def _results(x):
    return verify.verify_citations(verify.exploded(x.answers, ["answer_id"]), x.raw_chunks, x.works, x.spec)


_RESULTS = {"e": _PLACED, "v": _checked("e", "answer_id, slot_order, i, j")}


@query(with_tables("SELECT answer_id, slot_order, i, j, locator_resolved, quote_matched, tier_permitted, license_permitted, failure_detail FROM v", "placed", "works", "spec", **_RESULTS))
def answer_citations_verified(x):
    return _results(x).select("answer_id", "slot_order", "i", "j", *trace.CHECKS, "failure_detail")


_RULES = f"""
r AS (SELECT * FROM loci),
arg AS (SELECT e.answer_id, e.i, s.tier FROM e LEFT JOIN spec s USING (corpus_id) WHERE slot = 'arguments'),
con AS (SELECT f.answer_id, r.corpus_id, r.locator, (SELECT quote FROM e WHERE e.answer_id = f.answer_id AND e.slot = 'contested' AND e.corpus_id = r.corpus_id AND e.locator = r.locator ORDER BY j LIMIT 1) AS cited, r.locus IS NOT NULL AS known FROM answer_facts f LEFT JOIN r ON r.locus = f.locus WHERE f.is_contested),
rules AS (
SELECT answer_id, 1 AS step, i AS nth, 'argument-lacks-authority' AS code, 'arguments[' || i || ']' AS slot, '' AS corpus_id, '' AS locator FROM arg WHERE coalesce(tier NOT IN ('binding', 'governing'), true)
UNION ALL SELECT answer_id, 1, cited_arguments, 'citations-required', 'arguments[' || cited_arguments || ']', '', '' FROM answer_facts WHERE bare = 1
UNION ALL SELECT answer_id, 4, 0, 'position-without-arguments', 'position', '', '' FROM answer_facts WHERE position <> '' AND cited_arguments + bare = 0
UNION ALL SELECT answer_id, 5, 0, 'contested-with-arguments', 'arguments', '', '' FROM answer_facts WHERE is_contested AND cited_arguments + bare > 0
UNION ALL SELECT answer_id, 6, 0, 'contested-locus-unknown', 'contested.locus', '', '' FROM con WHERE NOT known
UNION ALL SELECT answer_id, 6, 0, 'contested-ruling-uncited', 'contested.citations', corpus_id, locator FROM con WHERE known AND cited IS NULL
UNION ALL SELECT answer_id, 6, 0, 'contested-ruling-unquoted', 'contested.state_of_debate', corpus_id, locator FROM con JOIN answer_facts f USING (answer_id) WHERE known AND cited IS NOT NULL AND NOT contains({norm('f.debate')}, {norm('cited')})
UNION ALL SELECT answer_id, 7, 0, 'state-of-debate-without-contest', 'contested.state_of_debate', '', '' FROM answer_facts WHERE NOT is_contested AND NOT ({blank('debate')})
UNION ALL SELECT answer_id, 8, min(slot_order * 1000000 + i * 1000 + j), 'ruling-cited-while-uncontested', 'contested.is_contested', v.corpus_id, v.locator FROM v JOIN r ON r.corpus_id = v.corpus_id AND r.locator = v.locator JOIN answer_facts f USING (answer_id) WHERE v.failure_detail = '' AND NOT f.is_contested GROUP BY answer_id, v.corpus_id, v.locator
UNION ALL SELECT answer_id, 9, 0, 'no-answer-reason-too-long', 'no_answer_reason', '', '' FROM answer_facts WHERE NOT ({blank('reason')}) AND length(reason) > 200
UNION ALL SELECT answer_id, 10, 0, 'no-answer-reason-not-alone', 'no_answer_reason', '', '' FROM answer_facts WHERE NOT ({blank('reason')}) AND (cited_arguments + bare + n_descriptions + n_contrary > 0 OR is_contested)
UNION ALL SELECT answer_id, 10, 0, 'empty-answer', 'no_answer_reason', '', '' FROM answer_facts WHERE ({blank('reason')}) AND cited_arguments + bare + n_descriptions + n_contrary = 0 AND NOT is_contested)"""
_RULED = with_tables("SELECT 1", "placed", "works", "spec", "loci", "answer_facts", **_RESULTS).rpartition("\n")[0] + "," + _RULES


def _failures(x):
    return verify.answer_failures(x.answers, _results(x), x.spec, x.loci)


@query(_RULED + " SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY step, nth) - 1)::int AS ord, code, slot, corpus_id, locator FROM rules")
def answer_rules(x):
    return _failures(x)


@query(_RULED + " SELECT answer_id, corpus_id, locator FROM rules WHERE code = 'ruling-cited-while-uncontested'")
def omission_check(x):
    return _failures(x).filter("code = 'ruling-cited-while-uncontested'").select("answer_id", "corpus_id", "locator")


@query(_RULED + " SELECT code, count(*) AS n FROM rules GROUP BY 1")
def failures_by_code(x):
    return trace.failures_by_code(_failures(x))


@query(with_tables(f"""SELECT answer_id, CASE WHEN is_contested OR NOT ({blank('reason')}) OR n = 0 THEN 'low' WHEN n >= 2 AND attempt = 1 THEN 'high' ELSE 'medium' END AS level,
    concat_ws(', ', CASE n WHEN 0 THEN 'no binding or governing citations' WHEN 1 THEN '1 binding or governing citation' ELSE n || ' binding or governing citations' END, CASE WHEN attempt > 1 THEN 'regenerated' ELSE 'first attempt' END,
        CASE WHEN is_contested THEN 'contested locus ' || locus ELSE 'not contested' END, CASE WHEN NOT ({blank('reason')}) THEN 'no_answer_reason set' END) AS reason, n::int AS authoritative
    FROM (SELECT f.*, (SELECT count(DISTINCT c.corpus_id || '|' || c.locator) FROM cited c JOIN spec s USING (corpus_id) WHERE c.answer_id = f.answer_id AND c.slot = 'arguments' AND s.tier IN ('binding', 'governing')) AS n FROM answer_facts f)""", "answer_facts", "works", "spec"))
def confidence(x):
    return verify.confidence(x.answers, x.spec)


_OUTCOMES = """SELECT request_id, CASE WHEN one = 'passed' THEN 'verified' WHEN two = 'passed' THEN 'regenerated' WHEN two = 'generation-failed' THEN 'generation-failed' WHEN two = 'failed' THEN 'degraded' END AS outcome, CASE WHEN one = 'passed' THEN 1 ELSE 2 END AS attempts, one = 'generation-failed' AS first_generation_failed
    FROM (SELECT request_id, max(status) FILTER (WHERE attempt = 1) AS one, max(status) FILTER (WHERE attempt = 2) AS two FROM attempts GROUP BY 1) WHERE one = 'passed' OR two IS NOT NULL"""


@query(with_tables(_OUTCOMES, "attempts"))
def turn_outcome(x):
    return verify.turn_outcomes(x.attempts)


@query(with_tables("SELECT count(*) AS turns, round(count_if(outcome = 'verified') / count(*), 6) AS verified, round(count_if(outcome = 'regenerated') / count(*), 6) AS regenerated, round(count_if(outcome = 'degraded') / count(*), 6) AS degraded, round(count_if(outcome = 'generation-failed') / count(*), 6) AS generation_failed FROM o", "attempts", o=_OUTCOMES))
def outcome_rates(x):
    return trace.outcome_rates(verify.turn_outcomes(x.attempts))


@query("""SELECT event_id AS request_id, CASE event_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'truncated' WHEN 2 THEN 'not-json' WHEN 3 THEN 'not-an-object' WHEN 4 THEN 'not-json' ELSE NULL END AS code FROM events""")
def completion_failures(x):
    way = F.col("event_id") % 6
    raw = x.read("events").select(F.col("event_id").alias("request_id"), F.when(way == 0, 0).otherwise(1).alias("choices"), F.when(way == 1, "length").otherwise("stop").alias("finish_reason"), F.when(way == 2, F.concat(F.lit("{"), "props")).when(way == 3, F.lit("[1, 2]")).when(way == 4, F.lit("")).otherwise(F.lit('{"position": ""}')).alias("content"))
    return verify.classify_completions(raw)


# --- trace -----------------------------------------------------------------


def _turns(x):
    """One turn of each finished conversation; every 17th request breaks a constraint of each table."""
    o = verify.turn_outcomes(x.attempts)
    bad = F.col("request_id") % 17 == 3
    candidate = F.struct(F.when(bad, " ").otherwise("c-d").alias("corpus_id"), F.lit("L 1").alias("locator"), F.lit(0.5).alias("score"), F.lit(True).alias("included"), F.when(bad, "context budget").otherwise("").alias("exclusion_reason"))
    result = F.struct(F.lit("c-d").alias("corpus_id"), F.lit("L 1").alias("locator"), F.lit(True).alias("locator_resolved"), F.lit(True).alias("quote_matched"), F.lit(True).alias("tier_permitted"), (~bad).alias("license_permitted"), F.lit("").alias("failure_detail"))
    failure = F.struct(F.lit("empty-answer").alias("code"), F.lit("no_answer_reason").alias("slot"), F.when(bad, "c-d").otherwise("").alias("corpus_id"), F.lit("").alias("locator"), F.lit("nothing").alias("detail"))
    broken = F.struct(F.lit("empty").alias("code"), F.lit("no choices").alias("detail"), F.when(bad, -1).otherwise(3).alias("completion_tokens"))
    failed = F.col("outcome") == "generation-failed"
    attempt = lambda n: F.struct(F.lit(n).alias("attempt"), F.lit("q").alias("rewritten_query"), F.lit("m1").alias("embedding_model"), F.when(bad, 0).otherwise(64).alias("dim"), F.lit("g").alias("generation_model"), F.lit(20).alias("top_k"), F.lit(1).cast("long").alias("embed_ms"), F.lit(2).cast("long").alias("search_ms"), F.lit(3).cast("long").alias("generate_ms"), F.lit(4).cast("long").alias("verify_us"), F.array(candidate, candidate).alias("candidates"), F.array(result).alias("results"), F.array(failure).alias("failures"), F.when(failed, broken).alias("failure"))
    attempts = F.when(F.col("attempts") == 1, F.array(attempt(1))).otherwise(F.array(attempt(1), attempt(2)))
    return o.select("request_id", F.lit("p").alias("profile"), F.when(bad, "").otherwise("why").alias("query"), F.col("outcome").alias("overall_result"), F.when(~failed, "{}").alias("answer"), F.when(~failed, "low").alias("confidence_level"), F.lit("a, b").alias("confidence_reason"), F.lit("v1").alias("gateway_version"), attempts.alias("attempts"))


@query(with_tables("""SELECT 'responses' AS "table", count(*) AS n FROM o UNION ALL SELECT 'traces', sum(attempts) FROM o UNION ALL SELECT 'candidates', 2 * sum(attempts) FROM o UNION ALL SELECT 'verification_results', sum(attempts) FROM o UNION ALL SELECT 'answer_failures', sum(attempts) FROM o
    UNION ALL SELECT 'generation_failures', coalesce(sum(attempts) FILTER (WHERE outcome = 'generation-failed'), 0) FROM o""", "attempts", o=_OUTCOMES))
def trace_tables(x):
    out = None
    for name, rows in trace.trace_tables(_turns(x)).items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(with_tables("""SELECT "table", "constraint", request_id FROM (SELECT * FROM o WHERE request_id % 17 = 3) o, (VALUES ('responses', 'responses_query_check', 0, false), ('traces', 'traces_dim_check', 1, false), ('candidates', 'candidates_corpus_id_check', 2, false), ('candidates', 'candidates_reason_iff_excluded', 2, false),
    ('verification_results', 'verification_results_detail_iff_failure', 1, false), ('answer_failures', 'answer_failures_ref_is_whole_or_absent', 1, false), ('generation_failures', 'generation_failures_completion_tokens_check', 1, true)) c("table", "constraint", per, failed),
    range(1, 5) k(i) WHERE i <= CASE WHEN per = 0 THEN 1 ELSE per * attempts END AND (NOT failed OR outcome = 'generation-failed')""", "attempts", o=_OUTCOMES))
def constraint_violations(x):
    return trace.violations(trace.trace_tables(_turns(x)))


@query(with_tables("SELECT 'candidates' AS \"table\", coalesce(2 * sum(attempts), 0)::bigint AS n FROM o WHERE request_id % 5 = 0 UNION ALL SELECT 'traces', coalesce(sum(attempts), 0)::bigint FROM o WHERE request_id % 5 = 0", "attempts", o=_OUTCOMES))
def orphans(x):
    tables = trace.trace_tables(_turns(x))
    return trace.orphans({k: tables[k] for k in ("candidates", "traces")}, tables["responses"].filter("request_id % 5 <> 0"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS samples, max(value) FILTER (WHERE r = n * 50 // 100) AS p50, max(value) FILTER (WHERE r = n * 95 // 100) AS p95 FROM o GROUP BY 1""")
def latency_p95(x):
    return trace.nearest_rank(x.read("events"), "event_type", "value")


_PROFILE = {
    "profile": "", "scripture": {"corpus_id": "src0-en-invented", "stance": "contrary"},
    "corpora": [{"id": "src1-en-invented", "stance": "binding"}, {"id": "src1-en-invented", "stance": "binding"}, {"id": "src2-en-invented", "stance": "odd"}, {"id": "src3-en-invented", "stance": "contrary"}, {"id": "zz-none", "stance": "advisory"}],
    "contested": [{"locus": "a", "ruling_source": {"corpus_id": "src1-en-invented", "locator": "DOC 1"}}, {"locus": "a", "ruling_source": {"corpus_id": "elsewhere-x", "locator": ""}}],
}


@query("SELECT * FROM (VALUES ('name-required', ''), ('scripture-stance', 'contrary'), ('corpus-twice', 'src1-en-invented'), ('unknown-stance', 'src2-en-invented'), ('label-required', 'src3-en-invented'), ('locator-required', 'a'), ('locus-twice', 'a'), ('ruling-out-of-scope', 'a'), ('not-ingested', 'zz-none')) v(rule, subject)")
def profile_violations(x):
    named = [c["id"] for c in _PROFILE["corpora"]] + [_PROFILE["scripture"]["corpus_id"]]
    known = {r[0] for r in x.works.filter(F.col("corpus_id").isin(named)).select("corpus_id").collect()}
    return x.spark.createDataFrame(trace.profile_violations(_PROFILE, known), "rule string, subject string")


@query(with_tables("""SELECT f.answer_id, CASE WHEN f.answer_id % 10 = 3 THEN 1 WHEN f.answer_id % 10 = 4 THEN 4 WHEN reason <> '' THEN 5
    ELSE CASE WHEN position <> '' THEN 3 ELSE 0 END + CASE WHEN cited_arguments + bare > 0 THEN 2 + 2 * (cited_arguments + bare) ELSE 0 END + CASE WHEN n_descriptions > 0 THEN 2 + 2 * n_descriptions ELSE 0 END + CASE WHEN n_contrary > 0 THEN 2 + 2 * n_contrary ELSE 0 END
        + CASE WHEN is_contested THEN 2 + (debate <> '')::int ELSE 0 END + 2 + (SELECT count(*) * 2 + count(w.corpus_id) FROM cited c LEFT JOIN works w ON w.corpus_id = c.corpus_id WHERE c.answer_id = f.answer_id AND (c.slot <> 'contested' OR f.is_contested)) END AS lines,
    coalesce(CASE WHEN f.answer_id % 10 NOT IN (3, 4) AND reason = '' THEN (SELECT string_agg('     [' || coalesce(s.tier, 'unspecified') || '] ' || p.corpus_id || ' ' || p.locator || coalesce(chr(10) || '       ' || w.work || ' (first)', '') || chr(10) || '       "' || trim(p.quote, ' ') || '"', chr(10) ORDER BY slot_order, place)
        FROM placed p LEFT JOIN works w ON w.corpus_id = p.corpus_id LEFT JOIN spec s ON s.corpus_id = p.corpus_id WHERE p.answer_id = f.answer_id AND (p.slot <> 'contested' OR f.is_contested)) END, '') AS cited FROM answer_facts f""", "answer_facts", "works", "spec", "placed"))
def render_answer(x):
    """Lines of each answer, and those that show its citations; every tenth turn is a failed generation, every tenth degraded."""
    i = F.col("answer_id") % 10
    turns = x.answers.select("answer_id", "answer", F.when(i == 3, "generation-failed").when(i == 4, "degraded").otherwise("verified").alias("outcome"))
    sources = x.works.join(x.spec.select("corpus_id", "tier"), "corpus_id", "left").select("corpus_id", "tier", "work", "edition", F.lit("").alias("label"))
    shown = F.col("line").rlike(r'^     (\[|  )') & ~F.col("line").rlike("^     [wt]$")
    lines = F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("line_no", "line")))), lambda r: r["line"])
    return render.render_answers(turns, sources, "answer_id").groupBy("answer_id").agg(F.count(F.lit(1)).alias("lines"), F.array_join(lines, "\n").alias("cited"))


# --- segmentation and pages -----------------------------------------------------------------

_LINES = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"


@query(f"""WITH l AS ({_LINES.replace('text', "replace(text, '. ', '.' || chr(10) || chr(10))")})
SELECT doc_id, p AS paragraph, string_agg(line, ' ' ORDER BY line_no) AS text FROM (SELECT *, sum(CASE WHEN NOT b AND coalesce(pb, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)::bigint AS p
    FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS pb FROM (SELECT *, regexp_full_match(line, '\\s*') AS b FROM l))) WHERE NOT b GROUP BY 1, 2""")
def paragraphs(x):
    return segment.paragraphs(x.read("documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n"))))


@query("SELECT src, n AS found, expected FROM (SELECT source || lang AS src, doc_id AS n, coalesce(lag(doc_id) OVER (PARTITION BY source || lang ORDER BY doc_id) + 1, 1) AS expected FROM documents) WHERE n <> expected")
def contiguity(x):
    return segment.contiguity(x.read("documents").select(F.concat("source", "lang").alias("src"), F.col("doc_id").alias("n")), "src", "n")


@query("""WITH RECURSIVE n AS (SELECT conv_id, list(turn % 4 ORDER BY turn) AS a FROM conversations GROUP BY 1), f AS (SELECT conv_id, a, 1 AS i, 0::bigint AS s FROM n UNION ALL SELECT conv_id, a, i + 1, CASE WHEN a[i] = s + 1 THEN s + 1 ELSE s END FROM f WHERE i <= len(a))
SELECT conv_id, s::int AS run FROM f WHERE i = len(a) + 1""")
def ascending_run(x):
    rows = x.read("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") % 4).cast("int").alias("v")))), lambda r: r["v"]).alias("a"))
    return rows.select("conv_id", segment.ascending_run(F.col("a")).alias("run"))


_STRUCTURE = "CASE WHEN line_no % 7 = 0 THEN 'CHAPTER ' || (line_no // 7 + 1) WHEN line_no % 7 IN (1, 4) THEN CASE WHEN line_no % 7 = 1 THEN '1' ELSE '2' END || '. x' || line ELSE 'y' || line END"


@query(f"""WITH l AS ({_LINES}) SELECT doc_id, 'WCF ' || (line_no // 7 + 1) || '.' || CASE WHEN line_no % 7 <= 3 THEN 1 ELSE 2 END AS locator, string_agg(CASE WHEN line_no % 7 IN (1, 4) THEN 'x' ELSE 'y' END || line, chr(10) ORDER BY line_no) AS text FROM l WHERE line_no % 7 <> 0 GROUP BY 1, 2""")
def segment_sections(x):
    rows = segment.lines(x.read("documents")).withColumn("line", F.expr(_STRUCTURE.replace("||", "||").replace("line_no // 7", "cast(floor(line_no / 7) AS int)")))
    made = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return segment.segment_sections(made)


_FAULTY = """CASE WHEN line_no < 7 AND line_no % 7 = 0 AND doc_id % 5 = 0 OR line_no % 7 = 1 AND doc_id % 4 = 3 THEN 'y' || line WHEN line_no % 7 = 0 THEN 'CHAPTER ' || (part + 1 + CASE WHEN part >= 2 AND doc_id % 3 = 1 THEN 1 ELSE 0 END)
    WHEN line_no % 7 = 1 THEN '1. x' || line WHEN line_no % 7 = 4 THEN (2 + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END) || '. x' || line ELSE 'y' || line END"""


@query(f"""WITH l AS ({_LINES}), n AS (SELECT doc_id, line_no, line_no // 7 AS part, line_no % 7 AS r, doc_id % 5 = 0 AS headless, doc_id % 4 = 3 AS bare FROM l),
p AS (SELECT *, headless AND part = 0 AS lost, part + 1 + (part >= 2 AND doc_id % 3 = 1)::int AS chapter, part + (part - 1 >= 2 AND doc_id % 3 = 1)::int AS before, 2 + (doc_id % 3 = 2)::int AS second FROM n)
SELECT doc_id, line_no::int AS line_no, problem FROM (SELECT doc_id, line_no, CASE
    WHEN r = 0 AND NOT lost THEN CASE WHEN chapter <> CASE WHEN part = 0 OR part = 1 AND headless THEN 1 ELSE before + 1 END THEN 'chapter ' || chapter || ' where ' || CASE WHEN part = 0 OR part = 1 AND headless THEN 1 ELSE before + 1 END || ' was expected' END
    WHEN lost AND (r = 4 OR r = 1 AND NOT bare) THEN 'a section before any chapter' WHEN lost THEN 'text before any chapter'
    WHEN r = 4 THEN CASE WHEN second <> CASE WHEN bare THEN 1 ELSE 2 END THEN 'chapter ' || chapter || ' section ' || second || ' where ' || CASE WHEN bare THEN 1 ELSE 2 END || ' was expected' END
    WHEN bare AND r IN (1, 2, 3) THEN 'text outside a section' END AS problem FROM p) WHERE problem IS NOT NULL""")
def segment_problems(x):
    rows = segment.lines(x.read("documents")).withColumn("part", F.floor(F.col("line_no") / 7).cast("int"))
    return refusals.section_problems(_made(rows.withColumn("line", F.expr(_FAULTY))))


@query(f"""WITH l AS ({_LINES}), p AS (SELECT doc_id, line_no, line FROM l)
SELECT doc_id, line_no::int AS line_no, 'text before any section heading' AS problem FROM p WHERE line_no < doc_id % 3 UNION ALL
SELECT doc_id, m + d, CASE d WHEN 1 THEN 'recommendation 3 where 2 was expected' ELSE 'recommendation 2 where 4 was expected' END FROM (SELECT doc_id, count(*)::int + 2 AS m FROM p GROUP BY 1), (VALUES (1), (2)) v(d) WHERE doc_id % 2 = 1 UNION ALL
SELECT doc_id, NULL, '3 recommendations, 2 were expected' FROM p WHERE doc_id % 2 = 1 GROUP BY doc_id""")
def report_problems(x):
    rows = segment.lines(x.read("documents"))
    made = _made(rows.withColumn("line", F.when(F.col("line_no") == F.col("doc_id") % 3, "# I. Part").otherwise(F.concat(F.lit("z"), "line"))))
    end = F.when(F.col("doc_id") % 2 == 1, "\n# RECOMMENDATIONS\nWe ask:\n1. Do so.\n3. Or not.\n2. Or else.").otherwise("\n# RECOMMENDATIONS\nWe ask:\n1. Do so.\n2. Or not.")
    return refusals.report_problems(made.withColumn("text", F.concat("text", end)), 2)


@query(f"""WITH l AS ({_LINES}) SELECT doc_id, 'WSC Q&A ' || (line_no // 3 + 1) AS locator, string_agg('x' || line, chr(10) ORDER BY line_no) AS text FROM l WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1, 2""")
def segment_questions(x):
    mark = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("Q. "), (F.floor(F.col("line_no") / 3) + 1).cast("string"), F.lit(". x"), "line")).when(F.col("line_no") % 3 == 1, F.concat(F.lit("A. x"), "line")).otherwise(F.concat(F.lit("x"), "line"))
    rows = segment.lines(x.read("documents")).withColumn("line", mark)
    made = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return segment.segment_questions(made)


@query(f"""WITH l AS ({_LINES}) SELECT doc_id, 'BOOK ' || (line_no // 5 + 1) || ':' || (line_no % 5 + 1) AS locator, trim(line, ' ') AS text FROM l WHERE trim(line, ' ') <> ''""")
def segment_verses(x):
    made = segment.lines(x.read("documents")).select("doc_id", F.concat(F.lit("BOOK "), (F.floor(F.col("line_no") / 5) + 1).cast("string"), F.lit(":"), (F.col("line_no") % 5 + 1).cast("string"), F.lit(" "), "line").alias("text"))
    return segment.segment_verses(made)


@query(f"""WITH l AS ({_LINES}) SELECT doc_id, 'BCO ' || (line_no // 6 + 1) || '-' || ((line_no % 6 - 1) // 2 + 1) AS locator, string_agg('z' || line, ' ' ORDER BY line_no) AS text FROM l WHERE line_no % 6 <> 0 GROUP BY 1, 2""")
def segment_paragraphs(x):
    n, c = F.col("line_no") % 6, (F.floor(F.col("line_no") / 6) + 1).cast("string")
    line = F.when(n == 0, F.concat(F.lit("CHAPTER "), c)).when(n % 2 == 1, F.concat(c, F.lit("-"), (F.floor((n - 1) / 2) + 1).cast("string"), F.lit(". z"), "line")).otherwise(F.concat(F.lit("z"), "line"))
    rows = segment.lines(x.read("documents")).withColumn("line", line)
    made = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return segment.segment_paragraphs(made)


@query("""SELECT conv_id, turn, max(CASE WHEN turn % 4 = 0 THEN turn END) OVER w AS chapter_at, CASE WHEN turn % 4 = 0 THEN NULL ELSE max(CASE WHEN turn % 4 = 1 THEN turn END) OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) END AS section_at FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def section_path(x):
    rows = x.read("conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.col("turn")).alias("chapter"), F.when(F.col("turn") % 4 == 1, F.col("turn")).alias("section"))
    return segment.section_path(rows, "conv_id", "turn").select("conv_id", "turn", "chapter_at", "section_at")


@query("""SELECT conv_id, role, count(*) AS runs FROM (SELECT conv_id, role, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE role IS DISTINCT FROM b GROUP BY 1, 2 HAVING count(*) > 1""")
def split_runs(x):
    return segment.split_runs(x.read("conversations"), "conv_id", "turn", "role")


@query(r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"', 1) AS a FROM pages), u AS (SELECT page_id, unnest(a) AS link, generate_subscripts(a, 1) AS i FROM m)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1)::int AS pos, link FROM u GROUP BY page_id, link""")
def page_links(x):
    return files.page_links(x.read("pages"))


def _made(rows):
    """Documents of changed lines (doc_id, line_no, line)."""
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n").alias("text"))


#: Chapters of seven lines, numbered anew after 300; every twelfth has no section numbers, all have a navigation line.
_ROMAN_PLACE = "SELECT doc_id, line, line_no, line_no % 7 AS r, (line_no // 7) % 300 + 1 AS c FROM l"


@query(f"""WITH l AS ({_LINES}), p AS ({_ROMAN_PLACE}) SELECT doc_id, 'WCF ' || c || '.' || CASE WHEN r <= 2 OR c % 12 = 0 THEN 1 ELSE 2 END AS locator, string_agg(CASE WHEN r IN (1, 4) AND c % 12 <> 0 THEN 'x' ELSE 'y' END || line, chr(10) ORDER BY line_no) AS text FROM p WHERE r NOT IN (0, 3) GROUP BY 1, 2""")
def segment_roman_sections(x):
    rows = segment.lines(x.read("documents")).withColumns({"r": F.col("line_no") % 7, "c": (F.floor(F.col("line_no") / 7) % 300 + 1).cast("int")})
    line = F.when(F.col("r") == 0, F.concat(F.lit("Chapter "), _numeral(F.col("c")))).when(F.col("r") == 3, "Previous | Next | Contents")
    line = line.when(F.col("r").isin(1, 4) & (F.col("c") % 12 != 0), F.concat(F.when(F.col("r") == 1, "I").otherwise("II"), F.lit(". x"), "line")).otherwise(F.concat(F.lit("y"), "line"))
    return segment.segment_roman_sections(_made(rows.select("doc_id", "line_no", line.alias("line"))))


@query(f"""WITH l AS ({_LINES}) SELECT doc_id, 'Inst. 1.1.' || (line_no + 1) || '.p1' AS locator, 'x' || trim(regexp_replace(line, '\\s+$', '')) AS text FROM l UNION ALL SELECT doc_id, 'Inst. Pref.1.p' || i, ['one of ' || doc_id, 'two'][i] FROM documents, range(1, 3) r(i)""")
def segment_books(x):
    """A dedication, and one chapter of each document, its sections listed by number before they are set out."""
    number = (F.col("line_no") + 1).cast("string")
    rows = segment.lines(x.read("documents")).select("doc_id", "line_no", F.concat(F.lit("   "), number, F.lit(". x"), "line").alias("line"), F.concat(F.lit("   "), number, F.lit(". title")).alias("title"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c))), lambda r: r[c]), "\n")
    front = F.concat(F.lit("   1. one of "), F.col("doc_id").cast("string"), F.lit("\n\ntwo\nINSTITUTES\nBOOK FIRST\nCHAPTER 1\nARGUMENT.\n"))
    return segment.segment_books(rows.groupBy("doc_id").agg(F.concat(front, joined("title"), F.lit("\n\n"), joined("line")).alias("text")))


#: Parts of nine lines, numbered anew after 12; recommendations close the document.
_HEADED = """SELECT doc_id, (line_no // 9) % 12 + 1 AS c, line_no // 9 AS part, line_no % 9 AS r, line, line_no FROM l"""
_ROMANS = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII']"


@query(f"""WITH l AS ({_LINES}), p AS ({_HEADED}) SELECT doc_id, 'GA28 ' || {_ROMANS}[c] || CASE r WHEN 2 THEN '.1' WHEN 4 THEN '.A.1' WHEN 6 THEN '.A.1.1' ELSE '.A.1.2' END AS locator, 'z' || trim(line) AS text FROM p WHERE r IN (2, 4, 6, 8)
UNION ALL SELECT doc_id, 'GA28 Rec.1', 'Do so.' FROM documents UNION ALL SELECT doc_id, 'GA28 Rec.2', 'Or not.' FROM documents""")
def segment_headed(x):
    r = F.col("line_no") % 9
    roman = F.element_at(F.array(*map(F.lit, "I II III IV V VI VII VIII IX X XI XII".split())), (F.floor(F.col("line_no") / 9) % 12 + 1).cast("int"))
    line = F.when(r == 0, F.concat(F.lit("# "), roman, F.lit(". Part"))).when(r == 3, "# A. Sub").when(r == 5, "# 1. Third").when(r == 7, "# Conclusion").when(r == 1, "").otherwise(F.concat(F.lit("z"), F.trim("line")))
    made = _made(segment.lines(x.read("documents")).select("doc_id", "line_no", line.alias("line")))
    return segment.segment_headed(made.withColumn("text", F.concat("text", F.lit("\n# RECOMMENDATIONS\nWe recommend:\n1. Do so.\n2. Or not."))))


@query("""WITH c AS (SELECT conv_id, turn, ['A', 'B', 'C'][(turn * (conv_id % 3 + 1)) % 3 + 1] AS code FROM conversations), f AS (SELECT conv_id, list(code ORDER BY first) AS found FROM (SELECT conv_id, code, min(turn) AS first FROM c GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT conv_id, found, i - 1 AS p FROM f, range(1, 4) r(i) WHERE found[i] IS DISTINCT FROM ['A', 'B', 'C'][i])
SELECT conv_id, found[min(p) + 1] AS code, min(p)::int AS place, ['A', 'B', 'C'][min(p) + 1] AS expected FROM i GROUP BY conv_id, found""")
def canonical_order(x):
    code = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("turn") * (F.col("conv_id") % 3 + 1) % 3 + 1).cast("int"))
    return segment.out_of_order(x.read("conversations").select("conv_id", "turn", code.alias("code")), "conv_id", "turn", "code", ["A", "B", "C"])


@query("SELECT conv_id AS doc_id, string_agg('line ' || turn, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn > 0 AND turn % 3 <> 2 GROUP BY 1")
def page_lines(x):
    """Each turn is a page: a running head, its line, and on every third page a divider before it."""
    line = F.concat(F.lit("RUNNING HEAD\n"), F.when(F.col("turn") % 3 == 2, F.concat(F.lit("DIVIDER\nnot this "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("CHAPTER\nline "), F.col("turn").cast("string"))))
    pages = x.read("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(F.col("turn") == 0, "front\nPART I").otherwise(line).alias("text"))
    return segment.page_lines(pages, "^PART I$", "^APPENDIX", "^RUNNING HEAD$|^CHAPTER$", "^DIVIDER$", "^CHAPTER$")


_ARTICLE = r"regexp_extract(html, '<article>(.*)</article>', 1, 's')"
_BROKEN = rf"regexp_replace(regexp_replace({_ARTICLE}, '\s+', ' ', 'g'), '</?(p|br|h1)[^>]*>', chr(10), 'g')"


@query(rf"""WITH b AS (SELECT page_id, replace(regexp_replace(regexp_replace({_BROKEN}, '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'), '&quot;', '"') AS body FROM pages)
SELECT page_id, coalesce(list_aggregate(list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), 'string_agg', chr(10)), '') AS text FROM b""")
def html_extract(x):
    return html.html_extract(x.read("pages"))


@query(r"SELECT doc_id, regexp_replace(text, '\[\d+\]', '', 'g') AS text FROM documents")
def text_region(x):
    made = x.read("documents").select("doc_id", F.concat(F.lit("front\nSTART\n"), "text", F.lit("[1]\nEND\nback")).alias("text"))
    return segment.text_region(made, "START", "END")
