"""The jobs as queries, and SQL written on its own."""

from foliospark.plans.fixtures import norm
from jobs import job1_ingest, job2_embedding_orders

QUERIES = {job1_ingest.NAME: job1_ingest.query, job2_embedding_orders.NAME: job2_embedding_orders.query}

_WORDS = "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END"

ORACLE_SQL = {
    job1_ingest.NAME: f"""WITH c AS (SELECT lower(source) || '-' || lower(lang) || '-invented' AS corpus_id, 'DOC ' || doc_id AS locator, {norm('text')} AS text FROM documents),
w AS (SELECT *, sha256(text) AS content_hash, {_WORDS} AS words FROM c WHERE locator IS NOT NULL AND regexp_full_match(corpus_id, '[a-z0-9]+(-[a-z0-9]+)+') AND text <> '')
SELECT corpus_id, locator, content_hash, 1 AS normalisation_version, words::int AS words, length(text)::int AS chars FROM w WHERE words <= 100000
QUALIFY row_number() OVER (PARTITION BY corpus_id, locator ORDER BY content_hash DESC) = 1""",
    job2_embedding_orders.NAME: f"""WITH RECURSIVE c AS (SELECT doc_id AS id, source || '-' || lang || '-invented' AS corpus_id, {norm("coalesce(text, '')")} AS text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
o AS (SELECT id, corpus_id, words, row_number() OVER (PARTITION BY corpus_id ORDER BY words, id) AS r FROM (SELECT id, corpus_id, {_WORDS} AS words FROM c)),
f AS (SELECT id, corpus_id, words, r, 0::bigint AS batch, 1::bigint AS fill FROM o WHERE r = 1 UNION ALL
    SELECT o.id, o.corpus_id, o.words, o.r, CASE WHEN (f.fill + 1) * o.words > 4096 THEN f.batch + 1 ELSE f.batch END, CASE WHEN (f.fill + 1) * o.words > 4096 THEN 1 ELSE f.fill + 1 END FROM f JOIN o ON o.corpus_id = f.corpus_id AND o.r = f.r + 1)
SELECT id, corpus_id, words::bigint AS words, batch FROM f""",
}
