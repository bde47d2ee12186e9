"""The engine's tables, derived from the generic test tables, as DataFrames and as SQL.

The SQL is written on its own for an independent check: it shares no code with the DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schema as s
from foliospark.functions import text as t
from foliospark.storage import written

MODEL, OTHER_MODEL = "m1", "m0"
TOP_K = 20
FABRICATED = "src0-en-invented"


class Fixtures:
    """Lazily built tables over ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _corpus_id():
        return F.concat_ws("-", "source", "lang", F.lit("invented"))

    @property
    def works(self) -> DataFrame:
        rows = self.read("documents").select("source", "lang").distinct().withColumn("n", F.expr("cast(substr(source, 4) AS int)"))
        licence = F.element_at(F.array(*map(F.lit, s.LICENSES)), F.col("n") % 5 + 1)
        return rows.select(
            self._corpus_id().alias("corpus_id"), F.concat(F.lit("Work "), "source", F.lit(" "), "lang").alias("work"), F.when(F.col("n") % 2 == 1, F.concat(F.lit("Author "), "source")).alias("author"),
            F.lit("modern").alias("era"), F.col("lang").alias("language"), F.col("lang").alias("source_language"), F.lit("not-applicable").alias("text_form"), F.lit("first").alias("edition"),
            licence.alias("license"), F.lit("invented").alias("attribution"), "n",
        )

    @property
    def chunks(self) -> DataFrame:
        rows = self.read("documents").select(F.col("doc_id").alias("id"), self._corpus_id().alias("corpus_id"), F.concat(F.lit("DOC "), F.col("doc_id").cast("string")).alias("locator"), t.normalise(F.col("text")).alias("text"))
        return rows.withColumns({"content_hash": t.fingerprint(F.col("text")), "normalisation_version": F.when(F.col("id") % 50 == 0, 2).otherwise(1)})

    @property
    def raw_chunks(self) -> DataFrame:
        """Chunks with texts as they came, for operators that normalise what they read, or for which NFC makes no difference."""
        rows = self.read("documents").select(F.col("doc_id").alias("id"), self._corpus_id().alias("corpus_id"), F.concat(F.lit("DOC "), F.col("doc_id").cast("string")).alias("locator"), t.without_format_characters(F.col("text")).alias("text"))
        return rows.withColumn("normalisation_version", F.when(F.col("id") % 50 == 0, 2).otherwise(1))

    @property
    def narrow_chunks(self) -> DataFrame:
        """Chunks without anything that texts are read for."""
        return self.read("documents").select(F.col("doc_id").alias("id"), self._corpus_id().alias("corpus_id"), F.concat(F.lit("DOC "), F.col("doc_id").cast("string")).alias("locator"))

    @property
    def embeddings(self) -> DataFrame:
        rows = self.read("embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(MODEL).alias("embedding_model"), F.lit(64).alias("dim"), "embedding", "label")
        return rows.join(self.read("documents").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")

    @property
    def spec(self) -> DataFrame:
        tier = F.element_at(F.array(*map(F.lit, s.TIERS)), F.col("n") % 6 + 1)
        return self.works.filter("n % 6 <> 5").select("corpus_id", tier.alias("tier"), F.col("n").alias("position"))

    @property
    def queries(self) -> DataFrame:
        """The stated query vectors: of every id that 100 divides."""
        return self.read("embeddings").filter("vec_id % 100 = 0").select("vec_id", "embedding")

    @property
    def loci(self) -> DataFrame:
        rows = self.narrow_chunks.filter("id IN (12, 14)").select(F.when(F.col("id") == 12, "locus-a").otherwise("locus-b").alias("locus"), "corpus_id", "locator")
        none = self.spark.range(1).select(F.lit("locus-c").alias("locus"), F.lit(FABRICATED).alias("corpus_id"), F.lit("DOC -1").alias("locator"))  # no Python worker makes it
        return rows.unionByName(none)

    @property
    def staged(self) -> DataFrame:
        return self.chunks.filter("id % 10 <> 2")

    @property
    def existing(self) -> DataFrame:
        rows = self.chunks.filter("id % 10 <> 1")
        return rows.withColumn("content_hash", F.when(F.col("id") % 7 == 0, t.fingerprint(F.concat(F.lit("old "), "text"))).otherwise(F.col("content_hash")))

    def hashed(self) -> tuple[DataFrame, DataFrame]:
        """``staged`` and ``existing`` without texts: every text is normalised and hashed once, and the hashes are written down."""
        older = F.when(F.col("id") % 7 == 0, t.fingerprint(F.concat(F.lit("old "), "text")))
        rows = written(self.chunks.withColumn("older", older).drop("text"), "hashed")
        existing = rows.filter("id % 10 <> 1").withColumn("content_hash", F.coalesce("older", "content_hash"))
        return rows.filter("id % 10 <> 2").drop("older"), existing.drop("older")

    @staticmethod
    def prints(chunks: DataFrame) -> DataFrame:
        return chunks.select("corpus_id", "locator", F.col("content_hash").alias("sha256"))

    @property
    def quotes(self) -> DataFrame:
        return self.read("benchmark").select("item_id", t.normalise(F.col("text")).alias("text"))

    @property
    def manifests(self) -> DataFrame:
        """corpus_id, diagnostic, expected_sha256, upstream_sha256: each blessed corpus's first record, as it was read."""
        first = self.existing.groupBy("corpus_id").agg(F.min_by(F.struct("locator", "content_hash"), "id").alias("d"))
        return first.select("corpus_id", F.col("d.locator").alias("diagnostic"), F.col("d.content_hash").alias("expected_sha256"), F.sha2(F.col("corpus_id").cast("binary"), 256).alias("upstream_sha256"))

    @property
    def fetched(self) -> DataFrame:
        now = F.concat("corpus_id", F.when(F.col("corpus_id").startswith("src2"), "!").otherwise(""))
        return self.works.select("corpus_id", F.sha2(now.cast("binary"), 256).alias("upstream_sha256"))

    @property
    def citations(self) -> DataFrame:
        """One citation of each benchmark item: the first document that holds it, or none."""
        from foliospark.operators.quotes import quote_contains

        items = self.quotes
        texts = written(self.chunks.select("id", "text"), "texts")  # they are read twice, and normalised once
        held = quote_contains(texts, items).groupBy("quote_id").agg(F.min("id").alias("id"))
        rows = items.join(held, items["item_id"] == held["quote_id"], "left").join(self.narrow_chunks, "id", "left")
        quote = F.when(F.col("item_id") % 10 == 9, F.substring("text", 1, 20)).when(F.col("item_id") % 10 == 8, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
        return rows.select(
            "item_id", F.coalesce("corpus_id", F.lit(FABRICATED)).alias("corpus_id"), F.coalesce("locator", F.concat(F.lit("DOC -"), F.col("item_id").cast("string"))).alias("locator"),
            F.when(F.col("item_id") % 2 == 0, "arguments").otherwise("descriptions").alias("slot"), quote.alias("quote"),
        )

    @property
    def cited(self) -> DataFrame:
        """Flat citations of invented answers, one of each assistant turn: answer_id, turn, slot, corpus_id, locator, quote."""
        turns = self.read("conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("answer_id"), F.col("turn").cast("int").alias("turn")).distinct()
        doc = F.when(F.col("answer_id") % 6 == 1, 12).otherwise(F.col("answer_id") * 13 + F.col("turn") * 7)
        rows = turns.withColumn("cite", doc)
        chunks = self.raw_chunks.select(F.col("id").alias("cite"), "corpus_id", "locator", "text")
        rows = rows.join(chunks, "cite", "left").withColumn("text", t.normalise(F.col("text")))  # of what is cited only
        way = (F.col("answer_id") + F.col("turn")) % 9
        body = F.coalesce("text", F.lit("nothing like it was ever written in any of the documents"))
        quote = F.when(way == 0, F.substring(body, 1, 20)).when(way == 1, F.concat(F.substring(body, 1, 59), F.lit("§"))).otherwise(F.substring(body, 1, 60))
        slot = F.element_at(F.array(*map(F.lit, ("arguments", "arguments", "descriptions", "contrary_positions", "contested"))), ((F.col("turn") + F.col("answer_id")) % 5 + 1).cast("int"))
        return rows.select("answer_id", "turn", slot.alias("slot"), F.coalesce("corpus_id", F.lit(FABRICATED)).alias("corpus_id"), F.coalesce("locator", F.concat(F.lit("DOC -"), F.col("cite").cast("string"))).alias("locator"), quote.alias("quote"))

    @property
    def answers(self) -> DataFrame:
        """answer_id, attempt, answer: the nested answers that ``cited`` is the flat form of."""
        c = F.struct("turn", F.struct("corpus_id", "locator", F.lit("binding").alias("tier"), "quote").alias("c"))
        of = lambda slot: F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == slot, c))), lambda x: x["c"])
        rows = self.cited.groupBy("answer_id").agg(*[of(x).alias(x) for x in ("arguments", "descriptions", "contrary_positions", "contested")])
        i = F.col("answer_id")
        none = F.array().cast(f"array<{s.CITATION.simpleString()}>")
        arguments = F.transform("arguments", lambda x: F.struct(F.lit("c").alias("claim"), F.lit("w").alias("warrant"), F.array(x).alias("citations")))
        bare = F.array(F.struct(F.lit("c").alias("claim"), F.lit("w").alias("warrant"), none.alias("citations")))
        contested = i % 5 == 1
        debate = F.when(i % 4 == 1, F.concat(F.lit("They say: "), F.array_join(F.transform("contested", lambda x: x["quote"]), " | "))).when(i % 7 == 3, "debated").otherwise("")
        answer = F.struct(
            F.when(i % 3 == 0, "a position").otherwise("").alias("position"), F.concat(arguments, F.when(i % 8 == 5, bare).otherwise(F.array().cast(s.ANSWER["arguments"].dataType.simpleString()))).alias("arguments"),
            F.transform("descriptions", lambda x: F.struct(F.lit("s").alias("subject"), F.lit("t").alias("content"), F.array(x).alias("citations"))).alias("descriptions"),
            F.transform("contrary_positions", lambda x: F.struct(F.lit("p").alias("position"), F.array(F.lit("others")).alias("held_by"), F.array(x).alias("citations"))).alias("contrary_positions"),
            F.struct(contested.alias("is_contested"), F.when(contested, F.when(i % 2 == 0, "locus-x").otherwise("locus-a")).otherwise("").alias("locus"), F.col("contested").alias("citations"), debate.alias("state_of_debate")).alias("contested"),
            F.when(i % 22 == 2, F.repeat(F.lit("r"), 201)).when(i % 11 == 2, "silent").otherwise("").alias("no_answer_reason"), F.lit(None).cast("struct<level:string,reason:string>").alias("confidence"),
        )
        return rows.select("answer_id", (i % 2 + 1).cast("int").alias("attempt"), answer.cast(s.ANSWER.simpleString()).alias("answer"))

    @property
    def attempts(self) -> DataFrame:
        """request_id, attempt, status: the first two assistant turns of each conversation."""
        from pyspark.sql import Window

        rows = self.read("conversations").filter("role = 'assistant'").withColumn("attempt", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("attempt <= 2")
        code = (F.col("conv_id") * 7 + F.col("turn") * F.col("turn")) % 5
        return rows.select(F.col("conv_id").alias("request_id"), "attempt", F.when(code == 0, "generation-failed").when(code <= 2, "failed").otherwise("passed").alias("status"))


_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize(regexp_replace({x}, '[\x{{FEFF}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{AD}}]', '', 'g')), '{_SPACE}+', ' ', 'g'), ' ')"


def blank(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') = ''"


#: Named queries that other SQL is built on.
SQL = {
    "works": """SELECT DISTINCT source || '-' || lang || '-invented' AS corpus_id, 'Work ' || source || ' ' || lang AS work, CASE WHEN cast(substr(source, 4) AS int) % 2 = 1 THEN 'Author ' || source END AS author,
        lang AS language, 'not-applicable' AS text_form, (['public-domain', 'cc-by', 'cc-by-sa', 'local-only', 'refused'])[cast(substr(source, 4) AS int) % 5 + 1] AS license, cast(substr(source, 4) AS int) AS n FROM documents""",
    "chunks": f"""SELECT *, sha256(text) AS content_hash, CASE WHEN id % 50 = 0 THEN 2 ELSE 1 END AS normalisation_version FROM (
        SELECT doc_id AS id, source || '-' || lang || '-invented' AS corpus_id, 'DOC ' || doc_id AS locator, {norm('text')} AS text FROM documents)""",
    "vectors": "SELECT vec_id AS chunk_id, 'm1' AS embedding_model, 64 AS dim, embedding, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
    "spec": "SELECT corpus_id, (['binding', 'governing', 'advisory', 'contrary', 'excluded'])[n % 6 + 1] AS tier, n AS position FROM works WHERE n % 6 <> 5",
    "loci": "SELECT CASE WHEN id = 12 THEN 'locus-a' ELSE 'locus-b' END AS locus, corpus_id, locator FROM chunks WHERE id IN (12, 14) UNION ALL SELECT 'locus-c', 'src0-en-invented', 'DOC -1'",
    "staged": "SELECT * FROM chunks WHERE id % 10 <> 2",
    "existing": "SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN sha256('old ' || text) ELSE content_hash END AS content_hash) FROM chunks WHERE id % 10 <> 1",
    "manifests": """SELECT corpus_id, 'DOC ' || min(id) AS diagnostic, arg_min(content_hash, id) AS expected_sha256 FROM existing GROUP BY 1""",
    "quotes": f"SELECT item_id, {norm('text')} AS text FROM benchmark",
    "citations": """SELECT q.item_id, coalesce(c.corpus_id, 'src0-en-invented') AS corpus_id, coalesce(c.locator, 'DOC -' || q.item_id) AS locator, CASE WHEN q.item_id % 2 = 0 THEN 'arguments' ELSE 'descriptions' END AS slot,
        CASE WHEN q.item_id % 10 = 9 THEN substr(q.text, 1, 20) WHEN q.item_id % 10 = 8 THEN q.text || 'x' ELSE q.text END AS quote
        FROM quotes q LEFT JOIN (SELECT q.item_id, min(c.id) AS id FROM quotes q JOIN chunks c ON contains(c.text, q.text) GROUP BY 1) h USING (item_id) LEFT JOIN chunks c ON c.id = h.id""",
    "cited": """SELECT t.answer_id, t.turn, (['arguments', 'arguments', 'descriptions', 'contrary_positions', 'contested'])[(t.turn + t.answer_id) % 5 + 1] AS slot,
        coalesce(c.corpus_id, 'src0-en-invented') AS corpus_id, coalesce(c.locator, 'DOC -' || t.cite) AS locator,
        CASE (t.answer_id + t.turn) % 9 WHEN 0 THEN substr(t.body, 1, 20) WHEN 1 THEN substr(t.body, 1, 59) || '§' ELSE substr(t.body, 1, 60) END AS quote
        FROM (SELECT u.*, coalesce(k.text, 'nothing like it was ever written in any of the documents') AS body FROM
            (SELECT DISTINCT conv_id AS answer_id, turn::int AS turn, CASE WHEN conv_id % 6 = 1 THEN 12 ELSE conv_id * 13 + turn * 7 END AS cite FROM conversations WHERE role = 'assistant') u
            LEFT JOIN chunks k ON k.id = u.cite) t LEFT JOIN chunks c ON c.id = t.cite""",
    "placed": """SELECT *, (row_number() OVER (PARTITION BY answer_id, slot ORDER BY turn) - 1)::int AS place, list_position(['arguments', 'descriptions', 'contrary_positions', 'contested'], slot) - 1 AS slot_order FROM cited""",
    "answer_facts": """SELECT answer_id, answer_id % 2 + 1 AS attempt, CASE WHEN answer_id % 3 = 0 THEN 'a position' ELSE '' END AS position, count_if(slot = 'arguments') AS cited_arguments, CASE WHEN answer_id % 8 = 5 THEN 1 ELSE 0 END AS bare,
        count_if(slot = 'descriptions') AS n_descriptions, count_if(slot = 'contrary_positions') AS n_contrary, answer_id % 5 = 1 AS is_contested,
        CASE WHEN answer_id % 5 <> 1 THEN '' WHEN answer_id % 2 = 0 THEN 'locus-x' ELSE 'locus-a' END AS locus,
        CASE WHEN answer_id % 4 = 1 THEN 'They say: ' || coalesce(string_agg(CASE WHEN slot = 'contested' THEN quote END, ' | ' ORDER BY turn), '') WHEN answer_id % 7 = 3 THEN 'debated' ELSE '' END AS debate,
        CASE WHEN answer_id % 22 = 2 THEN repeat('r', 201) WHEN answer_id % 11 = 2 THEN 'silent' ELSE '' END AS reason FROM cited GROUP BY answer_id""",
    "attempts": """SELECT conv_id AS request_id, attempt, CASE WHEN (conv_id * 7 + turn * turn) % 5 = 0 THEN 'generation-failed' WHEN (conv_id * 7 + turn * turn) % 5 <= 2 THEN 'failed' ELSE 'passed' END AS status
        FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt FROM conversations WHERE role = 'assistant') WHERE attempt <= 2""",
}
_NEEDS = {
    "spec": ["works"], "loci": ["chunks"], "staged": ["chunks"], "existing": ["chunks"], "manifests": ["existing"], "citations": ["quotes", "chunks"], "cited": ["chunks"], "placed": ["cited"], "answer_facts": ["cited"],
}


def with_tables(query: str, *names: str, recursive: bool = False, **more: str) -> str:
    """``query`` with the named queries, and ``more`` of its own, before it."""
    order: list[str] = []

    def add(name):
        for x in _NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS (\n{SQL[n]})" for n in order] + [f"{n} AS (\n{q})" for n, q in more.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + f"\n{query}" if parts else query
