"""Tables, nested answers and closed domains of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed domains, in their order.
LICENSES = ("public-domain", "cc-by", "cc-by-sa", "local-only", "refused")
TEXT_FORMS = ("tr", "critical", "majority", "not-applicable")
TIERS = ("binding", "governing", "advisory", "contrary", "excluded")
OUTCOMES = ("verified", "regenerated", "degraded", "generation-failed")
LEVELS = ("low", "medium", "high")
ANSWER_FAILURES = (
    "citations-required", "argument-lacks-authority", "position-without-arguments", "contested-with-arguments", "contested-locus-unknown", "contested-ruling-uncited",
    "contested-ruling-unquoted", "ruling-cited-while-uncontested", "state-of-debate-without-contest", "no-answer-reason-not-alone", "no-answer-reason-too-long", "empty-answer",
)
GENERATION_FAILURES = ("truncated", "context-exhausted", "provider-refused", "empty", "not-json", "not-an-object")


def domain_differences(named: list[str], stored: DataFrame, column: str) -> DataFrame:
    """value, only_in: values of a closed domain that are ``named`` here but not stored, or stored but not named; none if both agree."""
    here = stored.sparkSession.createDataFrame([(x,) for x in named], "value string")
    there = stored.select(F.col(column).alias("value")).distinct()
    both = here.withColumn("a", F.lit(True)).join(there.withColumn("b", F.lit(True)), "value", "full_outer").filter("a IS NULL OR b IS NULL")
    return both.select("value", F.when(F.col("b").isNull(), "named").otherwise("stored").alias("only_in"))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
CITATION = _struct(corpus_id=_S, locator=_S, tier=_S, quote=_S)
CITATIONS = T.ArrayType(CITATION)
ANSWER = _struct(
    position=_S,
    arguments=T.ArrayType(_struct(claim=_S, warrant=_S, citations=CITATIONS)),
    descriptions=T.ArrayType(_struct(subject=_S, content=_S, citations=CITATIONS)),
    contrary_positions=T.ArrayType(_struct(position=_S, held_by=T.ArrayType(_S), citations=CITATIONS)),
    contested=_struct(is_contested=T.BooleanType(), locus=_S, citations=CITATIONS, state_of_debate=_S),
    no_answer_reason=_S,
    confidence=_struct(level=_S, reason=_S),
)
WORKS = _struct(corpus_id=_S, work=_S, author=_S, era=_S, language=_S, source_language=_S, text_form=_S, edition=_S, license=_S, attribution=_S)
CHUNKS = _struct(id=_L, corpus_id=_S, locator=_S, text=_S, content_hash=_S, normalisation_version=_I)
EMBEDDINGS = _struct(chunk_id=_L, embedding_model=_S, dim=_I, embedding=T.ArrayType(T.FloatType()))
STAGED = _struct(corpus_id=_S, locator=_S, text=_S, content_hash=_S)
