"""What keeps a document from being segmented without loss: every line that a segmenter would drop or misnumber, as rows.

Segmenters give what they can read; acquisition refuses an edition that has any of these problems. All of them are
found in one pass over a document's lines, so a refusal names each place and not only the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.segment import CHAPTER, HEADING_CHARS, HEADING_MARK, NUMBERED, RECOMMENDATIONS, ROMAN_HEADING, SECTION, _blank, lines


def _number(shape: str, line: str = "line") -> Column:
    return F.when(F.col(line).rlike(shape), F.regexp_extract(line, shape, 1).try_cast("long"))


def _before(key: str, *more: str):
    return Window.partitionBy(key, *more).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)


def _where(what: Column, found: Column, expected: Column) -> Column:
    """Null where the numbers agree."""
    return F.when(found != expected, F.concat(what, found.cast("string"), F.lit(" where "), expected.cast("string"), F.lit(" was expected")))


def section_problems(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, problem of texts in numbered sections under chapter headings.

    Chapters go on by one from 1, and sections from 1 in each chapter; a number is expected to follow the one found
    before it. Text stands in a section. A document with text but no chapter has a problem in each line.
    """
    rows = lines(docs, key).filter(~_blank(F.col("line")))
    rows = rows.select(key, "line_no", _number(CHAPTER).alias("chapter"), F.when(~F.col("line").rlike(CHAPTER), _number(SECTION)).alias("section"))
    rows = rows.withColumns({"chapter_before": F.last("chapter", True).over(_before(key)), "part": F.count("chapter").over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("section_before", F.last("section", True).over(_before(key, "part")))
    in_chapter = F.col("part") > 0
    problem = (
        F.when(F.col("chapter").isNotNull(), _where(F.lit("chapter "), F.col("chapter"), F.coalesce("chapter_before", F.lit(0)) + 1))
        .when(F.col("section").isNotNull() & ~in_chapter, F.lit("a section before any chapter"))
        .when(F.col("section").isNotNull(), _where(F.concat(F.lit("chapter "), F.col("chapter_before").cast("string"), F.lit(" section ")), F.col("section"), F.coalesce("section_before", F.lit(0)) + 1))
        .when(~in_chapter, F.lit("text before any chapter")).when(F.col("section_before").isNull(), F.lit("text outside a section"))
    )
    return rows.select(key, "line_no", problem.alias("problem")).filter("problem IS NOT NULL")


def report_problems(docs: DataFrame, recommendations: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, line_no, problem of reports with marked headings: text before any section, recommendations that don't go on by one from 1.

    With ``recommendations`` also documents with another number of them (line_no is null there).
    """
    rows = lines(docs, key).filter(~_blank(F.col("line")))
    marked = F.startswith("line", F.lit(HEADING_MARK))
    head = marked & (F.length("line") - len(HEADING_MARK) <= HEADING_CHARS)
    rows = rows.select(key, "line_no", head.alias("head"), F.when(marked, F.trim(F.substring("line", len(HEADING_MARK) + 1, 1 << 30))).otherwise(F.col("line")).alias("line"))
    opens = F.when(F.col("head"), F.col("line").rlike(RECOMMENDATIONS))
    rows = rows.withColumn("in_list", F.coalesce(F.last(opens, True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    rows = rows.withColumns({"section": F.when(F.col("head") & ~F.col("in_list") & F.col("line").rlike(ROMAN_HEADING), 1), "item": F.when(~F.col("head") & F.col("in_list"), _number(NUMBERED))})
    rows = rows.withColumns({"sections": F.count("section").over(_before(key)), "item_before": F.last("item", True).over(_before(key))})
    problem = (
        F.when(F.col("item").isNotNull(), _where(F.lit("recommendation "), F.col("item"), F.coalesce("item_before", F.lit(0)) + 1))
        .when(~F.col("head") & ~F.col("in_list") & (F.col("sections") == 0), F.lit("text before any section heading"))
    )
    out = rows.select(key, F.col("line_no").cast("int"), problem.alias("problem")).filter("problem IS NOT NULL")
    if recommendations is None:
        return out
    n = docs.select(key).distinct().join(rows.groupBy(key).agg(F.count("item").alias("n")), key, "left").na.fill(0, ["n"]).filter(F.col("n") != recommendations)
    return out.unionByName(n.select(key, F.lit(None).cast("int").alias("line_no"), F.concat(F.col("n").cast("string"), F.lit(f" recommendations, {recommendations} were expected")).alias("problem")))


def too_long(segments: DataFrame, longest: int, key: str = "doc_id") -> DataFrame:
    """key, locator, chars of segments of more than ``longest`` characters: sections that ran together."""
    return segments.select(key, "locator", F.length("text").alias("chars")).filter(F.col("chars") > longest)
