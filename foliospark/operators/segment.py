"""Segmentation: documents to lines, lines to citable segments.

A document's lines carry their number. Headings are filled forward over the document's own lines, so windows
are as large as one document; segments are grouped by locator with their lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as t

#: Shapes of structural lines.
CHAPTER = r"^CHAPTER\s+(\d+)\b"
SECTION = r"^(\d+)\.\s+(\S.*)$"
QUESTION = r"^Q\.\s*(\d+)\.\s*(\S.*)$"
ANSWER_LINE = r"^A\.\s*(\S.*)$"
PARAGRAPH = r"^(\d+)-(\d+)\.\s*(\S.*)$"
VERSE = r"^(\S+) (\d+):(\d+)(?:\s+(.*))?$"


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no (from 0), line; a null text has no lines."""
    return docs.select(key, F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "line"))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, paragraph (from 1), text: runs of lines without a blank one, joined by a space."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines(docs, key).withColumn("blank", _blank(F.col("line")))
    rows = rows.withColumn("starts", F.when(~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("paragraph", F.sum("starts").over(w)).filter(~F.col("blank"))
    return rows.groupBy(key, "paragraph").agg(_joined(" ").alias("text"))


def _joined(separator: str, line: str = "line") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line))), lambda x: x[line]), separator)


#: Numbers of a stretch, which one task looks at.
STRETCH = 1 << 16


def contiguity(numbered: DataFrame, group: str, number: str) -> DataFrame:
    """Places where the numbers of a group don't go on by one from what came before, or don't begin at 1.

    Numbers are looked at by stretches of STRETCH; a stretch's first one follows the greatest of the stretches
    before, which are a row each. A group of any size is many tasks.
    """
    rows = numbered.select(group, F.col(number).alias("found"), F.floor(F.col(number) / STRETCH).alias("stretch"))
    tops = rows.groupBy(group, "stretch").agg(F.max("found").alias("top"))
    tops = tops.select(group, "stretch", F.lag("top").over(Window.partitionBy(group).orderBy("stretch")).alias("carried"))
    rows = rows.join(tops, [group, "stretch"]).withColumn("before", F.lag("found").over(Window.partitionBy(group, "stretch").orderBy("found")))
    rows = rows.withColumn("expected", F.coalesce(F.coalesce("before", "carried") + 1, F.lit(1)))
    return rows.filter(F.col("found") != F.col("expected")).select(group, "found", "expected")


def ascending_run(numbers: Column) -> Column:
    """Length of the run 1, 2, 3 that can be read off an array from left to right, skipping other numbers."""
    return F.aggregate(numbers, F.lit(0), lambda s, x: F.when(x == s + 1, s + 1).otherwise(s))


def section_path(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Fill chapter and section forward; a chapter ends the section before it. ``chapter`` and ``section`` are null but on headings."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chapter_at", F.last("chapter", True).over(w)).withColumn("chapter_no", F.count("chapter").over(w))
    inside = Window.partitionBy(key, "chapter_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section_at", F.last("section", True).over(inside)).drop("chapter_no")


def split_runs(rows: DataFrame, key: str, order: str, code: str) -> DataFrame:
    """Codes that come in more than one run of a document's rows, with the number of their runs."""
    w = Window.partitionBy(key).orderBy(order)
    starts = rows.withColumn("before", F.lag(code).over(w)).withColumn("r", F.row_number().over(w))
    starts = starts.filter((F.col("r") == 1) | ~F.col(code).eqNullSafe(F.col("before")))
    return starts.groupBy(key, code).agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")


def out_of_order(rows: DataFrame, key: str, order: str, code: str, canon: list[str]) -> DataFrame:
    """key, code, place, expected: the first place where a document's codes, by first appearance, leave the canonical order, or where codes are missing."""
    first = rows.groupBy(key, code).agg(F.min(order).alias("first")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", code))).alias("found"))
    found = first.select(key, F.transform("found", lambda x: x[code]).alias("found"))
    pairs = F.arrays_zip("found", F.array(*map(F.lit, canon)).alias("canon"))
    wrong = F.filter(F.transform(pairs, lambda x, i: F.struct(i.alias("place"), x["found"].alias(code), x["canon"].alias("expected"))), lambda x: ~x[code].eqNullSafe(x["expected"]))
    return found.select(key, F.get(wrong, F.lit(0)).alias("x")).filter("x IS NOT NULL").select(key, F.col(f"x.{code}"), "x.place", "x.expected")


def _upto(key: str, *more: str):
    return Window.partitionBy(key, *more).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def _numbered(rows: DataFrame, key: str, chapter: Column, opens: Column, locator: Column) -> DataFrame:
    """Rows (key, line_no, line) that belong to a numbered segment, with its locator; headings (where ``chapter`` is not null) end the one before."""
    rows = rows.withColumns({"chapter": chapter, "opens": opens}).withColumn("chapter_at", F.last("chapter", True).over(_upto(key)))
    mark = F.when(F.col("chapter").isNotNull(), F.lit("")).when(F.col("opens"), locator)
    return rows.withColumn("locator", F.last(mark, True).over(_upto(key))).filter(F.col("chapter").isNull() & (F.col("locator") != ""))


def _chapter(pattern: str) -> Column:
    return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1).cast("int"))


def segment_sections(docs: DataFrame, key: str = "doc_id", prefix: str = "WCF") -> DataFrame:
    """key, locator, text: numbered sections under chapter headings; later lines join their section."""
    locator = F.concat(F.lit(f"{prefix} "), F.col("chapter_at").cast("string"), F.lit("."), F.regexp_extract("line", SECTION, 1))
    rows = _numbered(lines(docs, key).filter(~_blank(F.col("line"))), key, _chapter(CHAPTER), F.col("line").rlike(SECTION), locator)
    body = F.when(F.col("opens"), F.regexp_extract("line", SECTION, 2)).otherwise(F.col("line"))
    return rows.withColumn("body", body).groupBy(key, "locator").agg(_joined("\n", "body").alias("text"))


# Shapes of lines where chapters and sections have Roman numbers.
ROMAN_CHAPTER = r"(?i)^Chapter\s+([IVXLC]+)\b"
ROMAN_SECTION = r"^([IVXLC]+)\.\s+(\S.*)$"
NAVIGATION = r"(?i)^Previous\s*\|\s*Next\s*\|\s*Contents$"


def segment_roman_sections(docs: DataFrame, key: str = "doc_id", prefix: str = "WCF") -> DataFrame:
    """As ``segment_sections``, with Roman numbers; navigation lines are dropped, and a chapter that opens without a number is its section 1."""
    rows = lines(docs, key).filter(~_blank(F.col("line")) & ~F.col("line").rlike(NAVIGATION))
    heading, numbered = F.col("line").rlike(ROMAN_CHAPTER), F.col("line").rlike(ROMAN_SECTION)
    rows = rows.withColumn("after_heading", F.lag(heading, 1, False).over(Window.partitionBy(key).orderBy("line_no")) & ~heading)
    number = F.when(numbered, t.roman(F.regexp_extract("line", ROMAN_SECTION, 1)).cast("string")).otherwise("1")
    locator = F.concat(F.lit(f"{prefix} "), F.col("chapter_at").cast("string"), F.lit("."), number)
    chapter = F.when(heading, t.roman(F.regexp_extract("line", ROMAN_CHAPTER, 1)))
    rows = _numbered(rows, key, chapter, numbered | F.col("after_heading"), locator)
    body = F.when(numbered, F.regexp_extract("line", ROMAN_SECTION, 2)).otherwise(F.col("line"))
    return rows.withColumn("body", body).groupBy(key, "locator").agg(_joined("\n", "body").alias("text"))


# Shapes of lines of a work in books, and the ordinals that number them.
BOOK = r"^\s*BOOK (FIRST|SECOND|THIRD|FOURTH)\.?\s*$"
BOOK_CHAPTER = r"^\s*CHAPTER\b\s*(\d+)?"
BOOK_SECTION = r"^\s{3}(\d+)\.\s+\S"
ARGUMENT = r"^\s*ARGUMENT\.\s*$"
BOOKS_BEGIN = r"^INSTITUTES$"
ORDINALS = ("FIRST", "SECOND", "THIRD", "FOURTH")


def _counted(found: Column) -> Column:
    """Of an array of (line_no, number), the line numbers at which 1, 2, 3 and so on are first read off from left to right."""
    none = F.array().cast("array<int>")
    return F.aggregate(found, none, lambda seen, x: F.when(x["number"] == F.size(seen) + 1, F.array_append(seen, x["line_no"])).otherwise(seen))


def segment_books(docs: DataFrame, key: str = "doc_id", prefix: str = "Inst.") -> DataFrame:
    """key, locator, text: paragraphs of numbered sections, by book and chapter, and of those before the books begin (Pref).

    Chapters are counted within their book, their own numbers may be missing. A chapter may list its sections
    by title before setting them out: if after the last number of the count 1, 2, 3 another count gets as far,
    that is the text and the first was the list. Other numbers are part of the prose.
    """
    # dealt out once by document, in as many parts as set: the work on a line is far more than its bytes, by which parts would be joined
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines(docs.select(key, "text").repartition(parts, key), key)
    begun = F.coalesce(F.max(F.when(F.col("line").rlike(BOOKS_BEGIN), 1)).over(_upto(key)), F.lit(0))
    marked = F.coalesce(F.max(F.when(F.col("line").rlike(BOOKS_BEGIN), 1)).over(Window.partitionBy(key)), F.lit(0))
    rows = rows.withColumns({"begun": (begun == 1) | (marked == 0), "is_book": F.col("line").rlike(BOOK)})
    book = F.when(F.col("is_book") & F.col("begun"), F.array_position(F.array(*map(F.lit, ORDINALS)), F.regexp_extract("line", BOOK, 1)).cast("int"))
    rows = rows.withColumn("book", F.last(book, True).over(_upto(key))).filter(~F.col("begun") | F.col("book").isNotNull())
    is_chapter = F.col("begun") & F.col("line").rlike(BOOK_CHAPTER)
    rows = rows.withColumns({"head": is_chapter | F.col("is_book"), "chapter": F.sum(is_chapter.cast("int")).over(_upto(key, "begun", "book"))})
    rows = rows.filter(~F.col("begun") | (F.col("chapter") > 0)).withColumn("at", F.struct("begun", "book", "chapter"))
    number = F.when(~F.col("head") & F.col("line").rlike(BOOK_SECTION), F.regexp_extract("line", BOOK_SECTION, 1).cast("int"))
    # a chapter's lines are gathered with its numbers and dealt out again: rows of a document stay in one partition, and none is made twice
    held = F.when(~F.col("head") & ~F.col("line").rlike(ARGUMENT), F.struct("line_no", "line"))
    found = F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct("line_no", number.alias("number")))))
    counts = rows.groupBy(key, "at").agg(found.alias("found"), F.collect_list(held).alias("held")).withColumn("list", _counted(F.col("found")))
    counts = counts.withColumn("body", _counted(F.filter("found", lambda x: x["line_no"] > F.coalesce(F.element_at("list", -1), F.lit(-1)))))
    counts = counts.select(key, "at", "held", F.when(F.size("body") == F.size("list"), F.col("body")).otherwise(F.col("list")).alias("starts"))  # no filter on it: pushed down, it would count anew for every number
    rows = counts.select(key, "at", "starts", F.explode("held").alias("x")).select(key, "at", "x.*", F.array_contains("starts", F.col("x.line_no")).alias("opens"))
    rows = rows.withColumn("section", F.count_if("opens").over(_upto(key, "at"))).filter("section > 0")
    opens = F.col("opens")
    rows = rows.withColumns({"blank": _blank(F.col("line")), "line": F.trim(F.when(opens, F.regexp_replace("line", r"^\s*\d+\.\s+", "")).otherwise(F.regexp_replace("line", r"^\s+|\s+$", "")))})
    w = Window.partitionBy(key, "at", "section").orderBy("line_no")
    rows = rows.withColumn("starts", F.when(~F.col("blank") & F.lag("blank", 1, True).over(w), 1).otherwise(0))
    rows = rows.withColumn("p", F.sum("starts").over(w)).filter(~F.col("blank"))
    name = F.when(F.col("at.begun"), F.concat(F.col("at.book").cast("string"), F.lit("."), F.col("at.chapter").cast("string"), F.lit("."))).otherwise("Pref.")
    locator = F.concat(F.lit(f"{prefix} "), name, F.col("section").cast("string"), F.lit(".p"), F.col("p").cast("string"))
    return rows.withColumn("locator", locator).groupBy(key, "locator").agg(_joined(" ").alias("text"))


def page_lines(pages: DataFrame, start: str, end: str, running: str, divider: str, resume: str, key: str = "doc_id") -> DataFrame:
    """key, text: lines of page texts (key, page_no, text) from after the line matching ``start`` to that matching ``end``.

    Running heads are dropped, and so is everything from a divider to the next line matching ``resume``.
    """
    rows = pages.select(key, "page_no", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).filter("line <> ''")
    w = Window.partitionBy(key).orderBy("page_no", "pos").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.col("line").rlike(start).cast("int")).over(w)
    rows = rows.withColumn("begun", begun).withColumn("ended", F.max(((F.col("begun") == 1) & F.col("line").rlike(end)).cast("int")).over(w))
    inside = F.when(F.col("line").rlike(divider), True).when(F.col("line").rlike(resume), False)
    rows = rows.withColumn("dividing", F.coalesce(F.last(inside, True).over(w), F.lit(False)))
    before = Window.partitionBy(key).orderBy("page_no", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("was", F.coalesce(F.max("begun").over(before), F.lit(0)))
    kept = rows.filter((F.col("was") == 1) & (F.col("ended") == 0) & ~F.col("dividing") & ~F.col("line").rlike(running))
    place = F.array_sort(F.collect_list(F.struct("page_no", "pos", "line")))
    return kept.groupBy(key).agg(F.array_join(F.transform(place, lambda x: x["line"]), "\n").alias("text"))


# A chapter number alone on a line, and the rest of an opener on the next.
SPLIT_CHAPTER, SPLIT_TAIL = r"^\d{1,2}$", r"^-\d{1,3}\.\s"


def segment_paragraphs(docs: DataFrame, key: str = "doc_id", prefix: str = "BCO") -> DataFrame:
    """key, locator, text: paragraphs numbered chapter-paragraph; lines before the first are structure. An opener that a page broke in two is put together."""
    rows = lines(docs, key).filter(~_blank(F.col("line")))
    w = Window.partitionBy(key).orderBy("line_no")
    before, after = F.lag("line").over(w), F.lead("line").over(w)
    tail = F.col("line").rlike(SPLIT_TAIL) & F.coalesce(before.rlike(SPLIT_CHAPTER), F.lit(False))
    cut_off = F.col("line").rlike(SPLIT_CHAPTER) & F.coalesce(after.rlike(SPLIT_TAIL), F.lit(False))
    rows = rows.withColumns({"whole": F.when(tail, F.concat(before, F.col("line"))).otherwise(F.col("line")), "cut_off": cut_off}).filter(~F.col("cut_off"))
    rows = rows.select(key, "line_no", F.col("whole").alias("line"))
    locator = F.concat(F.lit(f"{prefix} "), F.regexp_extract("line", PARAGRAPH, 1), F.lit("-"), F.regexp_extract("line", PARAGRAPH, 2))
    rows = _numbered(rows, key, _chapter(CHAPTER), F.col("line").rlike(PARAGRAPH), locator)
    body = F.when(F.col("opens"), F.regexp_extract("line", PARAGRAPH, 3)).otherwise(F.col("line"))
    return rows.withColumn("body", body).groupBy(key, "locator").agg(_joined(" ", "body").alias("text"))


def segment_questions(docs: DataFrame, key: str = "doc_id", prefix: str = "WSC") -> DataFrame:
    """key, locator, text: question and answer together, under the question's number; headings without a lower-case letter are dropped."""
    rows = lines(docs, key).filter(~_blank(F.col("line")))
    asks, answers = F.col("line").rlike(QUESTION), F.col("line").rlike(ANSWER_LINE)
    division = ~F.col("line").rlike(r"\p{Ll}") & ~asks & ~answers
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(division, "").when(asks, F.concat(F.lit(f"{prefix} Q&A "), F.regexp_extract("line", QUESTION, 1)))
    body = F.when(asks, F.regexp_extract("line", QUESTION, 2)).when(answers, F.regexp_extract("line", ANSWER_LINE, 1)).otherwise(F.col("line"))
    rows = rows.withColumns({"division": division, "locator": F.last(mark, True).over(w), "body": body}).filter(~F.col("division") & (F.col("locator") != ""))
    return rows.groupBy(key, "locator").agg(_joined("\n", "body").alias("text"))


def segment_verses(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, locator, text: one verse a line; verses without text are skipped."""
    rows = lines(docs, key).filter(F.col("line").rlike(VERSE))
    part = lambda i: F.regexp_extract("line", VERSE, i)
    return rows.select(key, F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3)).alias("locator"), F.trim(part(4)).alias("text")).filter("text <> ''")


# Shapes of a report's headings, how they are marked, and how long one is at most.
HEADING_MARK, HEADING_CHARS = "# ", 120
ROMAN_HEADING, LETTER_HEADING, NUMBERED = r"^([IVX]+)\.\s+\S", r"^([A-Z])\.\s+\S", r"^(\d+)\.\s+(\S.*)$"
RECOMMENDATIONS = r"(?i)^RECOMMENDATIONS\s*$"


def segment_headed(docs: DataFrame, key: str = "doc_id", prefix: str = "GA28") -> DataFrame:
    """key, locator, text: a line is a paragraph, numbered under the path of Roman, letter and number headings; recommendations apart.

    Marked lines are headings unless they are longer than any heading. A heading resets the levels below it;
    one without a number opens nothing, but ends recommendations. Lines before the first Roman heading, and
    those of recommendations that have no number, are structure.
    """
    rows = lines(docs, key).filter(~_blank(F.col("line")))
    bare = F.trim(F.substring("line", len(HEADING_MARK) + 1, 1 << 30))
    marked = F.startswith("line", F.lit(HEADING_MARK))
    rows = rows.withColumns({"head": marked & (F.length("line") - len(HEADING_MARK) <= HEADING_CHARS), "line": F.when(marked, bare).otherwise(F.col("line"))})
    level = lambda shape: F.when(F.col("head") & F.col("line").rlike(shape), F.regexp_extract("line", shape, 1))
    up = _upto(key)
    rec = F.when(F.col("head"), F.col("line").rlike(RECOMMENDATIONS))
    rows = rows.withColumns({"rec": F.coalesce(F.last(rec, True).over(up), F.lit(False)), "opens_roman": F.when(~F.coalesce(rec, F.lit(False)), level(ROMAN_HEADING))})
    rows = rows.withColumns({"roman": F.last("opens_roman", True).over(up), "in_roman": F.count("opens_roman").over(up)})
    rows = rows.withColumn("opens_letter", F.when(F.col("opens_roman").isNull() & F.col("roman").isNotNull(), level(LETTER_HEADING)))
    rows = rows.withColumns({"letter": F.last("opens_letter", True).over(_upto(key, "in_roman")), "in_letter": F.count("opens_letter").over(_upto(key, "in_roman"))})
    rows = rows.withColumn("opens_number", F.when(F.col("opens_roman").isNull() & F.col("opens_letter").isNull() & F.col("roman").isNotNull(), level(NUMBERED)))
    part = ("in_roman", "in_letter")
    rows = rows.withColumns({"number": F.last("opens_number", True).over(_upto(key, *part)), "in_number": F.count("opens_number").over(_upto(key, *part))})
    rows = rows.withColumn("in_rec", F.count(F.when(F.col("head") & F.col("rec"), 1)).over(up)).filter(~F.col("head"))
    counted = F.count(F.when(~F.col("rec"), 1)).over(_upto(key, *part, "in_number", "in_rec"))
    named = F.col("rec") & F.col("line").rlike(NUMBERED)
    rows = rows.withColumns({"p": counted, "r": F.count(F.when(named, 1)).over(up)}).filter(named | (~F.col("rec") & F.col("roman").isNotNull()))
    path = F.concat_ws(".", "roman", "letter", "number", F.col("p").cast("string"))
    locator = F.concat(F.lit(f"{prefix} "), F.when(F.col("rec"), F.concat(F.lit("Rec."), F.col("r").cast("string"))).otherwise(path))
    return rows.select(key, locator.alias("locator"), F.when(F.col("rec"), F.regexp_extract("line", NUMBERED, 2)).otherwise(F.col("line")).alias("text"))


def text_region(docs: DataFrame, start: str, end: str, key: str = "doc_id") -> DataFrame:
    """The lines between the first line equal to ``start`` and the next equal to ``end``, without footnote marks and ruled lines."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs, key)
    rows = rows.withColumn("begun", F.max((F.trim("line") == start).cast("int")).over(w))
    rows = rows.withColumn("ended", F.max(((F.trim("line") == end) & (F.col("begun") == 1) & (F.trim("line") != start)).cast("int")).over(w))
    kept = rows.filter((F.col("begun") == 1) & (F.col("ended") == 0) & (F.trim("line") != start))
    clean = F.when(F.col("line").rlike(r"^\s*[-_=*]{3,}\s*$"), "").otherwise(F.regexp_replace("line", r"\[\d+\]", ""))
    return kept.withColumn("clean", clean).groupBy(key).agg(_joined("\n", "clean").alias("text"))


def checked(segments: DataFrame) -> dict[str, DataFrame]:
    """What keeps segments from being staged: empty texts, bad locators, locators that come twice."""
    return {
        "empty": segments.filter(F.col("text") == ""),
        "bad_locator": segments.filter(~F.col("locator").rlike(t.LOCATOR)),
        "duplicate": segments.groupBy("doc_id", "locator").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    }
