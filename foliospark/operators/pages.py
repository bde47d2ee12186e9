"""Pages of sorted rows: places come from range partitions and a count of each, so no page sorts what stands before it.

Rows are dealt out by ranges of their keys and written with the number of their partition. A partition's rows begin at
the place that the counts of those before it add up to, which is a table of a row for each partition (and group).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.verify import licence_refusal
from foliospark.storage import shared_dir, written

SIZE = 500  # fixed value: rows of a page
#: Rows of a partition of a page index, about.
PART = 1 << 17


def write_pages(rows: DataFrame, keys: list[str], path: str, part: int = PART) -> None:
    """Write ``rows`` in order of ``keys`` under ``path``: parts of about ``part`` rows, and the place in which each begins. Replaces what is there."""
    n = max(1, -(-rows.count() // part))
    dealt = rows.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    counts = rows.sparkSession.read.schema("part int").parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each part
    counts.withColumn("before", before).write.mode("overwrite").parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, keys: list[str], page: int, size: int = SIZE) -> DataFrame:
    """The ``page``-th ``size`` rows (from 0): only the parts that hold them are read, and sorted each on its own. Where nothing was written, only the keys are columns."""
    lo, hi = page * size, (page + 1) * size
    held = spark.read.parquet(f"{path}/index").filter((F.col("before") < hi) & (F.col("before") + F.col("n") > lo)).collect()  # parts of one page
    if spark.read.parquet(f"{path}/index").isEmpty():
        return spark.createDataFrame([], ", ".join(f"`{k}` string" for k in keys))
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c != "part"]
    start = F.create_map(*[F.lit(x) for r in held for x in (r["part"], r["before"])]) if held else F.lit(None).cast("map<int,bigint>")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1 + start[F.col("part")]
    found = rows.filter(F.col("part").isin([r["part"] for r in held])).withColumn("place", place)
    return found.filter((F.col("place") >= lo) & (F.col("place") < hi)).select(*columns)


def page_slice(rows: DataFrame, keys: list[str], page: int, size: int = SIZE, part: int = PART) -> DataFrame:
    """One page of ``rows`` by an index of its own; a reader of many pages writes the index once."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    write_pages(rows, keys, path, part)
    found = read_page(spark, path, keys, page, size)
    return found if set(found.columns) == set(rows.columns) else rows.limit(0)


def numbered(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """``rows`` with ``place`` and ``of``: the place (from 0) in its group by ``keys``, and the group's size; a group of any size is many tasks."""
    dealt = written(rows.repartitionByRange(group, *keys).withColumn("part", F.spark_partition_id()), "numbered")
    n = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(group)  # a row for each part of a group
    starts = n.select(group, "part", (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(by).alias("of"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*keys)) - 1
    return dealt.withColumn("place", place.cast("long")).join(starts, [group, "part"]).withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def browse(chunks: DataFrame, works: DataFrame, committed: DataFrame, page: int, size: int = SIZE, opt_in: bool = False) -> DataFrame:
    """corpus_id, page, pages, place, locator, text, blessed, withheld: what the ``page``-th page of each corpus shows.

    A corpus with fewer pages shows its last. Where the licence forbids serving, ``withheld`` says why, and there is no text
    at all. ``blessed``: whether a chunk is what was committed, null if nothing was committed for it.
    """
    rows = numbered(chunks.select("corpus_id", "locator"), "corpus_id", ["locator"]).withColumn("pages", F.ceil(F.col("of") / size))
    shown = rows.withColumn("page", F.least(F.lit(page).cast("long"), F.col("pages") - 1)).filter(F.floor(F.col("place") / size) == F.col("page"))
    shown = shown.join(works.select("corpus_id", licence_refusal(F.col("license"), opt_in).alias("withheld")), "corpus_id")
    shown = shown.join(committed.select("corpus_id", "locator", "sha256"), ["corpus_id", "locator"], "left")
    texts = chunks.select("corpus_id", "locator", "text", "content_hash")  # of what is shown only
    shown = shown.join(texts, ["corpus_id", "locator"])
    return shown.select("corpus_id", "page", "pages", "place", "locator", F.when(F.col("withheld").isNull(), F.col("text")).alias("text"), (F.col("sha256") == F.col("content_hash")).alias("blessed"), "withheld")
