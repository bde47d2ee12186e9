"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.storage import shared_dir as shared_dir
from foliospark.storage import written

#: Largest number of (narrow, fixed-width) rows that is broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000
#: And of bytes, by the size of its files.
BROADCAST_BYTES = 48 << 20
#: Rows of a few numbers that are broadcast at most.
NARROW_ROWS = 500_000
#: A key that more rows have is joined apart, so that no task gets them all.
HUB = 2048

#: Whitespace of all contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark would take it to be on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later stages survive lost executors and never recompute it."""
    small_batches(df.sparkSession)
    return written(df, name)


def small_batches(spark: SparkSession) -> None:
    """Let at most 1000 rows of whole texts cross to Python at once, unless the session says otherwise: Arrow's buffers outside the heap stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def pieces(batches, rows: int = 500):
    """Arrow batches in slices of at most ``rows`` rows: what a worker holds of texts as Python objects stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (already cut) is small by the size of its Parquet files and their row counts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and df.count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (already cut) is small; else leave the join to a shuffle."""
    return F.broadcast(df) if fits(df, rows) else df


def meet(rows: DataFrame, table: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join on ``key`` with a table (already cut) that has one row for each key, and in ``n`` how many rows have it.

    Beyond what is broadcast, keys of more than HUB rows are few against the rows: they are joined apart, by
    broadcast while they fit.
    """
    if fits(table, NARROW_ROWS):
        return rows.join(F.broadcast(table), key)
    hubs = cut(table.filter(F.col(n) > HUB), "hubs")
    rest = rows.join(sized(hubs.select(key), NARROW_ROWS), key, "left_anti").join(table.filter(F.col(n) <= HUB), key)
    return rows.join(sized(hubs, NARROW_ROWS), key).unionByName(rest)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def squeezed(text: Column) -> Column:
    """Null as empty, each whitespace run as one space; single spaces, the common case, are not even matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def bucket(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the fold that held-out rows are chosen by."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus
