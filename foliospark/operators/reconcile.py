"""Fingerprints of two editions compared by digests of ranges: what agrees is not read, only ranges that differ are joined.

Fingerprints are written by ``leaf``, a range of a hash of corpus and locator, with a tree of digests over the leaves:
a node's digest is the number of its rows and sums of two 64-bit hashes of each, so it doesn't depend on their order and
parents add up their children. A comparison walks down from the root through nodes that differ, a row for each child,
and reads the leaves it ends at. Ranges with equal digests are taken to be equal: two that differ would pass for equal
about once in 2 ** 128 times.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.ingest import fingerprint_diff

#: Children of a node, and levels of the tree: FANOUT ** LEVELS leaves. A leaf's rows are a file or more.
FANOUT, LEVELS = 16, 2
_PRINTS, _TREE = "corpus_id string, locator string, sha256 string, leaf int", "node int, n long, one decimal(38,0), two decimal(38,0), level int"


def _leaf(leaves: int) -> Column:
    return F.pmod(F.xxhash64("corpus_id", "locator"), F.lit(leaves)).cast("int")


def _totals(rows: DataFrame, node: Column) -> DataFrame:
    return rows.groupBy(node.alias("node")).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in (("n", "long"), ("one", "decimal(38,0)"), ("two", "decimal(38,0)"))])


def write_prints(prints: DataFrame, path: str, levels: int = LEVELS) -> None:
    """Replace the fingerprints (corpus_id, locator, sha256) under ``path`` and their tree: written whole before the tree, which a reader begins with."""
    spark = prints.sparkSession
    leaves = FANOUT**levels
    rows = prints.select("corpus_id", "locator", "sha256").withColumn("leaf", _leaf(leaves))
    rows.repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/prints")
    kept = spark.read.schema(_PRINTS).parquet(f"{path}/prints")
    hashes = [F.xxhash64(F.lit(seed), "corpus_id", "locator", "sha256").cast("decimal(38,0)").alias(c) for seed, c in ((1, "one"), (2, "two"))]
    level = _totals(kept.select("leaf", F.lit(1).alias("n"), *hashes), F.col("leaf")).withColumn("level", F.lit(levels))
    tree = level
    for at in range(levels - 1, -1, -1):
        level = _totals(level, F.floor(F.col("node") / FANOUT).cast("int")).withColumn("level", F.lit(at))
        tree = tree.unionByName(level)
    tree.write.mode("overwrite").partitionBy("level").parquet(f"{path}/tree")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # nothing was ever written


def differing_leaves(spark: SparkSession, one: str, two: str, levels: int = LEVELS) -> list[int]:
    """Leaves in which what is written under two paths differs: of each level only the children of nodes that differ are read, at most FANOUT ** levels in all."""
    open_ = [0]
    for level in range(levels + 1):
        a, b = (_read(spark, f"{p}/tree", _TREE).filter((F.col("level") == level) & F.col("node").isin(open_)).drop("level") for p in (one, two))
        same = a.join(b, ["node", "n", "one", "two"], "left_semi").select("node")
        odd = [r["node"] for r in a.select("node").union(b.select("node")).distinct().join(same, "node", "left_anti").collect()]
        if not odd:
            return []
        open_ = odd if level == levels else [n * FANOUT + i for n in odd for i in range(FANOUT)]
    return sorted(open_)


def stored_diff(spark: SparkSession, committed: str, acquired: str, levels: int = LEVELS) -> DataFrame:
    """``fingerprint_diff`` of what is written under two paths; leaves that agree are not read."""
    odd = differing_leaves(spark, committed, acquired, levels)
    a, b = (_read(spark, f"{p}/prints", _PRINTS).filter(F.col("leaf").isin(odd)).drop("leaf") for p in (committed, acquired))
    return fingerprint_diff(a, b)
