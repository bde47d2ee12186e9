"""Exact dedup by counting quotient filters.

Each partition builds filters of its texts' fingerprints, one for each range of high bits; filters of a
range merge losslessly by sorted remainders. Fingerprints counted more than once route their documents to
byte verification, which groups by the whole normalised text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut, sized, squeezed
from foliospark.llm.quotient import CountingQuotientFilter

#: Fingerprints that one Python worker holds before it writes its filters out.
FLUSH = 2_000_000
#: Fingerprints of a range, about; there are 4,096 ranges at least.
RANGE_ROWS = 1 << 20


def _build(batches, range_bits: int):
    held, n = [], 0

    def out():
        fps = np.sort(np.concatenate(held).view(np.uint64))
        ranges = (fps >> np.uint64(64 - range_bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
        parts = np.split(fps, starts[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(ranges[starts], pa.int64()), pa.array([CountingQuotientFilter.of(p, range_bits).to_bytes() for p in parts], pa.binary())],
            names=["range", "filter"],
        )

    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += batch.num_rows
        if n >= FLUSH:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _repeated(batches):
    """Filters sorted by range -> fingerprints that the merged filter counts more than once."""
    now, held = None, []

    def out():
        merged = CountingQuotientFilter.merge(held)
        more = merged.counts > 1
        return pa.RecordBatch.from_arrays([pa.array(merged.keys[more].view(np.int64), pa.int64()), pa.array(merged.counts[more], pa.int64())], names=["fp", "n"])

    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now and held:
                yield out()
                held = []
            now = key
            held.append(CountingQuotientFilter.from_bytes(data))
            if len(held) >= 4096:  # lossless, so it can be done as often as memory asks
                held = [CountingQuotientFilter.merge(held)]
    if held:
        yield out()


def repeated_fingerprints(keyed: DataFrame, range_bits: int = 12) -> DataFrame:
    """``keyed`` has fp (long). Returns fp and n for those with n > 1."""
    filters = keyed.select("fp").mapInArrow(lambda it: _build(it, range_bits), "range long, filter binary")
    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(_repeated, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``; other columns are not read.

    Null text counts as empty; empty texts are one group. The smallest id of a group stays. Null ids are
    never kept for others: a group of null ids alone has keep_id null. Rows that share an id and a text
    are one document and are marked alike. An empty table gives no rows. Long texts are hashed whole.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), squeezed(F.col(text_col)).alias("norm"))
    hashed = F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    keyed = cut(base.select("doc_id", *hashed), "dedup-keys")
    if range_bits is None:
        range_bits = max(12, math.ceil(math.log2(max(1, keyed.count()) / RANGE_ROWS)))
    repeated = cut(repeated_fingerprints(keyed, range_bits), "dedup-repeated")
    routed = base.withColumn("fp", hashed[0]).join(sized(repeated.select("fp")), "fp", "left_semi")
    # byte verification: grouping by the text itself; partial sums fold the copies before the shuffle
    verified = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
    classes = cut(verified.select("fp", hashed[1], "keep", "size"), "dedup-classes")
    if classes.groupBy("fp", "sha").count().filter("count > 1").isEmpty():
        placed = keyed.join(sized(classes), ["fp", "sha"], "left")
    else:  # two texts with the same 320 bits: only the bytes tell
        placed = base.select("*", *hashed).join(verified, ["fp", "norm"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return placed.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )
