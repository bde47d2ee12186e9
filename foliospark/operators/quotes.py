"""Which chunks hold which quotes, word for word: anchors chosen by winnowing meet by hash, and texts are compared only where they do.

A text's anchors are the least of each WINDOW consecutive hashes of GRAM characters (of equal ones the last). What a
quote of WINDOW + GRAM - 1 characters or more has for anchors, every text that holds it has too, so one of them is
enough to find all these texts: each quote takes the one that the fewest chunks have, and a quote with an anchor that no
chunk has is nowhere. Shorter quotes are one hash of all their characters, looked for at every place of a text.

Chunks are read once for all quotes. A bit table of fixed size, filled from the quotes' hashes, goes to the workers, who
pass on only places whose bit is set; beyond some 10^8 hashes it lets everything through and the join decides. Quotes and
chunks meet in joins on hashes and ids, never on the driver. Candidates are compared text by text, so the answer is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.storage import written

GRAM, WINDOW = 12, 9
#: Quotes of so many characters have winnowed anchors.
ANCHORED = GRAM + WINDOW - 1
#: The bit table has 2 ** BITS bits.
BITS = 26
_BASE, _MIX, _LATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive code points."""
    m = len(points) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * _BASE + points[j:j + m]
        h = (h ^ (h >> np.uint64(30))) * _MIX
        h = (h ^ (h >> np.uint64(27))) * _LATE
    return h ^ (h >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def anchors(points: np.ndarray) -> np.ndarray:
    """The hashes that winnowing chooses, each once."""
    h = _hashes(points, GRAM)
    if len(h) < WINDOW:
        return np.empty(0, np.uint64)
    least = h[:len(h) - WINDOW + 1].copy()
    for j in range(1, WINDOW):
        np.minimum(least, h[j:j + len(least)], out=least)
    return np.unique(least)


def _own_anchors(batches):
    for b in batches:
        ids, hashes = [], []
        for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            points = _points(text)
            found = anchors(points) if len(points) >= ANCHORED else _hashes(points, len(points))
            ids += [own] * len(found)
            hashes.append(found)
        whole = np.concatenate([np.empty(0, np.uint64), *hashes]).view(np.int64)
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(whole)], names=["own", "anchor"])


def _bit_table(keys: DataFrame) -> np.ndarray:
    """The bit table of the anchors, as words of 64 bits; however many anchors there are, 2 ** (BITS - 6) words come to the driver at most."""
    places = keys.select(F.shiftrightunsigned("anchor", 64 - BITS).alias("place"))  # a hash's first bits
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(place & 63)))").alias("bits"))
    table = np.zeros(1 << (BITS - 6), np.uint64)
    for part in words.toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
    return table


def _seen(shared, lengths):
    """Which of the quotes' anchors chunks (id, text) may have; hashes of the quotes' short ``lengths`` are tried at every place."""

    def run(batches):
        table = shared.value

        def there(h):
            place = h >> np.uint64(64 - BITS)
            return h[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, hashes = [], [np.empty(0, np.uint64)]
                for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    points = _points(text)
                    for h in (there(anchors(points)), *(np.unique(there(_hashes(points, n))) for n in lengths)):
                        ids += [own] * len(h)
                        hashes.append(h)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate(hashes).view(np.int64))], names=["id", "anchor"])

    return run


def quote_contains(chunks: DataFrame, quotes: DataFrame | list[tuple[int, str]], id_col: str = "id") -> DataFrame:
    """quote_id, id: all chunks that hold each quote (id, text), exactly.

    Null texts hold nothing, and null quotes are held by none. Empty quotes are held by every chunk that has a text.
    Of chunks that share an id the pair comes once if one of them holds the quote; null ids of either side are left out.
    """
    spark = chunks.sparkSession
    if isinstance(quotes, list):
        quotes = spark.createDataFrame(quotes, "quote_id long, quote string")
    given = quotes.toDF("quote_id", "quote").select(F.col("quote_id").cast("long"), "quote").filter("quote_id IS NOT NULL AND quote IS NOT NULL")
    texts = chunks.select(F.col(id_col).cast("long").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
    given = written(given.distinct().withColumn("own", F.sha2(F.col("quote").cast("binary"), 256)), "quotes")
    once = written(given.filter("quote <> ''").select("own", "quote").distinct(), "quote-texts")  # equal quotes are looked for once
    keys = written(once.mapInArrow(_own_anchors, "own string, anchor long"), "quote-anchors")
    short = once.filter(F.length("quote") < ANCHORED).select(F.length("quote").alias("n")).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # under ANCHORED of them
    seen = written(texts.mapInArrow(_seen(spark.sparkContext.broadcast(_bit_table(keys)), lengths), "id long, anchor long"), "chunk-anchors")
    n = seen.join(keys.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    chosen = keys.join(n, "anchor", "left").groupBy("own").agg(F.min_by("anchor", F.struct(F.coalesce("n", F.lit(0)), "anchor")).alias("anchor"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    near = chosen.join(seen, "anchor").select("own", "id").distinct()
    pairs = near.join(once, "own").join(texts, "id").filter(F.contains("text", F.col("quote"))).select("own", "id")
    held = pairs.join(given.select("quote_id", "own"), "own").select("quote_id", "id")
    if given.filter("quote = ''").take(1):
        held = held.unionByName(texts.select("id").crossJoin(given.filter("quote = ''").select("quote_id")))  # the answer itself: every chunk, for each empty quote
    return held.distinct()
