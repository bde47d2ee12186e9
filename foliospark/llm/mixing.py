"""Mixing sources to target weights by Pareto order sampling.

Documents of a source are worth copies by their length: in proportion to the logarithm of their size, at most
``cap``, so that the expected words are the source's target. Whole copies are certain; what is left over is
the document's own inclusion probability for one more. Documents are ranked by random odds over inclusion
odds, and the lowest ranks are taken up to the words that are due. Beyond that rank, in order, whatever still
fits settles the sum.

Where a source's ranks end is found by counting words in bins, over and over within the bin that the end lies
in, until what is left is small: the ranks are exact, and no source is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import cut, sized, unused

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Sizes are told apart by so many classes for each doubling; a class's documents are worth equally many copies.
FINE = 8
#: A source's ranks are counted in so many bins at a time, until at most LAST of them are left; at least AFTER beyond the end are looked at to settle the sum.
BINS, LAST, AFTER = 1024, 4096, 256
_KEY_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of each source in ``sizes`` (source, size).

    Targets share ``share`` of all words by weight, the weights repeating in code-point order of the sources
    (null last); none is above ``cap`` times its source, and the excess goes to the others by weight.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    kinds = T.StructType([sizes.schema["source"], T.StructField("source_size", T.LongType()), T.StructField("weight", T.DoubleType())])
    ranked = totals.rdd.zipWithIndex().map(lambda x: (x[0][0], int(x[0][1] or 0), float(weights[x[1] % len(weights)])))
    table = cut(spark.createDataFrame(ranked, kinds), "mix-sources")
    due = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.lit(False)
    for _ in range(table.count()):  # each round fills at least one more source, or is the last
        got = table.agg(
            F.sum(F.when(full, cap * F.col("source_size")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not got["open"]:
            break
        level = max(level, (due - got["held"]) / got["open"])
        now = F.lit(level) * F.col("weight") >= cap * F.col("source_size")
        if not table.filter(now & ~full).head(1):
            break
        full = now
    return table.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), cap * F.col("source_size")).alias("target"))


def _worth(size_class: np.ndarray) -> np.ndarray:
    """What a document of a class is worth against others: the binary logarithm of its size, and one."""
    return 1 + size_class / FINE


def _odds(pdf: pd.DataFrame, cap: float) -> pd.DataFrame:
    """One source's classes (rank, target, class, words) -> whole copies and chance of one more, of which words times copies make the target; and the words that are due by draw."""
    pdf = pdf.sort_values("class", ascending=False)
    worth, words, target = _worth(pdf["class"].to_numpy(np.float64)), pdf["words"].to_numpy(np.float64), float(pdf["target"].iloc[0])
    held = np.concatenate(([0.0], np.cumsum(words)[:-1])) * cap  # if all longer classes are at the cap
    open_ = np.cumsum((words * worth)[::-1])[::-1]
    level = np.maximum(target - held, 0.0) / open_  # if this is the longest class that isn't
    at = np.flatnonzero(level * worth < cap)
    copies = np.minimum(cap, level[at[0]] * worth) if len(at) else np.full(len(worth), cap)
    copies[:at[0] if len(at) else len(worth)] = cap
    whole = np.floor(copies)
    return pd.DataFrame({"__rank": pdf["rank"], "__class": pdf["class"], "__whole": whole.astype(np.int64), "__chance": copies - whole, "due": target - whole @ words})


def _narrow(pdf: pd.DataFrame, parts: int, last: int, after: int) -> pd.DataFrame:
    """One source's words by bin of [lo, hi) -> the bins around the one in which what is due ends, as new lo, hi and due."""
    pdf = pdf.sort_values("bin")
    lo, hi, due = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), float(pdf["due"].iloc[0])
    upto = np.cumsum(pdf["words"].to_numpy(np.float64))
    bins, n = pdf["bin"].to_numpy(), pdf["n"].to_numpy()
    at = min(int(np.searchsorted(upto, due)), len(bins) - 1)
    end = at + 1 if n[at] > last else at + 1 + int(np.searchsorted(np.cumsum(n[at + 1:]), after))  # a full bin is looked into first
    end, step = min(len(bins) - 1, end), -(-(hi - lo) // parts)
    out = (int(pdf["rank"].iloc[0]), lo + int(bins[at]) * step, min(hi, lo + (int(bins[end]) + 1) * step), due - (float(upto[at - 1]) if at else 0.0), bool(n[at] <= last or step == 1))
    return pd.DataFrame([out], columns=["rank", "lo", "hi", "due", "small"])


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's last ranks (key, size, words, due) -> below which key all are taken (size -1), and what fits from there on, in order of rank."""
    pdf = pdf.sort_values(["key", "size"])
    due, rank, below, spare, rows = float(pdf["due"].iloc[0]), int(pdf["rank"].iloc[0]), None, None, []
    for key, size, words in zip(pdf["key"].tolist(), pdf["size"].tolist(), pdf["words"].tolist(), strict=True):
        if words <= due:
            due -= words
            rows.append((rank, key, size))
        else:
            below = key if below is None else below
            spare = (words, key, size) if spare is None or words < spare[0] else spare
    if spare and spare[0] - due < due:  # a little too much is nearer than what is missing
        rows.append((rank, *spare[1:]))
    below = int(pdf["hi"].iloc[0]) if below is None else below
    return pd.DataFrame([(rank, below, -1), *(r for r in rows if r[1] >= below)], columns=["__rank", "__at", "__of_size"])


def _cut_ranks(drawn: DataFrame, due: DataFrame, parts: int = BINS, last: int = LAST, after: int = AFTER) -> DataFrame:
    """__rank, __at, __of_size: for each source of ``drawn`` (rank, key, size) the key below which all are taken, of size -1, and the keys and sizes beyond that are taken too."""
    state = due.select("rank", F.lit(0).cast("long").alias("lo"), F.lit(1 << _KEY_BITS).cast("long").alias("hi"), "due")
    units = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("size").cast("double").alias("words"), F.count(F.lit(1)).alias("n"))
    done = None
    while True:  # each round leaves 2 of ``parts`` bins at most, or ends
        inside = drawn.join(sized(state), "rank").filter("key >= lo AND key < hi")
        step = F.ceil((F.col("hi") - F.col("lo")) / F.lit(parts))
        bins = units(inside.withColumn("bin", F.floor((F.col("key") - F.col("lo")) / step).cast("long")), "rank", "lo", "hi", "due", "bin")
        now = cut(bins.groupBy("rank").applyInPandas(lambda pdf: _narrow(pdf, parts, last, after), "rank long, lo long, hi long, due double, small boolean"), "mix-bins")
        ready, state = now.filter("small").drop("small"), now.filter("NOT small").drop("small")
        done = ready if done is None else done.unionByName(ready)
        if state.isEmpty():
            break
    rest = drawn.join(sized(cut(done, "mix-ends")), "rank").filter("key >= lo AND key < hi")
    return units(rest, "rank", "hi", "due", "key", "size").drop("n").groupBy("rank").applyInPandas(_settle, "__rank long, __at long, __of_size long")


def _drawn(base: DataFrame, targets: DataFrame, odds: DataFrame, seed: int) -> DataFrame:
    """``base`` with its source's target, certain copies, and rank where there is a chance of one more."""
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("__id"), F.lit(0)), F.col("__id").isNull(), "__size")
    u, chance = (F.shiftrightunsigned(draw, 11) + 0.5) / float(1 << 53), F.col("__chance")
    odd = u * (1 - chance) / (u * (1 - chance) + chance * (1 - u))  # random odds over inclusion odds, brought from (0, inf) to (0, 1)
    out = base.join(sized(targets), base["__source"].eqNullSafe(targets["__of"])).withColumn("__class", _class(F.col("__size")))
    out = out.join(sized(odds), ["__rank", "__class"], "left")
    return out.withColumn("__key", F.when(chance > 0, F.least(F.floor(odd * float(1 << _KEY_BITS)), F.lit((1 << _KEY_BITS) - 1)).cast("long")))


def _class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * FINE).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs``; other columns are not read.

    With ``keep`` all columns of ``docs``, and size to taken in place of columns of those names.

    Null texts have no words and are taken 0 times their 0 words. Null sources are one source, the last.
    Null ids are one id. Draws depend on id, size and seed only: reruns agree, and rows that share them
    are drawn or left together. An empty table gives no rows.
    """
    fields = {"__id": F.col(id_col), "__source": F.col(source_col), "__size": word_count(F.col(text_col))}
    narrow = cut(docs.select(*[c.alias(k) for k, c in fields.items()]), "mix-sizes")
    targets = source_targets(narrow.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, share, cap)
    targets = cut(targets.select(F.col("source").alias("__of"), F.col("source_size").alias("__all"), F.col("target").alias("__target"), F.xxhash64("source", F.col("source").isNull()).alias("__rank")), "mix-targets")
    classes = narrow.filter("__size > 0").join(sized(targets), narrow["__source"].eqNullSafe(targets["__of"]))
    classes = classes.groupBy(F.col("__rank").alias("rank"), F.col("__target").alias("target"), _class(F.col("__size")).alias("class")).agg(F.sum("__size").alias("words"))
    odds = cut(classes.groupBy("rank").applyInPandas(lambda pdf: _odds(pdf, cap), "__rank long, __class int, __whole long, __chance double, due double"), "mix-odds")
    due = odds.filter("__chance > 0").select(F.col("__rank").alias("rank"), "due").distinct()
    odds = odds.drop("due")
    drawn = _drawn(narrow, targets, odds, seed).filter("__key IS NOT NULL").select(F.col("__rank").alias("rank"), F.col("__key").alias("key"), F.col("__size").alias("size"))
    ends = cut(_cut_ranks(cut(drawn, "mix-ranks"), due), "mix-cutoffs")
    below = ends.filter("__of_size = -1").select("__rank", F.col("__at").alias("__below"))
    more = ends.filter("__of_size >= 0").select("__rank", F.col("__at").alias("__key"), F.col("__of_size").alias("__size"), F.lit(True).alias("__more"))
    # a row's rank follows from its id, size and source, so whole documents meet small tables and are not shuffled
    inner = unused(docs, "__mix")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(inner), *[c.alias(k) for k, c in fields.items()]) if keep else narrow
    placed = _drawn(base, targets, odds, seed).join(sized(below), "__rank", "left").join(sized(more), ["__rank", "__key", "__size"], "left")
    extra = F.coalesce((F.col("__key") < F.col("__below")) | F.col("__more"), F.lit(False))
    copies = F.coalesce("__whole", F.lit(0)) + F.when(extra, 1).otherwise(0)
    made = {"size": F.col("__size"), "source_size": F.col("__all"), "target": F.col("__target"), "copies": copies.cast("int"), "taken": (copies * F.col("__size")).cast("long")}
    first = [F.col(f"{inner}.`{c}`") for c in docs.columns if c not in made] if keep else [F.col("__id").alias("doc_id"), F.col("__source").alias("source")]
    return placed.select(*first, *[c.alias(k) for k, c in made.items()])
