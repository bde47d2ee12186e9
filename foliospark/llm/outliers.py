"""Quality rules: documents whose statistics lie far from those of their language and source, by minimum covariance determinants.

Statistics of a text are counted by column functions and made vectors of six numbers: the logarithm of the mean
word length, and the square roots of the shares of symbols, capitals, digits, repeated lines and words in
repeated windows (roots even out the spread of counts; a few pseudo-counts keep short texts from extremes). A
group is a language and source, or, where it has under LEAST documents, what is left of its language, and then
what is left of all. Each group's centre and scatter come from concentration steps: take the share SUPPORT of
rows that lie nearest by the scatter so far, and estimate both from them. Two starts (medians with
median deviations, and means with plain covariances) go on until no determinant falls, the less determinant wins,
and a last step weighs in all rows within the 0.975 quantile. Statistics that hardly vary would leave a scatter
without an inverse, so the square of FLOOR is added to each variance; a document is rejected if its distance is
beyond the quantile that TAIL of normal vectors exceed.

All of it is column functions and aggregates. Rows are aggregated before they are shuffled, so a group may hold any
share of them. Vectors are whole multiples of 1/1024 and sums are whole numbers: a rerun has the same results.
Nearest rows are found by counting distances in bins an octave's 64th wide; rows in the bin that reaches SUPPORT
all belong to it. Repeated windows are told apart by 64-bit hashes within one text.

Defined results. A null text has no words. A text of under 50 words, or more than half of whose words are in
repeated windows, fails without a vector, and takes no part in an estimate. Null languages and sources are values
of their own. Where even what is left of all is under LEAST rows nothing is rejected. Repeated rows and ids count
and are judged each. Further columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import SPACE, cut, meet

#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rows that a group's estimate needs, the share of them it is taken from, and the share of normal vectors that would be rejected.
LEAST, SUPPORT, TAIL = 100, 0.75, 1e-5
#: Statistics with the standard deviation that each has at least: what texts differ by without being worse.
FLOOR = {"x_length": 0.1, "x_symbols": 0.05, "x_capitals": 0.1, "x_digits": 0.1, "x_lines": 0.15, "x_windows": 0.15}
UNIT = 1024
#: Concentration steps at most; they end before when the logarithm of no determinant falls by as much.
STEPS, LEAST_FALL = 6, 1e-3
_BINS = 64
NAMES = list(FLOOR)
P = len(NAMES)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more among ``words``."""
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(m):
        same = lambda x, k: F.coalesce(F.get(m, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(m, k + 1)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(m, same), lambda x: x["i"]))
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, begin, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])

    def count(m):
        hashes = F.transform(m, lambda x: x["h"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(m), 0).otherwise(_let(F.sort_array(m), covered))

    return F.when(F.size(words) < 4, 0).otherwise(_let(words, lambda w: _let(windows(w), count)))


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_digits of each whole text, and the ``keep`` columns."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    rows = rows.select(*keep, F.filter(F.split(text, SPACE), lambda x: x != "").alias("_words"), lines.alias("_lines"), (F.length(text) - without(" \t\n\x0b\f\r")).alias("word_chars"), without("#*$%&|<>").alias("n_symbols"),
                       F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"), without("0123456789").alias("n_digits"))
    counts = {"n_words": F.size("_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": repeated_words(F.col("_words")),
              "n_lines": F.size("_lines"), "n_capitals": F.col("n_capitals"), "n_digits": F.col("n_digits")}
    return rows.select(*keep, *[c.cast("long").alias(name) for name, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """The transformed statistics in units of 1/1024."""
    share = lambda n, of, more: F.sqrt(F.col(n) / (F.col(of) + more))
    x = {"x_length": F.log(F.col("word_chars") / F.col("n_words")), "x_symbols": share("n_symbols", "word_chars", 100), "x_capitals": share("n_capitals", "word_chars", 100), "x_digits": share("n_digits", "word_chars", 100),
         "x_lines": share("n_dup_lines", "n_lines", 8), "x_windows": share("n_repeat_words", "n_words", 50)}
    return {name: F.round(x[name] * UNIT).cast("long") for name in NAMES}


def _beyond(x: float, terms: int) -> float:
    """Share of a chi-square of 2 * terms degrees of freedom beyond x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(terms))


def quantile(tail: float, terms: int = P // 2) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _beyond(middle, terms) > tail else (low, middle)
    return high


def _shrunk(share: float) -> float:
    """What the variances of the nearest ``share`` of normal vectors are too small by."""
    return share / (1 - _beyond(quantile(1 - share), P // 2 + 1))


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with the group ``g`` whose estimate judges them, or null."""
    name = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    rows = rows.withColumns({"_fine": F.concat(name("lang"), name("source")), "_lang": name("lang")})
    n = cut(rows.groupBy("_fine", "_lang").agg(F.count_if("_fits").alias("n"), F.count(F.lit(1)).alias("rows")), "outlier-groups")
    # what is left of a language is counted over groups, a row each: neither has more rows than there are groups
    small = n.filter(F.col("n") < LEAST).groupBy("_lang").agg(F.sum("n").alias("of_lang"))
    left = small.filter(F.col("of_lang") < LEAST).agg(F.sum("of_lang").alias("of_all"))
    place = n.join(small, "_lang", "left").join(F.broadcast(left))  # one row
    g = F.when(F.col("n") >= LEAST, F.concat(F.lit("s"), "_fine")).when(F.col("of_lang") >= LEAST, F.concat(F.lit("l"), "_lang")).when(F.col("of_all") >= LEAST, "all")
    return meet(rows, cut(place.select("_fine", "rows", g.alias("g")), "outlier-places"), "_fine", "rows").drop("_fine", "_lang", "rows")


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"s_{c}") for c in NAMES], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS]]


def _estimated(sums: DataFrame, keep: list[str], scale: float) -> DataFrame:
    """Centre m_, the inverse p_ of the scatter and the logarithm of its determinant, from sums of values and of products: Cholesky's factor, step by step."""
    k = F.col("k").cast("double")
    part = sums.select(*keep, *[(F.col(f"s_{c}") / k / UNIT).alias(f"m_{c}") for c in NAMES],
                       *[((F.col(f"q_{i}_{j}") / k - F.col(f"s_{NAMES[i]}") / k * (F.col(f"s_{NAMES[j]}") / k)) / UNIT**2 * scale + (FLOOR[NAMES[i]] ** 2 if i == j else 0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    return _inverted(part, keep)


def _inverted(part: DataFrame, keep: list[str]) -> DataFrame:
    total = lambda terms: reduce(lambda a, b: a + b, terms, F.lit(0.0))
    for j in range(P):
        own = F.sqrt(F.col(f"c_{j}_{j}") - total([F.col(f"l_{j}_{r}") ** 2 for r in range(j)]))
        part = part.withColumn(f"l_{j}_{j}", own)
        part = part.withColumns({f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - total([F.col(f"l_{i}_{r}") * F.col(f"l_{j}_{r}") for r in range(j)])) / F.col(f"l_{j}_{j}") for i in range(j + 1, P)}) if j + 1 < P else part
    for j in range(P):  # columns of the factor's inverse
        part = part.withColumn(f"v_{j}_{j}", 1 / F.col(f"l_{j}_{j}"))
        for i in range(j + 1, P):
            part = part.withColumn(f"v_{i}_{j}", -total([F.col(f"l_{i}_{r}") * F.col(f"v_{r}_{j}") for r in range(j, i)]) / F.col(f"l_{i}_{i}"))
    return part.select(*keep, *[f"m_{c}" for c in NAMES], *[total([F.col(f"v_{r}_{i}") * F.col(f"v_{r}_{j}") for r in range(i, P)]).alias(f"p_{i}_{j}") for i, j in _PAIRS], total([2 * F.log(f"l_{i}_{i}") for i in range(P)]).alias("det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    off = [F.col(c) / UNIT - F.col(f"m_{c}") for c in NAMES]
    return reduce(lambda a, b: a + b, [F.col(f"p_{i}_{j}") * off[i] * off[j] * (1 if i == j else 2) for i, j in _PAIRS])


_FIT = [f"m_{c}" for c in NAMES] + [f"p_{i}_{j}" for i, j in _PAIRS]


def _medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median of ``v`` for each group, from counts of its values."""
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumns({"upto": F.sum("c").over(by.orderBy("v")), "of": F.sum("c").over(by)})
    return ranked.filter(2 * F.col("upto") >= F.col("of")).groupBy(*keys).agg(F.min("v").alias("median"))


def _start(rows: DataFrame) -> DataFrame:
    """First estimates of two starts, keyed by ``key``: medians with median deviations, means with covariances."""
    values = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(NAMES)])).alias("x")).select("g", "x.i", "x.v")
    centre = cut(_medians(values, ["g", "i"]).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "median"))).alias("centre"), F.lit(0).alias("n")), "outlier-medians")  # six rows a group
    away = meet(values, _counted(centre, rows), "g").select("g", "i", F.abs(F.col("v") - F.col("centre")[F.col("i")]).alias("v"))
    spread = _medians(away, ["g", "i"]).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "median"))).alias("spread"))
    at = lambda c, i: F.col(c)[F.lit(i)] / UNIT
    part = centre.join(spread, "g").select(F.concat(F.lit("a"), "g").alias("key"), *[at("centre", i).alias(f"m_{c}") for i, c in enumerate(NAMES)],
                                           *[((1.4826 * at("spread", i)) ** 2 + FLOOR[NAMES[i]] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    plain = rows.groupBy(F.concat(F.lit("b"), "g").alias("key")).agg(*_moments())
    return _inverted(part, ["key"]).unionByName(_estimated(plain, ["key"], 1.0))


def _counted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with the number ``n`` of rows of each group, written down."""
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return cut(table.drop("n").join(n, "g"), "outlier-centres")


def group_estimates(rows: DataFrame) -> DataFrame:
    """g, n, centre and inverse scatter of each group by minimum covariance determinant; ``rows`` (written down) have g and the vector."""
    rows = rows.select("g", *NAMES)
    n = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "outlier-sizes")
    both = n.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("start"), "g", "n").select(F.concat("start", "g").alias("key"), "g", "n")
    twice = rows.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("start"), "*").withColumn("key", F.concat("start", "g")).drop("start", "g")
    now = cut(both.join(_start(rows), "key"), "outlier-start")
    for step in range(STEPS):
        near = meet(twice, now, "key").select("key", "n", *NAMES, F.floor(F.log2(_distance() + 1e-9) * _BINS).cast("int").alias("bin"))
        bins = near.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
        upto = F.sum("c").over(Window.partitionBy("key").orderBy("bin"))  # rows are bins here
        edge = bins.withColumn("upto", upto).filter(F.col("upto") >= F.ceil(F.col("n") * SUPPORT)).groupBy("key").agg(F.min("bin").alias("edge"))
        edges = cut(now.join(edge, "key"), "outlier-edges")
        inner = meet(twice, edges, "key").filter(F.floor(F.log2(_distance() + 1e-9) * _BINS) <= F.col("edge"))
        new = _estimated(inner.groupBy("key").agg(*_moments()), ["key"], _shrunk(SUPPORT)).select("key", F.struct(*_FIT, "det").alias("new"))
        # the starts are no estimates from SUPPORT of the rows: what follows them always counts
        falls = F.lit(step == 0) | (F.col("new.det") < F.col("det") - LEAST_FALL)
        both = now.join(new, "key").withColumn("falls", falls)
        now = cut(both.select("key", "g", "n", "falls", *[F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in (*_FIT, "det")]), "outlier-step")
        if not now.filter("falls").take(1):
            break
    best = now.groupBy("g").agg(F.min_by(F.struct("n", *_FIT), F.struct("det", "key")).alias("e")).select("g", "e.*")
    raw = cut(best, "outlier-raw")
    inside = meet(rows, raw, "g").filter(_distance() <= quantile(0.025))
    final = _estimated(inside.groupBy("g").agg(*_moments()), ["g"], _shrunk(0.975))
    return cut(n.join(final, "g").select("g", "n", *_FIT), "outlier-estimates")


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns, the counts of each text, base_failed, distance (squared; null without a vector or an estimate) and kept."""
    own = [f"_k{i}" for i in range(len(keep))]
    rows = text_statistics(docs.select(*[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"), *own, "lang", "source")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("_fits", ~F.col("base_failed"))
    rows = rows.withColumns({c: F.when(F.col("_fits"), x) for c, x in _vector().items()})
    rows = cut(rows, "outlier-statistics")
    rows = cut(_grouped(rows), "outlier-vectors")
    judged = F.col("_fits") & F.col("g").isNotNull()
    fit = group_estimates(rows.filter(judged))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [F.col(o).alias(c) for c, o in zip(keep, own, strict=True)]
    far = meet(rows.filter(judged), fit, "g").select(*names, *counts, "base_failed", _distance().alias("distance"))
    rest = rows.filter(~judged).select(*names, *counts, "base_failed", F.lit(None).cast("double").alias("distance"))
    return far.unionByName(rest).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= quantile(TAIL)))
