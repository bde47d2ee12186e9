"""Line dedup by a segment-partition edit join.

Lines within an edit distance of k share, of k + 1 segments of the shorter line, one that no edit touches.
Every line puts its segments in an index that knows its length, and probes the index of each length from its
own down to k less with those substrings that a segment could have moved to. Lines that meet under a key are
compared by banded bit-parallel edit distance. Of lines that are equal or linked only the first stays.

Where very many lines meet under a key, that is one segment that they share: what is left of each line around
it is split into segments again, and they are compared where they share one of those too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import NARROW_ROWS, cut, meet, pieces, sized, unused
from foliospark.llm.components import components

#: Unless a call says otherwise, shorter lines are never touched; between the two, lines are only equal or not.
LEAST_CHARS, NEAR_CHARS = 25, 40
#: What the queries ask for: equal lines of any length, and edits from the length on at which three segments are 8 characters.
WHOLE = {"least": 1, "near": 25}
EDITS = 2
#: Lines of a bucket's block; a task compares two blocks at a time.
BLOCK = 1024
#: Keys of more lines are split by what is around the segment, so often at most: fewer are compared in less time than it takes to split them.
SPLIT, SPLITS = 1024, 2
_SEED = 42


#: Stands where a segment was. That lines have it too is no matter: what is found is always compared whole.
_GAP = "\x00\x00\x00"
_BLANK = " \t\n\x0b\x0c\r"


def _squeeze(line: str) -> str:
    """Whitespace runs of the contract's kind as one space, none at the ends."""
    line = line.strip(_BLANK)
    if "  " in line or "\t" in line or "\r" in line or "\x0b" in line or "\x0c" in line:
        for c in _BLANK[1:]:
            line = line.replace(c, " ")
        line = " ".join(p for p in line.split(" ") if p)
    return line


def squeezed_line(line: Column) -> Column:
    """The same as a column."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, end) of ``edits`` + 1 even segments; the last ones are longer by one."""
    k = edits + 1
    small, longer = divmod(length, k)
    out, at = [], 0
    for i in range(k):
        size = small + (i >= k - longer)
        out.append((at, at + size))
        at += size
    return out


def _windows(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, end) of all substrings that a line of ``length`` probes with.

    A segment is looked for only where, if it is the first or, from the right, the last that no edit touches,
    the edits before it and after it add up to at most ``edits``.
    """
    out = []
    for other in range(length - edits, length + 1):
        gap = length - other
        for i, (a, b) in enumerate(segments(other, edits)):
            low = max(a - i, a + gap - (edits - i), 0)
            high = min(a + i, a + gap + (edits - i), length - (b - a))
            out += [(other, i, s, s + b - a) for s in range(low, high + 1)]
    return out


class _Keys:
    """Keys of lines, by length."""

    def __init__(self, edits: int):
        self.edits, self.plans = edits, {}

    def _plan(self, n: int) -> list[tuple[int, int, int]]:
        if (plan := self.plans.get(n)) is None:
            plan = {(n, i, a, b) for i, (a, b) in enumerate(segments(n, self.edits))} | {*_windows(n, self.edits)}
            plan = self.plans[n] = [((other << 6) | i, a, b) for other, i, a, b in sorted(plan)]
        return plan

    def of(self, line: str) -> list[int]:
        plan = self._plan(len(line))
        h = xxhash.xxh64_intdigest
        if line.isascii():
            data = line.encode()
            return [h(data[a:b], seed) for seed, a, b in plan]
        return [h(line[a:b].encode("utf-8", "surrogatepass"), seed) for seed, a, b in plan]

    def around(self, line: str, path: list[int]) -> set[str]:
        """What is left of a line around the segments that the keys in ``path`` stand for, one after another."""
        left = {line}
        for key in path:
            left = {x[:a] + _GAP + x[b:] for x in left for found, (_, a, b) in zip(self.of(x), self._plan(len(x)), strict=True) if found == key}
        return left


def within(a: str, b: str, edits: int) -> bool:
    """Whether at most ``edits`` insertions, deletions and substitutions turn ``a`` into ``b``.

    Bits are diagonals of the band; the e-th word holds those that e edits can reach. A step takes a character
    of ``a``: match and substitution stay on a diagonal, deletion goes down one, insertion goes up one.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    step, same, n = 1 << 10, 0, min(len(a), len(b))
    while step:  # what both begin with is no work
        while same + step <= n and a[same:same + step] == b[same:same + step]:
            same += step
        step >>= 1
    a, b = a[same:], b[same:]
    band = (1 << (2 * edits + 1)) - 1
    where: dict[str, int] = {}
    for p, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << (p + edits)
    reach = [((2 << e) - 1) << edits & band for e in range(edits + 1)]
    for i, c in enumerate(a):
        match = where.get(c, 0) >> i & band
        old, now = 0, 0
        for e in range(edits + 1):
            was = reach[e]
            now = (was & match | old | old >> 1 | now << 1) & band
            old, reach[e] = was, now
        if not now:
            return False
    return bool(reach[edits] >> (len(b) - len(a) + edits) & 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _id(line: str) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(line.encode("utf-8", "surrogatepass"), _SEED)
    return _signed(d >> 64), _signed(d & ((1 << 64) - 1))


def _lines(batch, least: int):
    """(doc_id, hash of the text, position, line) of a batch's (doc_id, text, thash) lines that are long enough."""
    for doc, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if len(text) >= least:
            for pos, raw in enumerate(text.split("\n")):
                if len(raw) >= least and len(line := _squeeze(raw)) >= least:
                    yield doc, mark, pos, line


_SEEN = "doc_id long, mark long, pos int, id long, more long, keys array<long>"


def _occurrences(batches, edits: int, least: int, near: int):
    """A row for each line; with its keys if it is long enough for edits and the worker hasn't just seen it."""
    keys, seen = _Keys(edits), set()
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    for b in pieces(batches, 1000):
        rows, found, sizes = [], [], []
        for doc, mark, pos, line in _lines(b, least):
            own = _id(line)
            rows.append((doc, mark, pos, *own))
            if len(line) >= near and own not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(own)
                found += (k := keys.of(line))
                sizes.append(len(k))
            else:
                sizes.append(0)
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.array(found, np.uint64).view(np.int64), pa.int64()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=False)]
        whole = pa.RecordBatch.from_arrays([*columns, lists], names=["doc_id", "mark", "pos", "id", "more", "keys"])
        for at in range(0, max(1, len(rows)), 5000):
            yield whole.slice(at, 5000)


def _verify(batches, edits: int):
    for b in batches:
        near = pa.array([within(x, y, edits) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["u", "v"])


def _spectra(lines: list[str]) -> np.ndarray:
    """How often each line has the characters of each of 64 kinds; an edit changes two counts by one at most."""
    out = np.zeros((len(lines), 64), np.int32)
    for row, line in zip(out, lines, strict=True):
        row += np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64).astype(np.int32)
    return out


def _forest(rows: list[tuple[int, str]], edits: int):
    """Links that connect what is within ``edits`` in a group: breadth first among lines whose characters differ little enough."""
    rows = sorted(set(rows))
    if len(rows) < 2:
        return
    spectra, left = _spectra([line for _, line in rows]), np.arange(len(rows))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            own, line = rows[at]
            gap = spectra[left] - spectra[at]
            like = (np.abs(gap).sum(axis=1) <= 2 * edits) & (np.abs(gap.sum(axis=1)) <= edits)
            found = [i for i in left[like].tolist() if within(line, rows[i][1], edits)]
            if found:
                yield from ((own, rows[i][0]) for i in found)
                queue += found
                left = left[~np.isin(left, found)]


def _compare(batches, edits: int):
    """Rows (key, lo, hi, id, line) sorted by the first three -> links."""
    now, held = None, []
    for b in batches:
        links = []
        for *group, own, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group != now:
                links += _forest(held, edits)
                now, held = group, []
            held.append((own, line))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])
    links = [*_forest(held, edits)]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _again(batches, edits: int):
    """Rows (id, path, line) -> id, path with one more key: those of what is left of the line around the segments of its path."""
    keys = _Keys(edits)
    for b in batches:
        rows = []
        for own, path, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            plain = [k & (1 << 64) - 1 for k in path]
            rows += [(own, [*path, k]) for k in {_signed(k) for left in keys.around(line, plain) for k in keys.of(left)}]
        for at in range(0, max(1, len(rows)), 20_000):
            part = rows[at:at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.int64()))], names=["id", "path"])


def _met(keyed: DataFrame, key: str) -> DataFrame:
    """u, v, n for each key that two different lines have; n counts lines that several workers saw more than once."""
    met = keyed.groupBy(key).agg(F.min("id").alias("u"), F.max("id").alias("v"), F.count(F.lit(1)).alias("n")).filter("u <> v")
    return cut(met, "lines-met")


def _crowded(keyed: DataFrame, met: DataFrame, key: str, most: int | None) -> DataFrame:
    """key, n, id: the lines of keys that more than two have. Keys of at most ``most`` lines (None: all) are compared whole: of those with the same lines one will do."""
    crowds = cut(met.filter("n > 2").select(key, "n"), "lines-crowds")
    rows = cut(meet(keyed, crowds, key).select(key, "n", "id").distinct(), "lines-crowded")
    whole = rows if most is None else rows.filter(F.col("n") <= most)
    sets = whole.groupBy(key).agg(F.min("id").alias("u"), F.max("id").alias("v"), F.count(F.lit(1)).alias("lines"), F.try_sum(F.shiftright("id", 24)).alias("s"))
    sets = sets.withColumn("s", F.coalesce("s", F.xxhash64(key))).groupBy("u", "v", "lines", "s").agg(F.min(key).alias(key))
    found = meet(whole, cut(sets.select(key, "lines"), "lines-sets"), key, "lines").select(key, "n", "id")
    return cut(found if most is None else found.unionByName(rows.filter(F.col("n") > most)), "lines-crowded")


def near_lines(base: DataFrame, seen: DataFrame, lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """u, v (ids of lines): links that connect all lines within ``edits`` of each other; and id, more of the lines that were read.

    ``base``: doc_id, text, mark; ``seen``: its lines with keys; ``lines``: distinct lines with their first place.
    Most keys that lines meet under hold two lines, which an aggregate finds without moving rows twice. Those
    that hold more are gathered: the largest split by further segments, the others, and what no split tells
    apart, in pairs of blocks of bounded size. Only lines that met are read again.
    """
    keyed = seen.select("id", F.explode("keys").alias("key"))
    met = _met(keyed, "key")
    pairs = met.filter("n = 2").select("u", "v").distinct()
    crowded = _crowded(keyed, met, "key", SPLIT)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).union(crowded.select("id")).distinct()
    wanted = lines.join(sized(cut(ids, "lines-candidates"), NARROW_ROWS), "id", "left_semi")
    wanted = wanted.groupBy("first.doc_id", "first.mark").agg(F.collect_list(F.struct("first.pos", "id", "more")).alias("wanted"))
    wanted = sized(cut(wanted.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "wanted"), "lines-wanted"))
    read = base.join(wanted, base["doc_id"].eqNullSafe(wanted["d"]) & (base["mark"] == wanted["m"])).select(F.split("text", "\n", -1).alias("parts"), "wanted")
    read = read.select(F.explode(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), w["more"].alias("more"), F.get(F.col("parts"), w["pos"]).alias("line")))).alias("x"))
    texts = cut(read.select("x.id", "x.more", squeezed_line(F.col("x.line")).alias("line")).dropDuplicates(["id"]), "lines-texts")
    own = texts.select("id", "line")
    near = lambda pairs: pairs.join(own.toDF("u", "x"), "u").join(own.toDF("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(lambda it: _verify(it, edits), "u long, v long")
    links = near(pairs)
    rows = crowded.filter(F.col("n") <= SPLIT).select(F.array("key").alias("path"), "n", "id")
    large = crowded.filter(F.col("n") > SPLIT).select(F.array("key").alias("path"), "n", "id")
    for more in reversed(range(SPLITS)):
        if large.isEmpty():
            break
        split = cut(large.join(own, "id").select("id", "path", "line").mapInArrow(lambda it: _again(it, edits), "id long, path array<long>"), "lines-split")
        met = _met(split, "path")
        links = links.unionByName(near(met.filter("n = 2").select("u", "v").distinct()))
        again = _crowded(split, met, "path", SPLIT if more else None)
        rows, large = rows.unionByName(again.filter(F.col("n") <= SPLIT)), again.filter(F.col("n") > SPLIT)
    rows = rows.unionByName(large).withColumn("key", F.xxhash64("path"))
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = rows.select("key", "id", F.pmod(F.xxhash64("id"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id")
    rows = rows.join(own, "id").select("key", "lo", "hi", "id", "line").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return links.unionByName(rows.mapInArrow(lambda it: _compare(it, edits), "u long, v long")), texts.select("id", "more")


def removed_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS, near: int = NEAR_CHARS) -> DataFrame:
    """doc_id, mark (XXH64 of the text), gone (positions): the lines of each document that repeat an earlier one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    seen = cut(base.mapInArrow(lambda it: _occurrences(it, edits, max(1, least), near), _SEEN), "lines-seen")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos", "mark")
    lines = cut(seen.groupBy("id", "more").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "lines-distinct")
    links, read = near_lines(base, seen, lines, edits)
    # ids are half of a line's hash: of lines that share one, only the line that was read is in the class
    classes = cut(components(links).withColumnRenamed("node", "id").join(read, "id"), "lines-classes")
    repeated = lines.join(sized(classes, NARROW_ROWS), ["id", "more"], "left")
    repeated = cut(repeated.filter("n > 1 OR root IS NOT NULL").select("id", "more", "first", "root", F.col("n").alias("times")), "lines-repeated")
    heads = cut(repeated.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("n")), "lines-heads")
    kept = meet(repeated.filter("root IS NOT NULL"), heads, "root").select("id", "more", "kept", "times")
    kept = kept.unionByName(repeated.filter("root IS NULL").select("id", "more", F.col("first").alias("kept"), "times"))
    kept = cut(kept.select(F.struct("id", "more").alias("line"), "kept", "times"), "lines-kept")
    gone = meet(seen.select("doc_id", "mark", "pos", F.struct("id", "more").alias("line")), kept, "line", "times").filter(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions ``gone``; lines are split at U+000A."""
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, least: int = LEAST_CHARS, near: int = NEAR_CHARS) -> DataFrame:
    """``docs`` with lines removed from ``text_col``; with ``counts`` also n_lines and n_removed, in place of columns of those names; all other columns stay as they are.

    Of lines (whitespace squeezed) that are equal, or linked by edit distances of at most ``edits`` from
    ``near`` characters on, the one with the smallest id, position and text hash stays; null ids come last. Lines under
    ``least`` characters and empty ones stay. A line repeated in its own document goes as well. Null texts stay null, empty ones
    empty; every row stays, with an empty text if all its lines went. Rows that share an id and a text are
    one document and keep the same lines. An empty table stays empty.
    """
    gone = sized(cut(removed_lines(docs, edits, id_col, text_col, least, near), "lines-gone"))
    name = unused(docs, "lines")
    gone = gone.select(F.struct("doc_id", "mark", "gone").alias(name))
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    out = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[f"{name}.doc_id"]) & (mark == gone[f"{name}.mark"]), "left")
    lost = F.col(f"{name}.gone")
    fields = [without_lines(F.col(f"`{text_col}`"), lost).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if counts:
        fields += [F.coalesce(F.size(F.split(F.col(f"`{text_col}`"), "\n", -1)), F.lit(0)).alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).alias("n_removed")]
    return out.select(*fields)
