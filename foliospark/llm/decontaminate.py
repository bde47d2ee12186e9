"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other values has the same
template. Windows of template tokens are hash-joined with those of the benchmark; the values that fill a
window's slots must then be consistent: one value of an item stands for one value of an occurrence. A document
may hold an item more than once with other values each time; its best occurrence counts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut, pieces, sized, unused

#: Template tokens of a window; an item with fewer is one window. Least share of literal words in a window.
WINDOW, LITERAL = 8, 0.5
#: A document is contaminated by an item if so large a share of the item's windows is found, with consistent slots.
SHARE = 0.5
#: So many consecutive tokens with the same values are a leak whatever their share; an item with fewer and no window that is literal enough must be there whole.
RUN = 13
#: Windows of the benchmark that go to every task as a sorted array of 8 bytes each; beyond it, windows are joined by a shuffle.
ARRAY_WINDOWS = 2_000_000
_SEED = 7

#: Units that stand beside a number, and given names that are names at a sentence's start too.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees kmh mph % $ € £".split()
)
NAMES = frozenset(
    "alice bob carol carlos charlie dan dave david emma eve frank george grace hannah henry jack james jane jim joe john julia kate kevin laura lisa lucy maria mark mary mike natalia nina oliver olivia paul peter rachel robert sam sara sarah sophie steve susan tim tina tom weng anna max hans klaus pierre marie luc jean juan pedro ana luis sofia pablo".split()
)

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£]|[.!?:;\n]+")
_WORD, _NUMBER, _UNIT, _NAME, _CAPITAL, _STOP = range(6)
_HOLES = {_NUMBER: "number", _UNIT: "unit", _NAME: "name"}


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), _SEED) & ~7


_HOLE_HASHES = np.array([0, *(_hash(f"<{h}>") for h in _HOLES.values())], np.uint64)


class _Kinds(dict):
    """Token -> hash of its lower case, with its kind in the lowest three bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        lower = token.lower()
        if token[0].isdigit():
            kind = _NUMBER
        elif token[0] in ".!?:;\n":
            kind = _STOP
        elif lower in UNITS:
            kind = _UNIT
        elif token[0].isupper() and token[1:].islower():
            kind = _NAME if lower in NAMES else _CAPITAL
        else:
            kind = _WORD
        found = self[token] = _hash(lower) | kind
        return found


_kinds = _Kinds()


class Template:
    """The template tokens of a text: ``kind`` (word, number, unit, name), ``hashes`` and, with values in place of holes, ``exact``; ``tokens`` as written, when asked for."""

    def __init__(self, text: str):
        self._all = _TOKEN.findall(text)
        coded = np.fromiter(map(_kinds.__getitem__, self._all), np.uint64, len(self._all))
        kind = (coded & np.uint64(7)).astype(np.int8)
        before, after = np.full(len(kind), _STOP, np.int8), np.full(len(kind), _STOP, np.int8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        kind[(kind == _CAPITAL) & (before != _STOP)] = _NAME  # a capital in a sentence
        kind[kind == _CAPITAL] = _WORD
        kind[(kind == _UNIT) & (before != _NUMBER) & (after != _NUMBER)] = _WORD
        self._at = np.flatnonzero(kind != _STOP)
        self.kind = kind[self._at]
        self.exact = coded[self._at] & ~np.uint64(7)
        self.hashes = self.exact.copy()
        holes = np.flatnonzero(self.kind)
        self.hashes[holes] = _HOLE_HASHES[self.kind[holes]]

    def __len__(self):
        return len(self.kind)

    def tokens(self, at: int = 0, size: int | None = None) -> list[str]:
        return [self._all[i] for i in self._at[at:None if size is None else at + size]]

    def slots(self, at: int, size: int) -> list[str]:
        """Type and value of what fills the holes of a window."""
        return [f"{_HOLES[k]}:{x.lower()}" for k, x in zip(self.kind[at:at + size].tolist(), self.tokens(at, size), strict=True) if k]


_ALL = (1 << 64) - 1


@cache
def _power(n: int) -> int:
    return pow(0x9E3779B97F4A7C15, n, 1 << 64)


def windows(kind: np.ndarray, hashes: np.ndarray, size: int, least: float = LITERAL) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of ``size`` tokens of which enough are literal."""
    n = len(hashes) - size + 1
    if n <= 0 or not size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, part, span, at = np.full(n, _power(size) * size & _ALL, np.uint64), hashes, 1, 0
    while True:  # the polynomial of a window, from those of spans of 1, 2, 4, ... tokens
        if size & span:
            total += part[at:at + n] * np.uint64(_power(size - at - span))
            at += span
        if at == size:
            break
        part = part[:-span] * np.uint64(_power(span)) + part[span:]
        span *= 2
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    if not least:
        return np.arange(n), total
    literal = np.concatenate(([0], np.cumsum(kind == _WORD)))
    at = np.flatnonzero(literal[size:] - literal[:n] >= least * size)
    return at, total[at]


def runs(form: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all runs of ``size`` tokens as written, but for case; hashes differ from those of windows."""
    at, h = windows(form.kind, form.exact, size, 0.0)
    return at, ~h


_WINDOWS = "size int, exact boolean, window long, at int, slots array<string>"
_SLOTS = pa.list_(pa.string())


def _item_windows(batches, run: int):
    for b in batches:
        rows = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            form = Template(text or "")
            size = min(WINDOW, len(form))
            at, h = windows(form.kind, form.hashes, size)
            rows += [(item, size, False, w, a, form.slots(a, size), len(at)) for a, w in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
            if run and (len(form) >= run or not len(at)):
                size = min(run, len(form))
                at, h = runs(form, size)
                rows += [(item, size, True, w, a, [], len(at)) for a, w in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), _SLOTS, pa.int32())
        columns = zip(*rows, strict=True) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item_id", "size", "exact", "window", "at", "slots", "n"])


def _doc_windows(batches, sizes: list[tuple[int, bool]], known: np.ndarray | None):
    """Windows, by size and whether with values, of (doc_id, text, mark) rows that are in the sorted array ``known``; all windows if there is none."""
    maybe = None
    if known is not None and len(known):  # a first look by the leading bits, which few pass
        shift = np.uint64(64 - min(24, 4 + len(known).bit_length()))
        maybe = np.zeros(1 << (64 - int(shift)), bool)
        maybe[known.view(np.uint64) >> shift] = True
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), _SLOTS)

    def out(rows):
        for lo in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo:lo + 20_000], strict=True), kinds, strict=True)], names=["doc_id", "mark", "window", "place", "filled"])

    rows = []
    for b in pieces(batches):
        for doc, text, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(rows) >= 20_000:
                yield from out(rows)
                rows = []
            form = Template(text)
            for size, exact in sizes:
                at, h = runs(form, size) if exact else windows(form.kind, form.hashes, size)
                if maybe is not None and len(h):
                    few = np.flatnonzero(maybe[h >> shift])
                    if not len(few):
                        continue
                    at, h = at[few], h[few]
                h = h.view(np.int64)
                if maybe is not None:
                    hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    at, h = at[hit], h[hit]
                rows += [(doc, mark, w, a, [] if exact else form.slots(a, size)) for a, w in zip(at.tolist(), h.tolist(), strict=True)]
    yield from out(rows)


def consistent(hits: list[dict]) -> set[int]:
    """Positions of an item's windows whose slot values agree: each value of the item with the value that most windows give it."""
    votes: dict[str, Counter] = {}
    for h in hits:
        for own, filled in zip(h["slots"], h["filled"], strict=True):
            votes.setdefault(own, Counter())[filled] += 1
    chosen = {own: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for own, c in votes.items()}
    used = Counter(chosen.values())  # two values of the item can't both stand for one
    good = {own: filled for own, filled in chosen.items() if used[filled] == 1 or own == filled}
    return {h["at"] for h in hits if all(good.get(own) == filled for own, filled in zip(h["slots"], h["filled"], strict=True))}


def best(hits: list[dict]) -> int:
    """Most windows of an item that agree: in one occurrence, by offset (``place`` - ``at``) or by offsets that edits shift a little, or in all hits together.

    Hits without slots agree with every occurrence and count for all of them.
    """
    free = {h["at"] for h in hits if not h["slots"]}
    held = sorted((h for h in hits if h["slots"]), key=lambda h: h["place"] - h["at"])
    once = {(h["at"], *h["slots"], *h["filled"]): h for h in held}  # together, equal occurrences vote once
    groups, exact, near, last = [[*once.values()]], [], [], None
    for h in held:
        offset = h["place"] - h["at"]
        if last is None or offset != last:
            groups.append(exact := [])
        if last is None or offset - last >= WINDOW:
            groups.append(near := [])
        exact.append(h)
        near.append(h)
        last = offset
    return max(len(free | consistent(g)) for g in groups)


def _judge(batches):
    for b in batches:
        share = [best(h) / n for h, n in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(share, pa.float64())], names=["doc_id", "mark", "item_id", "exact", "share"])


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", run: int = 0) -> DataFrame:
    """doc_id, mark (XXH64 of the text), item_ids, share: the documents that hold benchmark items.

    What is gathered for a document and an item is bounded by the document: a hit for each window of its text.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    items = cut(items.mapInArrow(lambda it: _item_windows(it, run), f"item_id long, {_WINDOWS}, n int"), "items")
    sizes = sorted(map(tuple, items.select("size", "exact").distinct().collect()))  # WINDOW or less, of runs ``run`` or less
    known = None
    if items.count() <= ARRAY_WINDOWS:
        known = np.sort(items.select("window").distinct().toPandas()["window"].to_numpy(np.int64))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    found = base.mapInArrow(lambda it: _doc_windows(it, sizes, known), "doc_id long, mark long, window long, place int, filled array<string>")
    met = found.join(sized(items), "window").filter(F.size("slots") == F.size("filled"))
    met = met.withColumn("place", F.when(F.size("slots") > 0, F.col("place")).otherwise(0))  # what has no slots agrees anywhere
    hits = met.groupBy("doc_id", "mark", "item_id", "exact").agg(F.collect_set(F.struct("at", "place", "slots", "filled")).alias("hits"), F.first("n").alias("n"))
    judged = hits.select("doc_id", "mark", "item_id", "exact", "hits", "n").mapInArrow(_judge, "doc_id long, mark long, item_id long, exact boolean, share double")
    bad = judged.filter(F.col("exact") | (F.col("share") >= share))
    return bad.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))


def _marked(docs: DataFrame, benchmark: DataFrame, share: float, how: str, id_col: str, text_col: str, run: int) -> tuple[DataFrame, str]:
    """``docs`` joined with its leaks, which are a struct (doc_id, mark, item_ids, share) of the name given back."""
    found = sized(cut(leaks(docs, benchmark, share, id_col, text_col, run), "leaks"))
    name = unused(docs, "leak")
    found = found.select(F.struct("doc_id", "mark", "item_ids", "share").alias(name))
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found[f"{name}.doc_id"]) & (mark == found[f"{name}.mark"]), how), name


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", run: int = 0) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), share (the largest of an item's windows or runs) of every row of ``docs``.

    A document holds an item if it has ``share`` of its windows with consistent slots or, with ``run``, so
    many consecutive tokens of it as they are. Items without a window that is literal enough are found only
    as they are: ``run`` tokens, or all if they have fewer; without ``run`` they match nothing. Null texts count as empty and hold nothing. Items without an id or a
    token match nothing; of items with equal templates all are named. Rows that share an id and a text get
    the same verdict; null ids are ids. No benchmark or no documents: nothing is contaminated. Whole texts
    are read.
    """
    out, leak = _marked(docs, benchmark, share, "left", id_col, text_col, run)
    ids = F.coalesce(f"{leak}.item_ids", F.array().cast("array<bigint>"))
    return out.select(docs[id_col].alias("doc_id"), (F.size(ids) > 0).alias("contaminated"), ids.alias("item_ids"), F.coalesce(f"{leak}.share", F.lit(0.0)).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", run: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``contamination`` clears."""
    return _marked(docs, benchmark, share, "left_anti", id_col, text_col, run)[0]
