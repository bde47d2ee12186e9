"""SimHash near-dedup with pivot distance tables.

Every distinct fingerprint gets a table row of Hamming distances to reference fingerprints. By the triangle
inequality two fingerprints within a radius have distances within that radius to every reference, so pairs
are discarded by the largest difference of coordinates and only survivors are compared bit by bit.

Which pairs are looked at follows from keys that close pairs must share, so that none is lost. For the small
radius of 64-bit fingerprints, segments: of enough of them, some must be equal. For a similarity threshold,
the first shingles of each set in an order that all sets share: sets that overlap enough meet in those, and a
document's keys are a share of its shingles whatever the size of the corpus. Any order will do; it is that of
their hashes, with shingles that very many of them have put last. Pairs so found are discarded by
pivots at a radius far above what the threshold stands for, and then the sets themselves are compared.

A bucket of any size is first compared with one of its rows; only rows that are not close to it are compared
with all others, by blocks. Links are enough to connect what is close, not all pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import NARROW_ROWS, cut, meet, pieces, sized
from foliospark.llm.components import components

SEED, PIVOTS = 42, 16
#: Rows of a bucket's block; a task holds two blocks at a time. Where shingle sets are compared, which are larger than fingerprints, the second.
BLOCK, SET_BLOCK = 2048, 256
#: Rows of a group that is compared together with other small ones.
FEW = 24
#: The radius of wide fingerprints lies so many standard deviations above what the threshold stands for.
SLACK = 6.0
#: Shingles that more nodes have are put last in the order, at most so many of them (8 bytes each in every task); what is put last changes costs, not results.
HEAVY, HEAVY_KEYS = 256, 1 << 20
#: Of every set so many times its first shingles are kept and counted: they hold what takes the place of shingles put last, unless those are a third of them.
REACH = 1.5


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z lower-cased, fewer words than a shingle give one."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    stops = ends[k - 1:].tolist()
    starts = [0, *(ends[:-k] + 1).tolist()] if len(tokens) > k else [0]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th family of hashes from one; the first is the hash itself."""
    if not k:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words; a bit is 1 if it is set in over half of the hashes. No hashes: zero."""
    if not len(hashes):
        return np.zeros(width, np.uint64)
    ones = np.zeros((width, 64), np.int64)
    for k in range(width):
        for at in range(0, len(hashes), 1 << 16):
            part = np.ascontiguousarray(_mixed(hashes[at:at + (1 << 16)], k)).view(np.uint8).reshape(-1, 8)
            ones[k] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).reshape(width)


def _words(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width).astype(np.uint64)


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances (n, pivots) of fingerprints (n, width) to references drawn from a fixed seed."""
    refs = np.random.default_rng(SEED).integers(0, 1 << 64, (pivots, fps.shape[1]), dtype=np.uint64)
    return np.stack([np.bitwise_count(fps ^ ref).sum(axis=1, dtype=np.int16) for ref in refs], axis=1)


def segment_keys(radius: int, rows: int):
    """Keys of 64-bit fingerprints: of b segments, pairs within the radius agree on b - radius; enough segments that keys outnumber ``rows``."""
    b = next((b for b in range(radius + 2, 65) if 64 * (b - radius) // b >= math.log2(max(rows, 2)) + 3), 64)
    edges = [64 * i // b for i in range(b + 1)]
    choices = list(combinations(range(b), b - radius))

    def keys(fps: np.ndarray) -> np.ndarray:
        x, out = fps[:, 0], np.empty((len(fps), len(choices)), np.uint64)
        parts = [(x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
        for c, chosen in enumerate(choices):
            key = np.full(len(x), c, np.uint64)
            for s in chosen:
                key = _mixed(key ^ parts[s] * np.uint64(0xC2B2AE3D27D4EB4F), s + 1)
            out[:, c] = key
        return out

    return keys


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def first_count(size: int, least: float) -> int:
    """How many shingles a set of ``size`` has first: two sets that resemble each other by ``least`` share one of them."""
    return size - math.ceil(least * size - 1e-9) + 1 if size else 0


def _is_late(shingles: np.ndarray, heavy: np.ndarray | None) -> np.ndarray:
    if heavy is None or not len(heavy):
        return np.zeros(len(shingles), bool)
    return heavy[np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)] == shingles


def first_shingles(shingles: np.ndarray, least: float, heavy: np.ndarray | None = None) -> np.ndarray:
    """Of a sorted set the first in the common order: two sets that resemble each other by ``least`` share one of them."""
    late = _is_late(shingles, heavy)
    return np.concatenate((shingles[~late], shingles[late]))[:first_count(len(shingles), least)]


def first_in_reach(reach: np.ndarray, size: int, least: float, heavy: np.ndarray) -> np.ndarray | None:
    """As ``first_shingles`` of a set of ``size``, of which ``reach`` holds the least hashes; None if some of them lie beyond it."""
    if len(reach) == size:
        return first_shingles(reach, least, heavy)
    found = reach[~_is_late(reach, heavy)][:first_count(size, least)]
    return found if len(found) == first_count(size, least) else None


_MARKED = "doc_id long, mark long, node long, fp binary"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64), pa.int64()))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, mark (XXH64 of the text, null as empty): id and mark tell a document, also where ids are null or repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def fingerprints(base: DataFrame, words: int, width: int = 1) -> DataFrame:
    """doc_id, mark, node, fp (little-endian 64-bit words) of every row; node is the fingerprint's value."""

    def run(batches):
        for b in pieces(batches):
            fps = [fingerprint(shingle_hashes(t, words), width).astype("<u8") for t in b.column(1).to_pylist()]
            nodes = np.array([f[0] if width == 1 else xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in fps], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array([f.tobytes() for f in fps], pa.binary())], names=["doc_id", "mark", "node", "fp"])

    return base.mapInArrow(run, _MARKED)


def shingled(base: DataFrame, words: int, width: int, least: float) -> DataFrame:
    """As ``fingerprints``, of shingle sets; node is a hash of the set, size its number, and keys are REACH times its first shingles by hash."""

    def run(batches):
        for b in pieces(batches):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            fps = pa.array([fingerprint(x, width).astype("<u8").tobytes() for x in sets], pa.binary())
            sizes = pa.array([len(x) for x in sets], pa.int64())
            reach = _lists([x[:math.ceil(REACH * first_count(len(x), least))] for x in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes, pa.int64()), fps, sizes, reach], names=["doc_id", "mark", "node", "fp", "size", "keys"])

    return base.mapInArrow(run, f"{_MARKED}, size long, keys array<long>")


def _read(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (first, and others) with the text of each one's first document."""
    wanted = wanted.select(F.col("first.doc_id").alias("d"), F.col("first.mark").alias("m"), *[c for c in wanted.columns if c != "first"])
    wanted = sized(cut(wanted, "simhash-wanted"))
    return base.join(wanted, base["doc_id"].eqNullSafe(wanted["d"]) & (base["mark"] == wanted["m"])).drop("doc_id", "mark", "d", "m")


def _arrays(column) -> list[np.ndarray]:
    """The lists of shingles of an Arrow column."""
    flat, ends = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _keyed(base: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """key, node: the first shingles of every node (node, first, size, keys), those of very many nodes put last.

    Shingles are counted over the reach that every node has in ``keys``, so what is counted is a share of all
    shingles whatever the size of the corpus. Where too much of its reach is put last, as in a template's texts, a
    node's whole set is read, and counted too: what such texts share would else take the place of what was put last.
    """
    reach = nodes.select("node", "size", "keys")
    spark = base.sparkSession

    def common(keys):
        return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY)

    def most(counts, n):
        return cut(counts.orderBy(F.desc("n"), "key").limit(n), "simhash-heavy")

    def hashes(counts):
        return counts.select("key").toArrow().column(0).to_numpy().view(np.uint64)

    def whole(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), _lists([shingle_set(t, words) for t in b.column(0).to_pylist()])], names=["node", "shingles"])

    def sets_of(some):
        texts = _read(base, nodes.select("node", "first").join(sized(some, NARROW_ROWS), "node", "left_semi"))
        return cut(texts.select("text", "node").mapInArrow(whole, "node long, shingles array<long>"), "simhash-whole")

    def in_reach(batches, late):
        for b in pieces(batches):
            sizes = b.column(1).to_pylist()
            yield b.column(0), [first_in_reach(x, n, least, late.value) for x, n in zip(_arrays(b.column(2)), sizes, strict=True)]

    def short_of(late):
        def run(batches):
            for node, found in in_reach(batches, late):
                yield pa.RecordBatch.from_arrays([node.filter(pa.array([x is None for x in found], pa.bool_()))], names=["node"])

        return run

    def first_of(late):
        def run(batches):
            for node, found in in_reach(batches, late):
                lists = _lists([np.zeros(0, np.uint64) if x is None else x for x in found])
                yield pa.RecordBatch.from_arrays([node, lists, pa.array([x is None for x in found], pa.bool_())], names=["node", "keys", "short"])

        return run

    def first_of_whole(late):
        def run(batches):
            for b in pieces(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([first_shingles(x, least, late.value) for x in _arrays(b.column(1))])], names=["node", "keys"])

        return run

    heavy = most(common(reach.select(F.explode("keys").alias("key"))), HEAVY_KEYS)
    late, sets = spark.sparkContext.broadcast(np.sort(hashes(heavy))), None
    short = cut(reach.mapInArrow(short_of(late), "node long"), "simhash-short") if len(late.value) else None
    if short is not None and not short.isEmpty():
        sets = sets_of(short)
        others = common(sets.select(F.explode("shingles").alias("key"))).join(sized(heavy.select("key"), NARROW_ROWS), "key", "left_anti")
        late = spark.sparkContext.broadcast(np.sort(np.concatenate((late.value, hashes(most(others, HEAVY_KEYS - len(late.value)))))))
    firsts = cut(reach.mapInArrow(first_of(late), "node long, keys array<long>, short boolean"), "simhash-firsts")
    keys = firsts.select("node", "keys")
    if sets is not None:
        # others of which too much is put last now
        more = cut(firsts.filter("short").select("node").join(sized(short, NARROW_ROWS), "node", "left_anti"), "simhash-short")
        sets = sets if more.isEmpty() else sets.unionByName(sets_of(more))
        keys = keys.unionByName(cut(sets.mapInArrow(first_of_whole(late), "node long, keys array<long>"), "simhash-rekeyed"))
    return keys.select(F.explode("keys").alias("key"), "node")


def _close(fps, table, a, b, radius, sets=None, least=0.0):
    """Of the pairs (a, b): discard by coordinates, one pivot after another, then compare bits, then sets if there are any."""
    for p in range(table.shape[1]):
        near = np.abs(table[a, p] - table[b, p]) <= radius
        if not near.all():
            a, b = a[near], b[near]
    near = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int32) <= radius
    a, b = a[near], b[near]
    if sets is not None:
        near = np.array([alike(sets[i], sets[j], least) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[near], b[near]
    return a, b


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets share so much of what either has; two empty sets do."""
    small, large = sorted((len(x), len(y)))
    if small < least * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _table(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(n, -1)


def _sets(columns) -> list | None:
    return [np.frombuffer(x, "<u8") for c in columns for x in c.to_pylist()] or None


def _close_rows(b, mine: list[int], theirs: list[int], width: int, radius: int, least: float) -> np.ndarray:
    """Rows of a batch whose two ends (columns of fp, pivots and, if any, shingles) are close."""
    n = b.num_rows
    if not n:
        return np.zeros(0, np.int64)
    fps, table = (np.concatenate([f(b.column(e[i])) for e in (mine, theirs)]) for i, f in ((0, lambda c: _words(c, width)), (1, lambda c: _table(c, n))))
    return _close(fps, table, np.arange(n), np.arange(n) + n, radius, _sets([b.column(e[2]) for e in (mine, theirs) if len(e) > 2]), least)[0]


def _check_pairs(batches, width: int, radius: int):
    """Rows (u, v, fp, pivots, fp2, pivots2) -> the pairs within the radius."""
    for b in batches:
        at = pa.array(_close_rows(b, [2, 3], [4, 5], width, radius, 0.0))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["u", "v"])


def _from_heads(batches, width: int, radius: int, least: float):
    """Rows (key, u, node, head's fp, pivots[, shingles], own fp, pivots[, shingles]) -> key, u, node, near."""
    for b in batches:
        ends = (b.num_columns - 3) // 2
        near = np.zeros(b.num_rows, bool)
        near[_close_rows(b, [*range(3, 3 + ends)], [*range(3 + ends, 3 + 2 * ends)], width, radius, least)] = True
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near)], names=["key", "u", "node", "near"])


def _probe(node, loose, probes, base, fps, table, radius, sets=None, least=0.0):
    """Links (a, b) between ``probes`` and ``base`` (positions of rows): enough to connect, given that rows of the base that are not loose are connected."""
    part = np.where(loose[base], np.arange(len(base)) + 1, 0)
    place = {x: i for i, x in enumerate(node[base].tolist())}
    out, more = [], len(base) + 1
    for p in probes.tolist():
        own = place.get(int(node[p]))
        mine, more = (more, more + 1) if own is None else (int(part[own]), more)
        _, hit = _close(fps, table, np.full(len(base), p), base, radius, sets, least)
        at = np.searchsorted(base, hit)
        at = at[(part[at] != mine) & (node[hit] != node[p])]
        met, first = np.unique(part[at], return_index=True)
        out += [(p, base[at[i]]) for i in first]
        part[np.isin(part, [*met, mine])] = min([mine, *met])
    return out


def _compare(batches, width: int, radius: int, least: float):
    """Rows (key, i, j, probe, loose, node, fp, pivots[, shingles]), sorted by the first three, which make a group -> links."""
    held = None

    def out(rows):
        group = np.stack([rows.column(i).to_numpy() for i in range(3)], axis=1)
        probe, loose = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        node, n = rows.column(5).to_numpy(), rows.num_rows
        fps, table, sets = _words(rows.column(6), width), _table(rows.column(7), n), _sets(rows.columns[8:])
        starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1))))
        sizes = np.diff(np.append(starts, n))
        own, few = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= FEW, sizes)
        links = []
        for lag in range(1, min(FEW, n)):  # all small groups at once
            a = np.flatnonzero((own[:-lag] == own[lag:]) & few[:-lag] & (probe[:-lag] != probe[lag:]) & (node[:-lag] != node[lag:]))
            if len(a):
                a, b = _close(fps, table, a, a + lag, radius, sets, least)
                links += zip(a.tolist(), b.tolist(), strict=True)
        for lo, hi in zip(starts[sizes > FEW], (starts + sizes)[sizes > FEW], strict=True):
            at = np.arange(lo, hi)
            links += _probe(node, loose, at[probe[lo:hi]], at[~probe[lo:hi]], fps, table, radius, sets, least)
        return pa.RecordBatch.from_arrays([pa.array([int(node[x[i]]) for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = np.stack([held.column(i).to_numpy() for i in range(3)], axis=1)
        last = int(np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))[-1])
        if last:  # the last group may go on in the next batch
            yield out(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None:
        yield out(held.combine_chunks())


def _in_crowds(rows: DataFrame, block: int, width: int, radius: int, least: float = 0.0) -> DataFrame:
    """u, v: links that connect what is close within each key of ``rows`` (written; key, n, u, node, fp, pivots[, shingles]).

    u is one of the key's nodes, its head, and n at least their number. What is close to the head is linked to
    it; the rest, if any, is compared with all rows of its key.
    """
    ends = [c for c in rows.columns if c not in ("key", "n", "u", "node")]
    heads = cut(rows.filter("node = u").select("key", "n", "u", *[F.col(c).alias(f"head_{c}") for c in ends]).dropDuplicates(["key"]), "simhash-heads")
    star = meet(rows.filter("node <> u").select("key", "node", *ends), heads, "key").select("key", "u", "node", *[f"head_{c}" for c in ends], *ends)
    star = cut(star.mapInArrow(lambda it: _from_heads(it, width, radius, least), "key long, u long, node long, near boolean"), "simhash-star")
    links, loose = star.filter("near").select("u", F.col("node").alias("v")), star.filter("NOT near").select("key", "node").distinct()
    left = cut(loose.groupBy("key").agg(F.count(F.lit(1)).alias("r")), "simhash-loose")
    if left.isEmpty():
        return links
    left = cut(meet(heads.select("key", "n"), left, "key", "r"), "simhash-loose")
    open_ = meet(rows.select("key", "node", *ends), left, "key").join(loose.withColumn("loose", F.lit(True)), ["key", "node"], "left").withColumn("loose", F.col("loose").isNotNull())
    of = lambda n: F.ceil(F.col(n) / block)
    own = lambda n: F.pmod(F.xxhash64("node"), of(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), of(n) - 1))
    probes = open_.filter("loose").select("key", own("r").alias("i"), all_of("n").alias("j"), F.lit(True).alias("probe"), "loose", "node", *ends)
    base = open_.select("key", all_of("r").alias("i"), own("n").alias("j"), F.lit(False).alias("probe"), "loose", "node", *ends)
    groups = probes.unionByName(base).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.unionByName(groups.mapInArrow(lambda it: _compare(it, width, radius, least), "u long, v long"))


def link(nodes: DataFrame, keyed: DataFrame, width: int, radius: int) -> DataFrame:
    """u, v: links between ``nodes`` (node, fp, pivots) that share a key (``keyed``: key, node) and differ in at most ``radius`` bits; enough of them to connect each group."""
    mixed = F.xxhash64("node")
    met = keyed.groupBy("key").agg(
        F.min("node").alias("u"), F.max("node").alias("v"), F.count(F.lit(1)).alias("n"),
        F.sum(mixed.bitwiseAND(F.lit(0x7FFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(mixed, 33)).alias("high"),
    )
    met = cut(met.filter("u <> v"), "simhash-met")
    # most keys that are shared are shared by two: the aggregate has the pair, and rows don't move again
    pairs = met.filter("n = 2").select("u", "v").distinct()
    x, y = (nodes.select(F.col("node").alias(end), F.struct("fp", "pivots").alias(f"{end}_row")) for end in "uv")
    both = pairs.join(x, "u").join(y, "v").select("u", "v", "u_row.fp", "u_row.pivots", F.col("v_row.fp").alias("fp2"), F.col("v_row.pivots").alias("pivots2"))
    links = both.mapInArrow(lambda it: _check_pairs(it, width, radius), "u long, v long")
    crowds = cut(met.filter("n > 2").groupBy("u", "v", "n", "low", "high").agg(F.min("key").alias("key")).select("key", "n", "u"), "simhash-crowds")  # of keys with the same rows one will do
    if crowds.isEmpty():
        return links
    crowded = meet(keyed, crowds, "key").select("key", "n", "u", "node").distinct()
    crowded = cut(crowded.join(nodes.select("node", "fp", "pivots"), "node").select("key", "n", "u", "node", "fp", "pivots"), "simhash-crowded")
    return links.unionByName(_in_crowds(crowded, BLOCK, width, radius))


def _resembling(base: DataFrame, nodes: DataFrame, placed: DataFrame, words: int, width: int, radius: int, least: float) -> DataFrame:
    """Links of at least ``least`` resemblance within the groups ``placed`` (node, root) of a wider radius.

    A node's shingles are read from its first document; only documents in such groups are read again.
    """
    placed = cut(placed, "simhash-wide")
    sizes = cut(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "simhash-sizes")
    wanted = nodes.join(meet(placed, sizes, "root"), "node").select("first", F.col("root").alias("key"), "n", F.col("root").alias("u"), "node", "fp", "pivots")

    def run(batches):
        for b in pieces(batches):
            sets = [shingle_set(t, words).astype("<u8").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.binary())], names=["key", "n", "u", "node", "fp", "pivots", "shingles"])

    rows = _read(base, wanted).select("text", "key", "n", "u", "node", "fp", "pivots")
    rows = cut(rows.mapInArrow(run, "key long, n long, u long, node long, fp binary, pivots binary, shingles binary"), "simhash-sets")
    return _in_crowds(rows, SET_BLOCK, width, radius, least)


def _pivots(batches, width: int):
    for b in batches:
        table = pivot_table(_words(b.column(1), width)).astype("<i2") if b.num_rows else np.zeros((0, PIVOTS), "<i2")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in table], pa.binary())], names=[*b.schema.names, "pivots"])


_FIRST = "struct<last:boolean,doc_id:bigint,mark:bigint>"


def _grouped(docs: DataFrame, words: int, radius: int, similarity: float | None, width: int, id_col: str, text_col: str, slack: float | None = SLACK) -> DataFrame:
    """doc_id, mark, fp, first (the least document of the group, by id, nulls last, and text hash) of every row."""
    base = _base(docs, id_col, text_col)
    if similarity is None:
        width = 1
        marked = cut(fingerprints(base, words, width), "simhash-docs")
    else:
        share = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of bits that differ at the threshold
        radius = 64 * width if slack is None else math.ceil(64 * width * share + slack * math.sqrt(64 * width * share * (1 - share)))
        marked = cut(shingled(base, words, width, similarity), "simhash-docs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    keys = [] if similarity is None else [F.any_value(c).alias(c) for c in ("size", "keys")]  # the same in all of a node's documents
    nodes = marked.groupBy("node", "fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), *keys)
    nodes = nodes.select("node", "fp", F.col("first").cast(_FIRST), "copies", *(["size", "keys"] if keys else []))
    nodes = cut(nodes.mapInArrow(lambda it: _pivots(it, width), f"node long, fp binary, first {_FIRST}, copies long, {'size long, keys array<long>, ' if keys else ''}pivots binary"), "simhash-nodes")
    if similarity is None:
        placed = components(link(nodes, _segments(nodes, radius), width, radius))
    else:
        placed = components(link(nodes, _keyed(base, nodes, words, similarity), width, radius))
        placed = components(_resembling(base, nodes, placed, words, width, radius, similarity))
    placed = cut(placed, "simhash-placed")
    labels = cut(nodes.select("node", "first").join(placed, "node").groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-labels")
    named = nodes.select("node", "first", "copies").join(meet(placed, labels, "root").select("node", "least"), "node", "left")
    named = cut(named.select("node", F.coalesce("least", "first").alias("first"), "copies"), "simhash-named")
    return meet(marked.select("doc_id", "mark", "node", "fp"), named, "node", "copies").select("doc_id", "mark", "fp", "first")


def _segments(nodes: DataFrame, radius: int) -> DataFrame:
    keys = segment_keys(radius, nodes.count())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                k = keys(_words(part.column(1), 1))
                node = np.repeat(part.column(0).to_numpy(), k.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64), pa.int64()), pa.array(node, pa.int64())], names=["key", "node"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long")


def simhash_groups(
    docs: DataFrame, words: int = 3, radius: int = 3, similarity: float | None = None, width: int = 4, id_col: str = "doc_id", text_col: str = "text", slack: float | None = SLACK
) -> DataFrame:
    """doc_id, fp (binary, little-endian words), component_id of every row of ``docs``; other columns are not read.

    Without ``similarity``: 64-bit fingerprints of shingles of ``words`` words, linked at ``radius`` or fewer
    differing bits, all links found. With it: linked where the shingle sets resemble each other by at least
    ``similarity``. All such pairs share a key and are compared, but for those whose fingerprints of ``width``
    words lie ``slack`` standard deviations beyond what the threshold stands for (none with ``slack`` None: then
    every pair that shares a key is compared); there are no false links.

    component_id is the smallest doc_id reachable (nulls come last; null if all are). Null and empty texts
    have fingerprint zero and are linked like others. Rows with equal texts, or equal ids, get a row each.
    """
    return _grouped(docs, words, radius, similarity, width, id_col, text_col, slack).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each group of near-duplicates keeps one: the one with the smallest id.

    Groups are those of ``simhash_groups`` with ``similarity``. Id and text together name a document: rows that
    share both stay or go together; null ids come last, and of equal ids the text with the smaller hash stays.
    """
    groups = _grouped(docs, words, 0, similarity, width, id_col, text_col)
    gone = groups.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))))
    gone = sized(cut(gone.select(F.struct("doc_id", "mark").alias("gone")).distinct(), "simhash-gone"))
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["gone.doc_id"]) & (mark == gone["gone.mark"]), "left_anti")


def fingerprint_hex(fp):
    """16 lowercase hex digits, most significant first."""
    digits = F.lower(F.hex(fp))
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))])
