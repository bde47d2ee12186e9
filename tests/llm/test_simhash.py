import math
import random

import numpy as np
import xxhash
from helpers import ODD, docs
from pyspark.sql import functions as F

from foliospark.llm import simhash
from foliospark.llm.components import components
from foliospark.llm.simhash import _probe, first_shingles, fingerprint_hex, near_dedup, pivot_table, segment_keys, shingle_set, simhash_groups


def plain(text, words=3):
    w = [x for x in (text or "").encode().lower().split()]
    s = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    fps = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def sample(n, seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    rows, bases = list(ODD), [[r.choice(vocabulary) for _ in range(r.randint(3, 90))] for _ in range(12)]
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((1000 + i, " ".join(w).upper() if i % 5 == 0 else "\n ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = sample(300)
    got = simhash_groups(docs(spark, rows)).select("doc_id", fingerprint_hex("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_large_buckets(spark, monkeypatch):
    """Blocks of a few rows: groups are compared across blocks, in forests."""
    monkeypatch.setattr("foliospark.llm.simhash.BLOCK", 20)
    rows = sample(500, 3)
    got = simhash_groups(docs(spark, rows)).select("doc_id", fingerprint_hex("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_keys_lose_no_pair():
    r = np.random.default_rng(1)
    for rows in (10, 1 << 20, 1 << 30):
        keys = segment_keys(3, rows)
        a = r.integers(0, 1 << 64, (300, 1), dtype=np.uint64)
        flip = np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, 3, replace=False).astype(np.uint64)) for _ in a])[:, None]
        assert (keys(a) == keys(a ^ flip)).any(axis=1).all()


def test_probes_connect_what_links():
    r = np.random.default_rng(2)
    fps = r.integers(0, 1 << 64, (20, 1), dtype=np.uint64)
    fps = np.concatenate([fps ^ (np.uint64(1) << np.uint64(i)) for i in range(5)])
    node, every = np.arange(100), np.arange(100)
    links = _probe(node, np.ones(100, bool), every, every, fps, pivot_table(fps), 2)
    assert len(links) == 80 and all(a % 20 == b % 20 for a, b in links)
    tied = _probe(node, every % 20 > 0, every[every % 20 == 1], every, fps, pivot_table(fps), 2)
    assert len(tied) == 4 and {int(a % 20) for a, _ in tied} == {1}


def test_first_shingles_meet():
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.integers(1, 60))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[r.random(len(x)) < 0.9], r.integers(0, 1 << 63, int(r.integers(0, 4))).astype(np.uint64))))
        heavy = np.sort(r.choice(x, len(x) // 2, replace=False))
        if len(both := np.intersect1d(x, y)) >= 0.8 * (len(x) + len(y) - len(both)):
            for late in (None, heavy):
                assert len(np.intersect1d(first_shingles(x, 0.8, late), first_shingles(y, 0.8, late)))


def jaccard_groups(rows, words, least):
    sets = [set(shingle_set(t, words).tolist()) for _, t in rows]
    label, close = list(range(len(rows))), set()
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                close.add((rows[j][0], rows[i][0]))
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {x: min((d is None, d or 0) for (d, _), y in zip(rows, label, strict=True) if y == x) for x in set(label)}
    return sorted(((d, first[x][1] if not first[x][0] else None) for (d, _), x in zip(rows, label, strict=True)), key=repr), close


def edited(r, n, most):
    """Families of texts with more and fewer edits, so that resemblances spread around 0.8, and short texts."""
    rows = list(ODD)
    for g in range(n):
        w = [f"w{r.randrange(9000)}" for _ in range(r.choice([6, 8, 9, 12, 30, 120, 200]))]
        rows.append((10_000 + 10 * g, " ".join(w)))
        for c in range(1, r.randint(2, 6)):
            v = list(w)
            for _ in range(r.randint(1, max(1, int(len(v) * most)))):
                v[r.randrange(len(v))] = f"v{r.randrange(9000)}"
            if c % 2:
                v = v[:-1]
            rows.append((10_000 + 10 * g + c, " ".join(v)))
    return rows


def test_similarity_against_brute_force(spark):
    """Every pair at 0.8 or more, many just above, is in one group; there are no other groups."""
    rows = edited(random.Random(12), 120, 0.03)
    want, close = jaccard_groups(rows, 5, 0.8)
    got = simhash_groups(docs(spark, rows), words=5, similarity=0.8).select("doc_id", "component_id").collect()
    assert len(close) > 100 and sorted(map(tuple, got), key=repr) == want
    kept = {r["doc_id"] for r in near_dedup(docs(spark, rows)).collect()}
    assert kept == {c for _, c in want}


def test_common_passage(spark, monkeypatch):
    """A passage that most documents share is put last in the order; copies among them are still found."""
    monkeypatch.setattr("foliospark.llm.simhash.HEAVY", 10)
    monkeypatch.setattr("foliospark.llm.common.HUB", 5)
    monkeypatch.setattr("foliospark.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr("foliospark.llm.simhash.SET_BLOCK", 7)
    r = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(d, f"{t} {passage}" if d and d % 3 else t) for d, t in edited(r, 40, 0.03)[len(ODD):]]
    rows += [(90_000 + i, passage + f" x{i % 7}") for i in range(40)]
    want, _ = jaccard_groups(rows, 5, 0.8)
    got = simhash_groups(docs(spark, rows), words=5, similarity=0.8).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_templates_propose_pairs_in_proportion(spark, monkeypatch):
    """Texts that share a form and fill it with their own words: what is proposed grows with the texts, and copies among them are found."""
    monkeypatch.setattr("foliospark.llm.simhash.HEAVY", 32)
    proposed, plain = [], simhash.link

    def link(nodes, keyed, width, radius):
        n = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        proposed.append(n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0])
        return plain(nodes, keyed, width, radius)

    monkeypatch.setattr("foliospark.llm.simhash.link", link)
    r = random.Random(9)
    form = [f"form{i}" for i in range(60)]
    for n in (300, 1200):
        rows = [(i, " ".join(form[:30] + [f"own{r.randrange(10**6)}" for _ in range(22)] + form[30:])) for i in range(n)]
        rows += [(10**6 + i, rows[i][1]) for i in range(n)] + [(2 * 10**6 + i, rows[i][1] + " more") for i in range(0, n, 10)]
        got = {x["doc_id"]: x["component_id"] for x in simhash_groups(docs(spark, rows), words=5, similarity=0.8).collect()}
        assert got == {d: d % 10**6 for d, _ in rows}
    assert proposed[1] <= 6 * proposed[0]  # four times the texts


def test_first_shingles_in_reach():
    """Of a set's least hashes: its first shingles if they hold them all, else nothing; never others."""
    r = np.random.default_rng(7)
    for _ in range(400):
        x = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 60))).astype(np.uint64))
        heavy = np.sort(r.choice(x, int(len(x) * r.random()), replace=False))
        reach = x[:math.ceil(simhash.REACH * simhash.first_count(len(x), 0.8))]
        got, want = simhash.first_in_reach(reach, len(x), 0.8, heavy), first_shingles(x, 0.8, heavy)
        if got is None:
            assert not np.isin(want, reach).all() or np.isin(want, heavy).any()
        else:
            assert got.tolist() == want.tolist()


def test_common_phrase_reads_no_whole_set(spark, monkeypatch):
    """Texts that share one of their first shingles with very many: it is put last, and only texts that a template gives most of are counted whole."""
    monkeypatch.setattr("foliospark.llm.simhash.HEAVY", 32)
    whole, most, plain, link = [0], [], simhash.cut, simhash.link

    def cut(df, name):
        out = plain(df, name)
        if name == "simhash-whole":
            whole.append(out.count())
        return out

    def counted(nodes, keyed, width, radius):
        most.append(keyed.groupBy("key").count().agg(F.max("count")).first()[0])
        return link(nodes, keyed, width, radius)

    monkeypatch.setattr("foliospark.llm.simhash.cut", cut)
    monkeypatch.setattr("foliospark.llm.simhash.link", counted)
    r = random.Random(10)
    phrase = next(p for p in (f"p{i} is what all say" for i in range(10**6)) if shingle_set(p, 5)[0] < 1 << 57)  # among the first of any text
    rows = [(i, " ".join(f"own{r.randrange(10**6)}" for _ in range(60)) + f" {phrase}") for i in range(300)]
    rows += [(10**6 + i, rows[i][1] + " more") for i in range(0, 300, 10)]
    want = {d: d % 10**6 for d, _ in rows}
    assert {x["doc_id"]: x["component_id"] for x in simhash_groups(docs(spark, rows), words=5, similarity=0.8).collect()} == want
    assert sum(whole) == 0 and most[0] <= 32
    form = [f"form{i}" for i in range(60)]
    rows += [(1000 + i, " ".join(form[:30] + [f"own{r.randrange(10**6)}" for _ in range(10)] + form[30:])) for i in range(40)]
    want |= {1000 + i: 1000 + i for i in range(40)}
    assert {x["doc_id"]: x["component_id"] for x in simhash_groups(docs(spark, rows), words=5, similarity=0.8).collect()} == want
    assert sum(whole) == 40


def test_no_radius_at_all(spark):
    rows = edited(random.Random(3), 30, 0.04)
    want, _ = jaccard_groups(rows, 5, 0.8)
    got = simhash_groups(docs(spark, rows), words=5, similarity=0.8, slack=None).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_similarity(spark):
    r = random.Random(4)
    rows = []
    for g in range(25):
        w = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((10 * g, " ".join(w)))
        w[50] = "edit"
        rows.append((10 * g + 1, " ".join(w)))
        rows.append((10 * g + 2, " ".join(w[:60] + [f"v{r.randrange(5000)}" for _ in range(140)])))
    got = {x["doc_id"]: x["component_id"] for x in simhash_groups(docs(spark, rows), words=5, similarity=0.8).collect()}
    assert all(got[10 * g + 1] == 10 * g and got[10 * g + 2] == 10 * g + 2 for g in range(25))


def test_empty(spark):
    assert simhash_groups(docs(spark, [])).collect() == []
    assert simhash_groups(docs(spark, []), words=5, similarity=0.8).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, -5), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: -5, 201: -5, -5: -5}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
