import math
import random
import re

from helpers import ODD, docs
from pyspark.sql import functions as F

from foliospark.llm import mixing
from foliospark.llm.mixing import mix


def targets(sizes, share=1.5, cap=2.0):
    """Resharing as stated: the excess over the cap goes to the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, rest, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 60), None, r.choice(["a", "b", "hot", "hot", "hot", "ü", None])) for i in range(900)] + [(2000, "z " * 5000, None, "b")]
    got = mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _, _ in rows}
    by: dict = {}
    for i, _, _, s in rows:
        by[s] = by.get(s, 0) + size[i]
    want = targets(by)
    taken: dict = {}
    for g in got:
        assert g["size"] == size[g["doc_id"]] and g["source_size"] == by[g["source"]] and abs(g["target"] - want[g["source"]]) < 1e-6
        assert 0 <= g["taken"] <= 2 * g["size"] and g["taken"] == g["copies"] * g["size"]
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    for s in by:
        assert abs(taken[s] - want[s]) <= 60, (s, taken[s], want[s])
    assert sorted(map(tuple, mix(docs(spark, rows)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_chances(spark):
    """Equal documents are drawn about equally often over seeds."""
    rows = [(i, "a b c d", None, "s") for i in range(40)] + [(100 + i, "a b", None, "t") for i in range(80)]
    hits = [0] * 40
    for seed in range(12):
        for g in mix(docs(spark, rows), seed=seed, share=0.5).collect():
            if g["doc_id"] < 40:
                hits[g["doc_id"]] += g["copies"]
    assert 0 < sum(hits) < 480 and max(hits) <= 12 and len(set(hits)) > 2


def pareto(rows, target, cap=2.0):
    """Copies of one source's documents (u, size): expected copies by log size, whole ones certain, the rest by Pareto ranks, the end settled by what fits."""
    worth = [1 + math.floor(math.log2(n) * mixing.FINE) / mixing.FINE for _, n in rows]
    low, high = 0.0, cap + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap, level * w) * n for w, (_, n) in zip(worth, rows, strict=True)) < target else (low, level)
    odds = [min(cap, high * w) for w in worth]
    copies = [math.floor(o + 1e-9) for o in odds]
    due = target - sum(c * n for c, (_, n) in zip(copies, rows, strict=True))
    chance = {i: o - c for i, (o, c) in enumerate(zip(odds, copies, strict=True)) if o - c > 1e-6}
    rank = lambda i: (rows[i][0] / (1 - rows[i][0])) / (chance[i] / (1 - chance[i]))
    spare = []
    for i in sorted(chance, key=rank):
        if rows[i][1] <= due:
            due -= rows[i][1]
            copies[i] += 1
        else:
            spare.append(i)
    if spare and rows[i := min(spare, key=lambda i: rows[i][1])][1] - due < due:
        copies[i] += 1
    return copies


def test_pareto_by_hand(spark):
    r = random.Random(4)
    frame = docs(spark, [(i, "w " * int(2 ** r.uniform(0, 9)), None, "s") for i in range(150)] + [(500 + i, "w " * r.randint(1, 90), None, "t") for i in range(200)])
    draw = F.xxhash64(F.lit(42), "doc_id", F.lit(False), mixing.word_count(F.col("text")))
    u = {x["doc_id"]: x["u"] for x in frame.select("doc_id", ((F.shiftrightunsigned(draw, 11) + 0.5) / float(1 << 53)).alias("u")).collect()}
    got = mix(frame, share=0.7).collect()
    for source in "st":
        own = sorted((x for x in got if x["source"] == source), key=lambda x: x["doc_id"])
        assert [x["copies"] for x in own] == pareto([(u[x["doc_id"]], x["size"]) for x in own], own[0]["target"])
    short, long = ([x["copies"] for x in got if x["source"] == "t" and (x["size"] > 45) == big] for big in (False, True))
    assert sum(long) / len(long) > sum(short) / len(short)  # unequal odds


def test_ends_of_ranks(spark):
    """Few bins at a time and few last rows find the same end, up to what settles the sum."""
    r = random.Random(8)
    rows = [(s, r.randrange(1 << 52) if s else 7 + i % 3, r.randint(1, 50)) for s in range(3) for i in range(400)]
    drawn = spark.createDataFrame(rows, "rank long, key long, size long")
    due = spark.createDataFrame([(0, 900.0), (1, 5000.0), (2, 1e9)], "rank long, due double")
    for parts, last, after in ((1024, 4096, 256), (256, 8, 100)):
        found = mixing._cut_ranks(drawn, due, parts, last, after).collect()
        for s, want in ((1, 5000), (2, None)):
            own = [x for x in found if x["__rank"] == s]
            below = next(x["__at"] for x in own if x["__of_size"] == -1)
            taken = sum(n for a, k, n in rows if a == s and (k < below or any((x["__at"], x["__of_size"]) == (k, n) for x in own)))
            assert abs(taken - want) <= 25 if want else taken == sum(n for a, _, n in rows if a == s)


def test_names_that_clash(spark):
    frame = docs(spark, [(1, "a b c", None, "s"), (2, "d", None, None)]).selectExpr("*", "'KEEP' AS __id", "1 AS __rank", "2 AS __key", "3 AS __mix", "4 AS target")
    out = mix(frame, keep=True)
    assert {r["__id"] for r in out.collect()} == {"KEEP"} and {(r["__rank"], r["__key"], r["__mix"]) for r in out.collect()} == {(1, 2, 3)}
    assert out.columns == [c for c in frame.columns if c not in ("size", "target")] + ["size", "source_size", "target", "copies", "taken"]


def test_odd_rows(spark):
    got = mix(docs(spark, [(*r, None, "s" if i % 2 else None) for i, r in enumerate(ODD)])).collect()
    assert len(got) == len(ODD) and all(g["taken"] <= 2 * g["size"] for g in got)
    assert mix(docs(spark, [])).collect() == []
    assert [g["taken"] for g in mix(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]
