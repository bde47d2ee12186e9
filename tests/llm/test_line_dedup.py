import random

from helpers import ODD, docs

from foliospark.llm.line_dedup import WHOLE, _Keys, _squeeze, dedup_lines, segments, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, line, n):
    w = list(line)
    for _ in range(n):
        at = r.randrange(len(w))
        kind = r.choice("sid")
        if kind == "d":
            del w[at]
        else:
            w[at:at + (kind == "s")] = [r.choice("abé ")]
    return "".join(w)


def test_banded_distance():
    r = random.Random(1)
    for _ in range(20_000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        b = edited(r, a, r.randint(0, 4)) if len(a) > 4 else "".join(r.choice("abc") for _ in range(r.randint(0, 5)))
        for k in (0, 1, 2, 3):
            assert within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_keys_lose_no_pair():
    r = random.Random(2)
    assert segments(11, 2) == [(0, 3), (3, 7), (7, 11)]
    for k in (1, 2, 3):
        keys = _Keys(k)
        for _ in range(4000):
            a = "".join(r.choice("ab é") for _ in range(r.randint(8, 40)))
            b = edited(r, a, r.randint(0, k))
            assert {*keys.of(a)} & {*keys.of(b)}, (a, b, k)


def test_splits_lose_no_pair():
    """Lines within edits that share a key share another one around it."""
    r = random.Random(7)
    keys = _Keys(2)
    for _ in range(3000):
        a = "".join(r.choice("ab é") for _ in range(r.randint(25, 60)))
        b = edited(r, a, r.randint(1, 2))
        shared = {*keys.of(a)} & {*keys.of(b)}
        again = lambda x, key: {k for left in keys.around(x, [key]) for k in keys.of(left)}
        assert any(again(a, key) & again(b, key) for key in shared), (a, b)


def brute(rows, edits=2):
    lines = [(i is None, i or 0, p, n, _squeeze(x)) for n, (i, t) in enumerate(rows) for p, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[4]) >= 25]
    texts = sorted({x[4] for x in lines})
    label = {t: t for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= 40 and distance(a, b) <= edits:
                old, new = label[a], label[b]
                label = {t: new if v == old else v for t, v in label.items()}
    first = {}
    for x in sorted(lines, key=lambda x: x[:3]):
        first.setdefault(label[x[4]], x[:3])
    gone = {(x[3], x[2]) for x in lines if first[label[x[4]]] != x[:3]}
    return sorted(((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (n, p) not in gone)) for n, (i, t) in enumerate(rows)), key=repr)


def sample(n, seed=7):
    r = random.Random(seed)
    line = lambda k: "".join(r.choice("abcdefgh é") for _ in range(k))
    pool = [line(r.choice([10, 24, 25, 30, 39, 40, 41, 60, 120])) for _ in range(25)]
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(edited(r, r.choice(pool), r.choice([0, 0, 1, 2, 3])) if r.random() < 0.7 else line(r.randint(1, 80)) for _ in range(r.randint(1, 6)))))
    return rows


def test_against_brute_force(spark):
    rows = sample(150) + [(None, "x" * 50), (9001, None), (9002, "")]
    out = dedup_lines(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, out), key=repr) == brute(rows)


def test_short_lines(spark):
    """Equal lines of any length go, and lines of 25 to 39 characters within two edits."""
    rows = [(1, "Menu\nLicensed under CC BY-NC 4.0.\n\nfirst"), (2, "Menu\nLicensed under CC BY-NC 3.0\n\nx"), (3, " Menu \nx\n\nLicenced under CC BY-NC 4.0.\nMenus"), (4, "\n")]
    got = dict(dedup_lines(docs(spark, rows), **WHOLE).select("doc_id", "text").collect())
    assert got == {1: rows[0][1], 2: "\nx", 3: "\nMenus", 4: "\n"}


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr("foliospark.llm.line_dedup.BLOCK", 8)
    r = random.Random(3)
    stem = "".join(r.choice("abcdefgh ") for _ in range(50))
    rows = [(i, stem + "".join(r.choice("xyz") for _ in range(4))) for i in range(80)]
    out = dedup_lines(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, out), key=repr) == brute(rows)


def test_split_crowds(spark, monkeypatch):
    """Beyond every bound: crowds are split twice, nothing is broadcast, hubs are joined apart."""
    monkeypatch.setattr("foliospark.llm.line_dedup.BLOCK", 8)
    monkeypatch.setattr("foliospark.llm.line_dedup.SPLIT", 10)
    monkeypatch.setattr("foliospark.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr("foliospark.llm.common.HUB", 6)
    r = random.Random(3)
    stem = "".join(r.choice("abcdefgh ") for _ in range(20))
    rows = [(i, stem + "".join(r.choice("xy") for _ in range(r.randint(19, 21))) + "z" * 4) for i in range(60)] + [(100 + i, stem + "x" * 25) for i in range(40)]
    out = dedup_lines(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, out), key=repr) == brute(rows)


def test_names_that_clash(spark):
    frame = docs(spark, [(1, "a line that two have in common"), (2, "a line that two have in common")]).selectExpr("*", "'KEEP' AS __gone", "1 AS lines", "2 AS _lines", "3 AS gone", "4 AS mark")
    rows = dedup_lines(frame, counts=True).orderBy("doc_id").collect()
    assert [(r["text"], r["__gone"], r["lines"], r["_lines"], r["gone"], r["mark"], r["n_removed"]) for r in rows] == [("a line that two have in common", "KEEP", 1, 2, 3, 4, 0), ("", "KEEP", 1, 2, 3, 4, 1)]


def test_odd_rows(spark):
    frame = docs(spark, ODD)
    out = dedup_lines(frame, counts=True)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"] and out.count() == len(ODD)
    assert dedup_lines(docs(spark, [])).collect() == []
