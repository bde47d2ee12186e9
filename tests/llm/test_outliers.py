"""Statistics against plain Python, estimates against a slow version in numpy, planted outliers, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, docs

from foliospark.llm import outliers
from foliospark.llm.outliers import judge

SPACE = re.compile("[\x20\x09-\x0d]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice(["a", "b", "B", "#", "|", "é", "😀", "7"]) * draw.randrange(1, 4) + draw.choice([" ", " ", "\n", "\t", "  ", " \r\n"]) for _ in range(draw.randrange(0, 120))) for _ in range(n)]


def test_counts(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(texts(3, 200))] + [(900, "a b c"), (901, "a a a a"), (902, "x a a a a"), (903, "a b a b a"), (904, "a a a"), (905, "line\nline \nline\n\n\n")]
    got = judge(docs(spark, rows), "doc_id").collect()
    want = sorted(((i is not None, i or 0), *plain(t)) for i, t in ((r[0], r[1]) for r in rows))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), *(r[c] for c in COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept != r.base_failed or r.distance is not None


def vector(text):
    words, chars, symbols, dups, repeated = plain(text)
    lines = sum(1 for x in text.split("\n") if SPACE.sub("", x))
    x = [np.log(chars / words), np.sqrt(symbols / (chars + 100)), np.sqrt(sum(c.isupper() for c in text) / (chars + 100)), np.sqrt(sum(c in "0123456789" for c in text) / (chars + 100)), np.sqrt(dups / (lines + 8)), np.sqrt(repeated / (words + 50))]
    return np.floor(np.array(x) * 1024 + 0.5) / 1024


def slow(x):
    """Squared distances of the rows of x by the module's definition, with whole matrices in numpy."""
    floor = np.diag(np.array(list(outliers.FLOOR.values())) ** 2)

    def estimate(rows, scale):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * scale + floor

    def away(fit):
        off = x - fit[0]
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(fit[1]), off)

    lower = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    middle = lower(x)
    ends = []
    for fit in ((middle, np.diag((1.4826 * lower(np.abs(x - middle))) ** 2) + floor), estimate(x, 1.0)):
        was = None
        for _ in range(outliers.STEPS):
            bins = np.floor(np.log2(away(fit) + 1e-9) * 64)
            edge = np.sort(bins)[int(np.ceil(outliers.SUPPORT * len(x))) - 1]
            new = estimate(x[bins <= edge], outliers._shrunk(outliers.SUPPORT))
            det = np.linalg.slogdet(new[1])[1]
            if was is not None and det >= was - outliers.LEAST_FALL:
                break
            fit, was = new, det
        ends.append((was, fit))
    raw = min(ends, key=lambda e: e[0])[1]
    return away(estimate(x[away(raw) <= outliers.quantile(0.025)], outliers._shrunk(0.975)))


def prose(draw, n, symbols=0.0, capitals=0.02):
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.choice([2, 3, 5, 6, 8]))) for _ in range(n)]
    return " ".join(w.upper() if draw.random() < capitals else w + "#$" if draw.random() < symbols else w for w in words)


def groups():
    draw = random.Random(8)
    rows = [(i, prose(draw, draw.randrange(50, 200)), "en", "web") for i in range(150)]
    rows += [(200 + i, prose(draw, draw.randrange(60, 200), 0.9), "en", "web") for i in range(30)]
    rows += [(300 + i, prose(draw, 90, 0.0, 0.9), "en", "web") for i in range(20)]
    rows += [(400 + i, prose(draw, 80, 0.3), None, "code") for i in range(120)]
    rows += [(600 + i, prose(draw, 80), "de", f"s{i % 3}") for i in range(130)]
    rows += [(800 + i, prose(draw, 80, 0.9), "fr", None) for i in range(5)]
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    return {r.doc_id: r for r in judge(docs(spark, groups()), "doc_id").collect()}


def test_estimates_against_a_slow_version(judged):
    rows, got = groups(), judged
    for where in (range(0, 400), range(400, 600), range(600, 800)):
        ids = [r[0] for r in rows if r[0] in where]
        x = np.array([vector(r[1]) for r in rows if r[0] in where])
        assert np.allclose([got[i].distance for i in ids], slow(x), rtol=1e-6)
    assert all(got[800 + i].distance is None and got[800 + i].kept for i in range(5))  # too few to judge


def test_planted_outliers_go_and_clean_documents_stay(judged):
    got = {i: r.kept for i, r in judged.items()}
    assert not any(got[200 + i] for i in range(30)) and not any(got[300 + i] for i in range(20))
    assert all(got[i] for i in range(150)) and all(got[400 + i] for i in range(120)) and all(got[600 + i] for i in range(130))


def test_copies_of_one_text_do_not_make_outliers_of_the_rest(spark):
    draw = random.Random(1)
    one = prose(draw, 100)
    rows = [(i, one, "en", "a") for i in range(300)] + [(i, prose(draw, draw.randrange(50, 300)), "en", "a") for i in range(300, 360)]
    assert all(r.kept for r in judge(docs(spark, rows), "doc_id").collect())


def test_empty_table_reruns_and_a_plan_without_python(spark, judged):
    assert judge(docs(spark, []), "doc_id").collect() == []
    df = judge(docs(spark, groups()).repartition(7), "doc_id")
    assert {r.doc_id: r for r in df.collect()} == judged
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_quantiles():
    assert abs(outliers.quantile(0.05) - 12.5916) < 1e-3 and abs(outliers.quantile(0.025) - 14.4494) < 1e-3  # of six degrees of freedom
