"""Learned operators: held-out accuracy on invented labelled texts, and defined results for odd rows."""

import random

from helpers import ODD, docs
from pyspark.sql import functions as F

from foliospark.llm import langid, quality, toxicity

R = random.Random(9)
SYLLABLES = {"aa": ["ka", "lo", "mi", "ten"], "bb": ["schu", "pfe", "grö", "zen"], "cc": ["é", "ux", "oir", "que"]}


def prose(lang, n):
    return " ".join("".join(R.choice(SYLLABLES[lang]) for _ in range(R.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_language(spark):
    rows = [(i, prose(lang := R.choice([*SYLLABLES]), R.randint(3, 60)), lang, "s") for i in range(300)]
    model = langid.fit(docs(spark, rows[:200]), sample=50)
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, rows[200:] + [(900, prose("aa", 60) + " " + prose("bb", 30), None, None)] + ODD), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[200:]) >= 98
    assert {*got[900]["langs"]} == {"aa", "bb"} and got[900]["lang_pred"] == "aa" and 0.55 < got[900]["score"] < 0.8
    assert (got[1]["lang_pred"], got[1]["score"]) == ("und", 0.0) and got[2]["lang_pred"] == got[10]["lang_pred"] == "und"


def test_language_without_rows(spark):
    model = langid.fit(docs(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, ODD), model).collect()} == {"und"}
    assert langid.identify(docs(spark, []), model).collect() == []


def test_linear_time_interactions():
    m = quality.FactorisationMachine()
    at, x = quality.features("Some words, SOME words 12 $$ and more")
    pairs = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.raw(at, x) - (m.bias + float(m.w[at] @ x) + pairs)) < 1e-4


def test_quality(spark):
    def text(good):
        body = prose("aa", R.randint(5, 80))
        return body if good else R.choice([" ".join(w.upper() + "!!" for w in body.split()), " | ".join(body.split()), " ".join([body.split()[0]] * 60), " ".join(w + "%%%" for w in body.split())])

    rows = [(i, text(i % 4 > 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows), labels, F.col("doc_id") < 300)
    frame = docs(spark, rows + [(i, t) for i, t in ODD if i != 4])
    out = quality.score_quality(frame, model)
    assert [*out.columns] == [c for c in frame.columns if c != "score"] + ["score"] and out.count() == frame.count()
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert sum((got[i] >= 0.7) == (i % 4 > 0) for i in range(300, 400)) >= 97
    assert all(0 <= s <= 1 for s in got.values())
    again = quality.fit(docs(spark, rows).repartition(3), labels, F.col("doc_id") < 300)
    assert abs(again.score(rows[0][1]) - model.score(rows[0][1])) < 1e-6


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, ODD), empty, F.lit(True))
    assert all(0.4 < r["score"] < 0.6 for r in quality.score_quality(docs(spark, ODD), model).collect())
    assert quality.score_quality(docs(spark, []), model).collect() == []


def test_toxicity(spark):
    def text(toxic):
        words = prose("aa", R.randint(20, 80)).split()
        for _ in range(3 if toxic else 0):
            words[R.randrange(len(words))] = R.choice(["idiot", "scum", "zorbel" + R.choice(["ka", "lo", "mi"]), "zorbelten"])
        return " ".join(words)

    rows = [(i, text(i % 5 == 0)) for i in range(500)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(500)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), labels, F.col("doc_id") < 380)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs(spark, rows + [(i, t) for i, t in ODD if i != 4]), model).collect()}
    assert sum((got[i] >= 0.7) == (i % 5 == 0) for i in range(380, 500)) >= 116
    assert all(0 <= s <= 1 for s in got.values()) and got[6] < 0.5


def test_clauses():
    g = toxicity.Grammar({}, {"zorb<": 2.0})
    names = lambda t: [toxicity.PATTERNS[p] for p, _ in g.clause(toxicity._TOKEN.findall(t))]
    assert names("you are an idiot") == ["insult at target"] and names("an idiot walks") == ["insult"]
    assert names("he is not an idiot") == ["negated insult"] and names("he said you idiot") == ["reported insult"]
    assert names("i will kill you") == ["threat at target"] and names("they never kill you") == ["negated threat"] and names("to kill time") == ["threat"]
    # order and scope
    assert names("you idiot said nothing") == ["insult at target"] and names("kill you not") == ["negated threat"]
    assert names("they are not stupid idiot and you moron will see") == ["negated insult", "negated insult", "insult at target"]
    assert names('she wrote "you moron" and the clown left') == ["reported insult", "insult"]
    assert names("kill the idiot") == ["threat at target", "insult"]
    assert g.clause(["zorbling"]) == [("P", 2.0)]
    assert g.insult("zorbling") == 2.0 and g.insult("orb") == g.insult("zorb") == g.insult("zorblingest") == 0.0


def by_hand(marks):
    """What the composed machine should write, from positions instead of states."""
    first, left, eaten = [], 0, set()
    for i, m in enumerate(marks):
        if m == "H" and not left:
            at = i + 1 + (marks[i + 1:i + 2] == "T")
            if marks[at:at + 1] == "N":
                eaten.add(at)
                m = "h"
        elif m in "IH" and left:
            m = m.lower()
        first.append(m)
        left = 0 if m in "CT" or i in eaten else toxicity.SCOPE if m == "N" else max(0, left - 1)
    second, speaking, quoting = [], False, False
    for m in first:
        if m == "Q":
            speaking, quoting = (True, True) if speaking and not quoting else (False, False)
        speaking = m == "R" or (speaking and (m != "C" or quoting))
        second.append({"I": "r", "H": "s"}.get(m, m) if speaking else m)
    out = ""
    for i, m in enumerate(second):
        if m in "irhs":
            out += m
        if m in "IH":
            before = "".join(second[max(0, i - toxicity.REACH):i])
            target = "T" in before.rpartition("C")[2]
            for n in second[i + 1:i + 1 + toxicity.REACH]:
                if n == "T" or (m, n) == ("H", "I"):
                    target = True
                if n in "TCIHirhs":
                    break
            out += {"I": "PA", "H": "UK"}[m][target]
    return out


def test_composition():
    r = random.Random(3)
    for _ in range(5000):
        marks = "".join(r.choices(toxicity.ALPHABET, (5, 4, 3, 3, 2, 2, 2, 4), k=r.randint(0, 14)))
        cascade = toxicity.targeted()(toxicity.reported()(toxicity.negation()(marks)))
        assert toxicity.grammar()(marks) == cascade == by_hand(marks), marks


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, ODD), empty, F.lit(True))
    assert model.score("you idiot. you moron. you scum.") > 0.7 > 0.5 > model.score("a clean text")
    assert toxicity.score_toxicity(docs(spark, []), model).collect() == []
