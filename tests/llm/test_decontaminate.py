import random

from helpers import ODD, docs

from foliospark.llm.decontaminate import RUN, WINDOW, Template, consistent, contamination, decontaminate, windows


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


ITEM = "Natalia sold 48 clips to her friends in the month of April and then she sold half as many clips for 12 dollars in May to the other people of the old town"


def test_templates():
    form = Template("Tom has 5 apples. Then Tom gave Eve 1,250.5 kg of it, m")
    assert [x.split(":")[1] for x in form.slots(0, len(form))] == ["tom", "5", "tom", "eve", "1,250.5", "kg"]
    assert form.tokens(2, 2) == ["5", "apples"] and len(Template("")) == 0


def test_reparameterised_questions(spark):
    other = ITEM.replace("Natalia", "Emma").replace("48", "96").replace("12 dollars", "7 euros")
    mixed = ITEM.replace("48", "51")
    rows = [*ODD, (100, f"before. {ITEM}\nafter"), (101, f"some words here. {other} and more"), (102, mixed), (103, "only unrelated words " * 20), (104, " ".join(ITEM.split()[:9]) + " and nothing else of it at all"), (105, ITEM.upper())]
    got = {r["doc_id"]: r for r in contamination(docs(spark, rows), bench(spark, [(7, ITEM), (8, None), (None, ITEM), (9, "12 13 14"), (10, "")])).collect() if r["doc_id"]}
    assert all(got[i]["item_ids"] == [7] and got[i]["contaminated"] for i in (100, 101, 102))
    assert not any(got[i]["contaminated"] for i in (1, 2, 4, 6, 103, 104))


def test_inconsistent_slots():
    hit = lambda at, slots, filled: {"at": at, "slots": slots, "filled": filled}
    assert consistent([hit(0, ["number:3"], ["number:5"]), hit(1, ["number:3"], ["number:5"]), hit(2, ["number:3"], ["number:6"]), hit(3, [], [])]) == {0, 1, 3}
    assert consistent([hit(0, ["name:a", "name:b"], ["name:x", "name:x"])]) == set()


def test_occurrences_are_judged_on_their_own(spark):
    """Each window has both slots: a worksheet of variants must not mix the values of one with those of another."""
    item = "please add 3 and also 5 apples to it"
    other, moved = item.replace("3", "7").replace("5", "2"), "please add 9 and also 4 very big apples to it"
    long = "the pump of Weng fills 12 tanks and 30 buckets while the pump of Eve fills 9 tanks and 40 buckets in a day"
    spread = long.replace("12", "15").replace("30", "77").replace("and 40", "and quite some 40")
    rows = [(1, item), (2, other), (3, f"{item} . {other}"), (4, f"{other}\n{item}\n{moved}"), (5, f"{long} . {spread} . {spread.replace('15', '16').replace('77', '2')}"), (6, "please add 3 and also words of no use here")]
    got = {r["doc_id"]: (r["item_ids"], r["share"]) for r in contamination(docs(spark, rows), bench(spark, [(7, item), (8, long)])).collect()}
    assert all(got[i] == ([7], 1.0) for i in (1, 2, 3, 4)) and got[5] == ([8], 1.0) and got[6] == ([], 0.0)


def test_dense_items_and_excerpts(spark):
    dense, pair, prose = "What is 12 + 7 - 3 * 40?", "12 13 14", " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    w = prose.split()
    edits = " ".join("edit" if i in (9, 19, 29) else x for i, x in enumerate(w[:36])) + " " + " ".join(w[36:])
    rows = [
        (1, f"Well. {dense} Say"), (2, dense.replace("40", "41")), (3, "x 12 13 14 y"), (4, "12 13 15"), (5, "so " + " ".join(w[7:27]) + " end"), (6, " ".join(w[7:19])),
        (7, " ".join("edit" if i in (13, 27) else x for i, x in enumerate(w))), (8, "x " + edits),
    ]
    got = {r["doc_id"]: r["item_ids"] for r in contamination(docs(spark, rows), bench(spark, [(1, dense), (2, pair), (3, prose)]), run=RUN).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [3], 6: [], 7: [3], 8: []}


def test_against_brute_force(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    word = lambda: r.choice([*words, "17", "Bob", "Alice", "3 kg", "."])
    items = [(i, " ".join(word() for _ in range(r.randint(3, 40)))) for i in range(20)]
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(r.randint(0, 60)))
        if i % 3:
            part = items[i % 20][1].split()
            text += " ; " + " ".join(part[: max(1, int(len(part) * r.choice([0.3, 0.6, 1])))]).replace("17", "21").replace("Bob", "Tim") + " . " + text
        rows.append((i, text))

    def plain(text, size):
        form, out = Template(text), []
        tokens, kind = form.tokens(), form.kind.tolist()
        for at in windows(form.kind, form.hashes, size)[0].tolist():
            part = list(zip(tokens[at:at + size], kind[at:at + size], strict=True))
            out.append((at, tuple(f"#{k}" if k else t.lower() for t, k in part), [f"{k}:{t.lower()}" for t, k in part if k]))
        return out

    want = {}
    for d, t in rows:
        want[d] = []
        for i, it in items:
            size = min(WINDOW, len(Template(it)))
            own, there = plain(it, size), plain(t, size)
            hits = [{"at": a, "slots": s, "filled": f} for a, w, s in own for _, v, f in there if v == w]
            if own and len(consistent(hits)) / len(own) >= 0.5:
                want[d].append(i)
    got = {x["doc_id"]: x["item_ids"] for x in contamination(docs(spark, rows), bench(spark, items)).collect()}
    assert got == want and any(want.values())


def test_shuffled_windows_agree(spark, monkeypatch):
    frame, items = docs(spark, [(1, ITEM), (2, "x y z " * 9)]), bench(spark, [(7, ITEM)])
    monkeypatch.setattr("foliospark.llm.decontaminate.ARRAY_WINDOWS", 0)
    assert {x["doc_id"]: x["contaminated"] for x in contamination(frame, items).collect()} == {1: True, 2: False}


def test_rows_and_columns_stay(spark):
    frame = docs(spark, [*ODD, (50, ITEM)])
    out = decontaminate(frame, bench(spark, [(7, ITEM)]))
    assert out.columns == frame.columns and out.count() == len(ODD)
    assert decontaminate(frame, bench(spark, [])).count() == len(ODD) + 1
    assert decontaminate(docs(spark, []), bench(spark, [(7, ITEM)])).collect() == []
