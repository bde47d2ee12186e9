"""The repair against all edits of short conversations, against a pass that settles nothing, and on odd rows."""

import hashlib
import itertools
import random
import re

import pytest

from foliospark.llm import conversations
from foliospark.llm.conversations import damage, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, present boolean, cost long, audit string, place long, blank boolean, cut_off boolean, edit string"
SPACES = " \t\n\x0b\f\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, True, 9, "KK", 3, True, True, "x")[:11] for r in rows], SCHEMA)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Least (cost, audit) and its turns, over every choice of edits with at most two inserts at each place."""
    kinds, best = faults(rows), None
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    edits = [[("D", 4, None)] + ([] if kinds[i] in ("blank", "duplicate") else [(k, c + 3 * (kinds[i] == "truncated"), t) for k, c, t in (("K", 0, (role, text)), ("R", 3, ("user", text)), ("R", 3, ("assistant", text)))])
             for i, (_, role, text) in enumerate(rows)]
    for chosen in itertools.product(*edits):
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i, roles in enumerate(more):
                cost, audit, turns = cost + 3 * len(roles), audit + "I" * len(roles), turns + [(r, "") for r in roles]
                if i < len(rows):
                    letter, price, turn = chosen[i]
                    cost, audit, turns = cost + price, audit + letter, turns + ([turn] if turn else [])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return best


def test_all_edits_of_short_conversations(spark):
    draw = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", "s"], ["One.", "Two?", "cut off", " \n", "One."]
    made = {k: [(i, draw.choice(roles[:3] if k % 3 else roles), draw.choice(texts)) for i in range(3 if k % 10 == 0 else draw.choice([1, 2]))] for k in range(90)}
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in repair(frame(spark, [(k, *r) for k, rows in made.items() for r in rows])).collect()}
    assert got == {k: brute(rows) for k, rows in made.items()}


def plain(rows):
    """The pass over whole layers, without settling: an independent and slow one, all paths kept as strings."""
    role_of, layer = {0: "user", 1: "user", 2: "assistant", 3: "user"}, {0: (0, "", ())}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def close(states):
        for _ in range(3):
            for q, (c, a, t) in list(states.items()):
                states[after[q]] = min(states.get(after[q], (10**9,)), (c + 3, a + "I", (*t, role_of[q] + ":")))
        return states

    layer = close(layer)
    for (_, role, text), kind in zip(rows, faults(rows), strict=True):
        new = {}
        for q, (c, a, t) in layer.items():
            ways = [(q, (c + 4, a + "D", t))]
            if kind in ("", "truncated"):
                late = 3 * (kind == "truncated")
                ways.append((after[q], (c + 3 + late, a + "R", (*t, f"{role_of[q]}:{text}"))))
                if (q, role[:1]) in keep:
                    ways.append((keep[q, role[:1]], (c + late, a + "K", (*t, f"{role}:{text}"))))
            for to, way in ways:
                new[to] = min(new.get(to, (10**9,)), way)
        layer = close(new)
    cost, audit, turns = min(layer[q] for q in (0, 3) if q in layer)
    return cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


@pytest.mark.parametrize("kinds", [("user", "assistant"), ("user", "assistant", "system"), ("system",), ("assistant", "tool"), ("system", "user")])
def test_long_conversations_settle_to_the_same(spark, kinds):
    draw = random.Random(len(kinds))
    rows = [(i, draw.choice(kinds), draw.choice(["fine %d.", "broken off %d", " "]).replace("%d", str(draw.randrange(500)))) for i in range(700)]
    got = repair(frame(spark, [(1, *r) for r in rows])).first()
    assert (got.cost, got.audit, got.repaired_sha256) == plain(rows)


def test_the_tail_stays_short():
    c = conversations._Conversation()
    for i in range(20_000):
        c.row(i, ("user", "assistant")[i % 2], f"Turn {i}.", False, False)
        assert len(c.rows) <= 2 * conversations.TAIL
    assert c.report()[5:7] == (0, "K" * 20_000)


def test_counts_and_turns(spark):
    rows = [(1, None, "user", "Nulls first."), (1, 2, "assistant", "Two."), (1, 2, "assistant", "Two."), (1, 6, None, "x."), (1, 7, "user", None), (2, None, "user", "A."), (2, None, "assistant", "B"), (None, 1, "system", "Only."), (None, 3, "user", "Q?")]
    got = {r.conv_id: r for r in repair(frame(spark, rows)).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (3, 1, 1, 0, 3)
    assert got[2].gaps == 0 and got[2].truncated == 1 and (got[2].illegal, got[2].audit) == (0, "DKI")  # by role
    assert (got[None].gaps, got[None].cost, got[None].audit) == (1, 3, "KKI")
    turns = sorted((r.conv_id or 0, r.place, r.edit, r.role, r.text) for r in repaired_turns(frame(spark, rows)).collect())
    for key, mine in itertools.groupby(turns, lambda t: t[0]):
        whole = "\n".join(f"{t[3]}:{t[4]}" for t in mine)
        assert hashlib.sha256(whole.encode()).hexdigest() == got[key or None].repaired_sha256


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user", "Text. More!") for c in range(40) for t in range(3)] + [(7, 0, None, None)]
    made = damage(frame(spark, rows)).collect()
    assert {r.present for r in made} == {True, False} and any(r.text == "" for r in made) and any(r.text == "Text More" for r in made)
    assert {r.conv_id for r in repair(damage(frame(spark, rows)), present="present").collect()} == set(range(40))
    gone = damage(frame(spark, rows)).filter("NOT present")
    for r in repair(gone, present="present").collect():
        assert r[1:8] == (0, 0, 0, 0, 0, 0, "") and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table_long_text_and_repeats(spark):
    assert repair(frame(spark, [])).collect() == [] and repaired_turns(frame(spark, [])).collect() == []
    long = "word " * 400_000 + "."
    got = repair(frame(spark, [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)])).first()
    assert (got.audit, got.duplicate, got.cost) == ("KKD", 1, 4)
