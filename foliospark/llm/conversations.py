"""Conversation structure repair: the cheapest edits that give a conversation's turns the shape (system)? (user assistant)+, or none.

A conversation's rows come sorted to one worker, which reads them as a stream and runs a forward Viterbi pass
over four states of the grammar: nothing yet, after system, after user, after assistant. Each state carries the
least (cost, audit string); a row is kept, given the one role that may follow, or deleted, and two rounds of
inserted turns close its layer (a third would come back to a state at a higher cost). Audit strings of one state
and layer that cost the same never are prefixes of each other, so the least string so far stays the least.

Every 64 rows what all live states agree on is settled: its rows leave memory, and its roles and texts go into
the digest. States that can only lose are dropped first, so a conversation of any length needs a short tail of
rows, its audit string and 16 bytes for each text seen. Its digest is sequential by contract: a conversation
cannot be dealt to several tasks, but it is never gathered either.

Defined results. Null roles and texts read as one space: such a text is blank, such a role is in no grammar. Rows
are taken by turn, nulls first, then role and text; a null conv_id is a conversation of its own. Of equal rows
all but the first are duplicates. Roles count by their first character. A conversation all of whose rows are
deleted, or that has none, has the digest of an empty string. An empty table has no conversations. Further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.llm.common import pieces, small_batches

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The state that the one role other than system leads to.
NEXT = (2, 2, 3, 2)
#: And where a kept row leads to, by state and the first character of its role.
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {2: "user", 3: "assistant"}
FOLLOW = {"su", "ua", "au"}
#: Rows after which what is certain is settled.
TAIL = 64
_SPACES = " \t\n\x0b\f\r"

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"


class _Conversation:
    """One conversation on its way through the layers."""

    def __init__(self, sink=None):
        self.layer = self._closed({0: (0, "")})
        self.rows, self.audit, self.state, self.place = [], [], 0, 0  # rows of the tail; letters, state and number of turns that are settled
        self.sha, self.sink = hashlib.sha256(), sink
        self.seen: set[bytes] = set()
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = None
        self.turns, self.before = 0, None

    @staticmethod
    def _closed(layer: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
        for _ in range(2):
            for q, (cost, audit) in list(layer.items()):
                made = (cost + INSERT, audit + "I")
                if made < layer.get(NEXT[q], (float("inf"), "")):
                    layer[NEXT[q]] = made
        return layer

    def row(self, turn, role: str, text: str, blank: bool, cut_off: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.before is not None and self.before + role[:1] not in FOLLOW:
            self.count["illegal"] += 1
        self.before = role[:1]
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if blank else "duplicate" if mark in self.seen else "truncated" if cut_off else None
        self.seen.add(mark)
        if fault:
            self.count[fault] += 1
        self._step(role, fault)
        self.rows.append((role, text))
        if len(self.rows) % TAIL == 0:
            self._settle()

    def _step(self, role: str, fault: str | None) -> None:
        layer: dict[int, tuple[int, str]] = {}
        more = CUT_OFF if fault == "truncated" else 0
        for q, (cost, audit) in self.layer.items():
            ways = [(q, cost + DELETE, "D")]
            if fault in (None, "truncated"):
                ways.append((NEXT[q], cost + REROLE + more, "R"))
                if (q, role[:1]) in KEEPS:
                    ways.append((KEEPS[q, role[:1]], cost + more, "K"))
            for to, price, letter in ways:
                if (price, audit + letter) < layer.get(to, (float("inf"), "")):
                    layer[to] = (price, audit + letter)
        self.layer = self._closed(layer)

    def _settle(self) -> None:
        """Take what all live states agree on out of the tail.

        All that can follow state 1 can follow state 3; what follows state 0 can follow state 3 if a system row is
        deleted instead of kept. So these states are dropped where they cost more, and 4 more.
        """
        best = self.layer.get(3, (float("inf"), ""))[0]
        self.layer = {q: x for q, x in self.layer.items() if q > 1 or x[0] <= best + (0 if q else DELETE)}
        sure = os.path.commonprefix([audit for _, audit in self.layer.values()])
        self._apply(sure)
        self.layer = {q: (cost, audit[len(sure):]) for q, (cost, audit) in self.layer.items()}

    def _apply(self, letters: str) -> None:
        at = 0
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.rows[at]
            at += letter != "I"
            if letter == "D":
                continue
            self.state = KEEPS[self.state, role[:1]] if letter == "K" else NEXT[self.state]
            role = role if letter == "K" else ROLE[self.state]
            self.sha.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
            if self.sink:
                self.sink(self.place, letter, role, text)
            self.place += 1
        self.audit.append(letters)
        del self.rows[:at]

    def report(self) -> tuple:
        cost, letters = min(self.layer[q] for q in (0, 3) if q in self.layer)
        self._apply(letters)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *(self.count[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, "".join(self.audit), self.sha.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows with faults put in by a hash of conv_id and turn; a dropped row stays, but not present.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes its closing marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.col("way") != 0, F.when(F.col("way") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("present"))


def _walk(conversations: DataFrame, present: str | None, schema: str, whole: bool) -> DataFrame:
    small_batches(conversations.sparkSession)
    text = F.coalesce("text", F.lit(" "))
    body = F.rtrim(text, F.lit(_SPACES))
    there: Column = F.lit(True) if present is None else F.col(present)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), there.alias("present"),
                                (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut_off"))
    # a conversation's rows meet in one partition, and come sorted: Spark spills, the worker holds no group
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def walk(batches):
        now, key, found = None, None, []

        def close():
            end = now.report()
            if not whole:
                found.append((key, *end))

        def flush():
            columns = zip(*found, strict=True) if found else [[] for _ in arrow]
            made = pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            found.clear()
            return made

        for b in pieces(batches):
            for conv, turn, role, body, is_there, blank, cut_off in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != key:
                    if now:
                        close()
                    key = conv
                    now = _Conversation((lambda *x, conv=conv: found.append((conv, *x))) if whole else None)
                if is_there:
                    now.row(turn, role, body, blank, cut_off)
            if len(found) >= 500:
                yield flush()
        if now:
            close()
        yield flush()

    return rows.mapInArrow(walk, out)


def repair(conversations: DataFrame, present: str | None = None) -> DataFrame:
    """A row for each conv_id: gaps in its turns, its faults, the cost and audit string of the cheapest edits, the SHA-256 of what they give.

    Of rows whose ``present`` column is false only the conversation counts. A row's first fault counts: blank, a
    role and text seen earlier, truncated (the last character is no closing mark). Edits are keep (0), rerole to
    user or assistant (3), delete (4; blank and repeated rows must go), insert an empty turn (3); a truncated row
    that stays costs 3 more. Of edits that cost the same the audit string (K, R, D, I) that sorts first wins.
    """
    return _walk(conversations, present, REPORT, whole=False)


def repaired_turns(conversations: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, place, edit, role, text: the turns that ``repair`` leaves, in their new order."""
    return _walk(conversations, present, TURNS, whole=True)
