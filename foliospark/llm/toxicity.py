"""Toxicity by a weighted grammar of finite-state patterns.

A lexicon turns a clause's words into marks: insults and threats with a weight, targets, negations, verbs of
reported speech, quotation marks and conjunctions. Three transducers rewrite marks in turn: negation, with a
scope that a conjunction or a target ends; reported speech, from its verb on; and targets, before or after.
Composed to one machine they read a clause once, and each insult or threat comes out as the pattern that it is
part of. Matched patterns are weighed, not words alone: what insults, and what each pattern weighs, is learned
from labelled documents.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut, pieces
from foliospark.llm.labelled import labelled_sample

#: Labelled documents that the grammar is fitted on at most.
SAMPLE = 12_000
#: Lengths of word beginnings that may be learned as stems, each with a short or a long rest of the word, and how long a short rest is.
STEMS, SHORT_REST = (4, 5, 6, 7), 5
#: Least number of toxic documents that show a learned word.
LEAST = 3
#: Weights are held to zero as strongly as so many observations would.
PENALTY = 1.0
#: Marks that a negation reaches, and that may stand between an insult or threat and its target.
SCOPE, REACH = 3, 4

#: Words of the parts that need no learning, in the languages of the corpora.
SEEDS = {
    "insult": "idiot idiots moron stupid loser scum trash pathetic worthless disgusting clown dumb fool foolish bastard bitch asshole jerk filthy vermin idiota estúpido imbécil idiote stupide connard dumm trottel arschloch",
    "threat": "kill killed murder hurt beat destroy burn shoot stab hang matar muere tuer crève töten stirb umbringen",
    "target": "you your yours yourself u he she him her they them their people those these du dich dir ihr euch sie tu te toi vous ton usted ustedes ellos",
    "negation": "not no never n't isn't aren't don't doesn't wasn't without nicht kein keine nie ne jamais nunca sin",
    "report": "said says say wrote writes called calls calling claimed claims reported quote quoted according sagte sagt schrieb dit écrit disait dijo dice escribió",
    "conjunction": "and but or so und aber oder et mais y pero",
}
PARTS = tuple(SEEDS)
#: Marks of the parts; any other word is ".", a quotation mark "Q", a comma a conjunction.
MARKS = {"insult": "I", "threat": "H", "target": "T", "negation": "N", "report": "R", "conjunction": "C"}
ALPHABET = "IHTNRCQ."
#: What an insult or threat can come out as.
PATTERNS = {"P": "insult", "A": "insult at target", "i": "negated insult", "r": "reported insult", "U": "threat", "K": "threat at target", "h": "negated threat", "s": "reported threat"}

_CLAUSE = re.compile(r"[.!?;\n\r]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”„«»,]")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: (state, mark) -> (state, marks written), and what is written at the end of a state."""

    arcs: dict
    ends: dict
    start: object

    @classmethod
    def of(cls, alphabet: str, start, step, end) -> Transducer:
        """From a rule ``step(state, mark)`` and ``end(state)``, written out over all states that can be reached."""
        arcs, ends, todo = {}, {}, [start]
        while todo:
            if (state := todo.pop()) in ends:
                continue
            ends[state] = end(state)
            for mark in alphabet:
                arcs[state, mark] = step(state, mark)
                todo.append(arcs[state, mark][0])
        return cls(arcs, ends, start)

    def run(self, marks, state=None):
        """State and marks written after ``marks``, without the end."""
        state, out = self.start if state is None else state, []
        for m in marks:
            state, more = self.arcs[state, m]
            out += more
        return state, "".join(out)

    def __call__(self, marks) -> str:
        state, out = self.run(marks)
        return out + self.ends[state]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes is what ``other`` reads."""

        def step(state, mark):
            own, written = self.arcs[state[0], mark]
            theirs, out = other.run(written, state[1])
            return (own, theirs), out

        def end(state):
            theirs, out = other.run(self.ends[state[0]], state[1])
            return out + other.ends[theirs]

        return Transducer.of("".join(dict.fromkeys(m for _, m in self.arcs)), (self.start, other.start), step, end)


def negation() -> Transducer:
    """I and H become i and h within SCOPE marks after a negation; a conjunction or a target ends the scope. "kill you not" is negated too."""

    def plain(left, mark):
        if mark == "N":
            return (SCOPE, ""), "N"
        if mark in "CT":
            return (0, ""), mark
        if mark == "H" and not left:
            return (0, "H"), ""
        return (max(0, left - 1), ""), mark.lower() if left and mark in "IH" else mark

    def step(state, mark):
        left, held = state
        if not held:
            return plain(left, mark)
        if held == "H" and mark == "T":
            return (0, "HT"), ""
        if mark == "N":
            return (0, ""), held.replace("H", "h") + "N"
        after, out = plain(0, mark)
        return after, held + out

    return Transducer.of(ALPHABET, (0, ""), step, lambda state: state[1])


def reported() -> Transducer:
    """I and H become r and s after a verb of speech: up to a conjunction or, once quotation marks open, up to where they close."""

    def step(state, mark):
        speaking, quoting = state
        if mark == "R":
            return (True, quoting), "R"
        if mark == "Q":
            return ((speaking, True) if speaking and not quoting else (speaking and not quoting, False)), "Q"
        if mark == "C":
            return (speaking and quoting, quoting), "C"
        return state, {"I": "r", "H": "s"}.get(mark, mark) if speaking else mark

    return Transducer.of(ALPHABET + "ih", (False, False), step, lambda _: "")


def targeted() -> Transducer:
    """Every insult and threat as its pattern, in order; other marks are dropped. A target counts within REACH marks before or after, an insult after a threat as its target."""
    alone, met = {"I": "P", "H": "U"}, {"I": "A", "H": "K"}

    def step(state, mark):
        near, held, age = state  # marks for which the last target still counts; an insult or threat that waits for one
        wait = (held, age + 1) if held and age + 1 < REACH else ("", 0)
        late = alone[held] if held and not wait[0] else ""
        if mark == "T":
            return (REACH, "", 0), met[held] if held else ""
        if mark == "C":
            return (0, "", 0), alone[held] if held else ""
        if mark in "IH":
            before = "" if not held else met[held] if (held, mark) == ("H", "I") else alone[held]
            return ((near - 1, "", 0), before + met[mark]) if near else ((0, mark, 0), before)
        if mark in "irhs":
            return (max(0, near - 1), "", 0), (alone[held] if held else "") + mark
        return (max(0, near - 1), *wait), late

    return Transducer.of(ALPHABET + "irhs", (0, "", 0), step, lambda state: alone[state[1]] if state[1] else "")


@cache
def grammar() -> Transducer:
    """Negation, reported speech and targets, composed; states are numbers."""
    whole = negation().then(reported()).then(targeted())
    number = {state: i for i, state in enumerate(whole.ends)}
    return Transducer({(number[s], m): (number[t], out) for (s, m), (t, out) in whole.arcs.items()}, {number[s]: out for s, out in whole.ends.items()}, number[whole.start])


def stem(word: str, n: int) -> str:
    """The first ``n`` letters, marked by whether a short or a long rest follows."""
    return word[:n] + ("<" if len(word) - n <= SHORT_REST else ">")


class Grammar:
    """Lexicon transducers and pattern weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) - 1 for s in stems}, reverse=True)
        self.parts = {w: p for p in PARTS[::-1] for w in SEEDS[p].split()}
        self.weights, self.bias, self.fitted = np.zeros(2 * len(PATTERNS) + 2), 0.0, False
        self._seen: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Weight of a lower-cased word as an insult; 0 if it is none."""
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) > 50_000:
                self._seen.clear()
            found = self.words.get(word, 0.0)
            if not found:
                found = max((self.stems.get(stem(word, n), 0.0) for n in self.lengths if len(word) > n), default=0.0)
            if not found and self.parts.get(word) == "insult" and word not in self.words:
                found = 1.0
            self._seen[word] = max(found, 0.0)
        return found

    def clause(self, tokens: list[str]) -> list[tuple[str, float]]:
        """(pattern, weight) of each insult and threat of a clause, in order: weights wait until the machine writes what they belong to."""
        machine = grammar()
        state, out, waiting = machine.start, [], deque()
        for w in tokens:
            if weight := self.insult(w):
                mark = "I"
                waiting.append(weight)
            else:
                mark = "Q" if w in "\"“”„«»" else "C" if w == "," else MARKS.get(self.parts.get(w, ""), ".")
                if mark == "I":  # a seed that labels have cleared
                    mark = "."
                elif mark == "H":
                    waiting.append(1.0)
            state, written = machine.arcs[state, mark]
            out += [(p, waiting.popleft()) for p in written]
        return out + [(p, waiting.popleft()) for p in machine.ends[state]]

    def patterns(self, text: str | None) -> np.ndarray:
        """For each pattern, and for insults beyond the first: damped sum over the clauses, and the same for each hundred words."""
        lower = (text or "").lower()
        words = _WORD.findall(lower)
        sums, hits = dict.fromkeys(PATTERNS, 0.0), 0
        if any(self.insult(w) or self.parts.get(w) == "threat" for w in set(words)):
            for part in _CLAUSE.split(lower):
                for p, weight in self.clause(_TOKEN.findall(part)):
                    sums[p] += weight
                    hits += p in "PAir"
        x = np.array([*sums.values(), max(0.0, hits - 1.0)])
        return np.concatenate((np.log1p(x), np.log1p(100 * x / (len(words) + 20))))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights @ self.patterns(text), -30, 30))))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Grammar:
        """Logistic regression of labels on patterns by Newton steps; weights of single patterns stay if the data have none."""
        a = np.column_stack((x, np.ones(len(x))))
        b, penalty = np.zeros(a.shape[1]), PENALTY / len(y)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            grad = a.T @ (p - y) / len(y) + penalty * np.append(b[:-1], 0.0)
            hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + penalty * np.eye(len(b)) + 1e-9 * np.eye(len(b))
            step = np.linalg.solve(hess, grad)
            b -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.bias, self.fitted = b[:-1], float(b[-1]), True
        return self


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems by their log odds in toxic against other documents of ``sample`` (text, label), all that pass; the sample's bound bounds what reaches the driver."""
    tokens = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}'’]+"))
    words = sample.select("label", F.monotonically_increasing_id().alias("row"), F.explode(tokens).alias("word")).filter("length(word) BETWEEN 2 AND 60")
    rest = lambda n: F.when(F.length("word") - n <= SHORT_REST, "<").otherwise(">")
    forms = F.array(F.concat(F.lit("="), "word"), *[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), rest(n))) for n in STEMS])
    rows = words.select("label", "row", F.explode(F.array_compact(forms)).alias("form")).distinct()
    stats = rows.groupBy("form").agg(F.sum("label").alias("tox"), F.count(F.lit(1)).alias("n")).filter(F.col("tox") >= LEAST)
    base = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not base[0] or base[0] == base[1]:
        return {}, {}
    prior = base[0] / base[1]
    odds = F.log((F.col("tox") + prior) / (F.col("n") - F.col("tox") + 1 - prior))
    # what stands in toxic documents far more often than chance lets it: by rate and by count
    strong = stats.filter((F.col("tox") >= 0.7 * F.col("n")) & ((F.col("tox") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior)) >= 5.0))
    best = strong.select("form", odds.alias("odds")).collect()
    found = {r["form"]: max(0.5, min(4.0, r["odds"] / 1.5)) for r in best}
    stems = {f: v for f, v in found.items() if f[0] != "="}
    return {f[1:]: v for f, v in found.items() if f[0] == "="}, stems


def fit(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE) -> Grammar:
    """Learn lexicon and weights from at most ``sample`` labelled documents; without labels the seed words weigh alone."""
    rows = cut(labelled_sample(docs, labels, "toxic", allowed, sample), "toxicity-sample")
    words, stems = learn_lexicon(rows)
    model = Grammar(words, stems)

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([model.patterns(t).astype("<f8").tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], names=["x", "label"])

    got = rows.mapInArrow(run, "x binary, label int").toPandas()
    if got["label"].nunique() < 2:
        model.weights[:], model.bias = 2.0, -3.0
        return model
    x = np.frombuffer(b"".join(got["x"]), "<f8").reshape(len(got), -1)
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # whatever order they came in
    return model.fit(x[order], got["label"].to_numpy(np.float64)[order])


def score_toxicity(docs: DataFrame, model: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: more toxic) of every row; only id and text are read.

    Null texts score as empty ones. Rows are scored alone, whole texts each: ties, repeated rows and null
    ids don't matter. An empty table gives no rows.
    """

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
