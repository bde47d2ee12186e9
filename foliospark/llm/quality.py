"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank, so their sum over all pairs of a document's n features takes O(nk):
half of (sum of v x) squared minus the sum of (v x) squared, for each of the k factors.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import pieces, small_batches
from foliospark.llm.labelled import labelled_sample

#: Words are hashed to so many bits.
BITS = 16
#: Labelled rows that the model is fitted on at most.
SAMPLE = 8000
FACTORS, EPOCHS, BATCH, RATE, PENALTY, SEED = 6, 8, 128, 0.08, 2e-5, 11
#: Gradient steps at least, which small samples take in smaller batches and more epochs.
LEAST_STEPS = 500
#: Steps of a statistic; a value lies between two of them and counts for both by its nearness.
STEPS = 12

STATS = ("upper", "symbol", "digit", "mark", "word length", "long word", "distinct", "top word", "repeats", "symbol end", "line repeats", "length", "lines", "bar", "space")
#: Metadata: the length that the table states, how far it is from the text's, and whether there is none.
META = ("stated length", "stated wrong", "not stated")
WORDS = 1 << BITS
FEATURES = WORDS + (len(STATS) + len(META)) * (STEPS + 1)

_UPPER = np.zeros(256)
_UPPER[ord("A"):ord("Z") + 1] = 1
_DIGIT = np.zeros(256)
_DIGIT[ord("0"):ord("9") + 1] = 1
_MARK = np.isin(np.arange(256), [*b".,;:!?'\"-()"])
_SPACE = np.isin(np.arange(256), [*b" \t\n\r\x0b\x0c"])
_LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])
_SYMBOL = ~_MARK & ~_SPACE & ~_LETTER & (_DIGIT == 0)

_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) > 50_000:
            _hashes.clear()
        h = _hashes[word] = zlib.crc32(word.encode("utf-8", "replace")) & (WORDS - 1)
    return h


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """A number from 0 to 1 for each of STATS."""
    data = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = max(1, len(data)), max(1, len(words))
    letters = max(1.0, float(by[_LETTER].sum()))
    lines = [x for x in text.split("\n") if x]
    ends = sum(not (w[-1].isalnum() or w[-1] in ".,;:!?'\"-()") for w in words)
    return [
        float(by @ _UPPER) / letters, min(1.0, 4 * float(by[_SYMBOL].sum()) / size), min(1.0, 4 * float(by @ _DIGIT) / size), min(1.0, 4 * float(by[_MARK].sum()) / size),
        min(1.0, sum(map(len, words)) / n / 16), min(1.0, max(map(len, words), default=0) / 64), len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, ends / n, 1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(len(text)) / 12), min(1.0, np.log1p(len(lines)) / 8), min(1.0, 10 * text.count("|") / n), min(1.0, float(by[_SPACE].sum()) / size * 2),
    ]


def metadata(text: str, stated: int | None) -> list[float]:
    """A number from 0 to 1 for each of META."""
    if stated is None or stated < 0:
        return [0.0, 0.0, 1.0]
    return [min(1.0, math.log1p(stated) / 12), min(1.0, abs(math.log1p(stated) - math.log1p(len(text)))), 0.0]


def features(text: str | None, stated: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words by damped counts, of length one together, and the steps that each statistic and piece of metadata lies between."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    tally: dict[int, float] = {}
    for w, c in counts.items():
        h = _hash(w.lower())
        tally[h] = tally.get(h, 0.0) + c
    at = np.fromiter(tally.keys(), np.int64, len(tally))
    x = np.log1p(np.fromiter(tally.values(), np.float64, len(tally)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    place = np.array(statistics(text, words, counts) + metadata(text, stated)) * STEPS
    low = np.minimum(place.astype(np.int64), STEPS - 1)
    base = WORDS + np.arange(len(place)) * (STEPS + 1) + low
    return np.concatenate((at, base, base + 1)), np.concatenate((x, 1 - (place - low), place - low)).astype(np.float32)


class FactorisationMachine:
    """bias, a weight and ``FACTORS`` factors for each feature."""

    def __init__(self, size: int = FEATURES, bias: float = 0.0):
        self.bias = bias
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(SEED).normal(0, 0.02, (size, FACTORS)).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> FactorisationMachine:
        """Adaptive gradient steps on the logistic loss, in batches."""
        r = np.random.default_rng(SEED)
        mean = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = float(np.log(mean / (1 - mean)))
        gw, gv, gb = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        batch = max(8, min(BATCH, len(rows) // 16))
        for _ in range(max(EPOCHS, math.ceil(LEAST_STEPS * batch / len(rows)))):
            order = r.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                part = order[lo:lo + batch]
                sizes = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                at, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                vx = self.v[at] * x[:, None]
                s = np.add.reduceat(vx, starts, axis=0)
                raw = self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                e = np.repeat(err, sizes)
                seen, inverse = np.unique(at, return_inverse=True)
                dw = np.bincount(inverse, e * x, len(seen)) + PENALTY * self.w[seen]
                full = (e * x)[:, None] * (np.repeat(s, sizes, axis=0) - vx)
                dv = np.stack([np.bincount(inverse, full[:, f], len(seen)) for f in range(FACTORS)], axis=1) + PENALTY * self.v[seen]
                gw[seen] += dw * dw
                gv[seen] += dv * dv
                gb += err.sum() ** 2
                self.w[seen] -= (RATE * dw / np.sqrt(gw[seen])).astype(np.float32)
                self.v[seen] -= (RATE / 4 * dv / np.sqrt(gv[seen])).astype(np.float32)
                self.bias -= RATE * float(err.sum() / np.sqrt(gb))
        return self

    def score(self, text: str | None, stated: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text, stated)), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE, stated_col: str = "n_chars") -> FactorisationMachine:
    """Fit on at most ``sample`` labelled documents; their features, not their texts, reach the driver. No labels give a score of 0.5 to all."""

    def run(batches):
        for b in pieces(batches):
            found = [features(t, n) for t, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), b.column(1)], names=["at", "x", "label"])

    stated = F.col(stated_col).cast("long") if stated_col in docs.columns else F.lit(None).cast("long")
    got = labelled_sample(docs.withColumn(stated_col, stated), labels, "quality", allowed, sample, stated_col).mapInArrow(run, "at binary, x binary, label int").toPandas()
    if not len(got):
        return FactorisationMachine()
    rows = sorted(zip(got["at"], got["x"], got["label"], strict=True), key=lambda r: (zlib.crc32(bytes(r[0])), bytes(r[0]), r[2]))  # whatever order they came in
    return FactorisationMachine().fit([(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4")) for a, x, _ in rows], np.array([r[2] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None, stated_col: str = "n_chars") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, higher: better), replacing a column of that name; all other columns stay as they are, or only those in ``keep``.

    Null texts score as empty ones, and without ``stated_col``, or where it is null, no length is stated. Every
    row gets a score from its whole text and that alone: ties, repeated rows and null ids don't matter. An
    empty table stays empty.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    used = [*dict.fromkeys([*kept, text_col, *([stated_col] if stated_col in docs.columns else [])])]
    place = {c: i for i, c in enumerate(used)}

    def run(batches):
        for b in pieces(batches):
            stated = b.column(place[stated_col]).to_pylist() if stated_col in place else [None] * b.num_rows
            scores = pa.array([model.score(t, n if isinstance(n, int) else None) for t, n in zip(b.column(place[text_col]).to_pylist(), stated, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(place[c]) for c in kept), scores], names=[*kept, score_col])

    rows = docs.select(*[F.col(f"`{c}`") for c in used])
    return rows.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(score_col)).schema)
