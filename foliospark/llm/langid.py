"""Language identification by mixtures.

Every language has a distribution over letter trigrams. A document is taken for a mixture: expectation
maximisation finds the languages' proportions from the likelihoods of its words, and languages stay in the
set only while their likelihood outweighs a penalty for each.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import pieces, small_batches

#: Trigrams are hashed to so many bits.
BITS = 17
#: Documents of each language that the model is fitted on, about; they are drawn by a hash of the id.
SAMPLE = 2000
SMOOTHING, PENALTY, ROUNDS = 0.2, 1.5, 30
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram of each letter with its neighbours (no letter: a boundary), and where each word's trigrams start."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.zeros(len(codes) + 2, np.uint64)
    s[1:-1] = np.where(_letters()[np.minimum(codes, 0x10FFFF)], codes, 0)
    at = np.flatnonzero(s)
    if not len(at):
        return at, at
    h = s[at - 1] * np.uint64(0x9E3779B97F4A7C15) + s[at] * np.uint64(0xC2B2AE3D27D4EB4F) + s[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64), np.flatnonzero(s[at - 1] == 0)


def folded(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of ``words_of``, by a hash of their trigrams in order, and how often each occurs."""
    if not len(ids):
        return ids, starts, np.zeros(0)
    sizes = np.diff(np.append(starts, len(ids)))
    place = (np.arange(len(ids)) - np.repeat(starts, sizes) + 1).astype(np.uint64)
    h = (ids.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    _, first, n = np.unique(np.add.reduceat(h * np.uint64(0x94D049BB133111EB), starts), return_index=True, return_counts=True)
    own = sizes[first]
    at = np.cumsum(own) - own
    return ids[np.repeat(starts[first] - at, own) + np.arange(own.sum())], at, n.astype(np.float64)


class Mixture:
    """Log likelihoods (trigram, language) of ``langs``."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)

    def likelihoods(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log likelihood of each word (see ``words_of``) under each language, less the word's best."""
        if not len(ids) or not self.langs:
            return np.zeros((0, len(self.langs)))
        s = np.add.reduceat(self.table[ids], starts, axis=0).astype(np.float64)
        return s - s.max(axis=1, keepdims=True)

    @staticmethod
    def _fit(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        share, weight = np.full(p.shape[1], 1 / p.shape[1]), n / n.sum()
        for _ in range(ROUNDS):
            r = p * share
            now = weight @ (r / r.sum(axis=1, keepdims=True))
            if np.abs(now - share).max() < 1e-3:
                share = now
                break
            share = now
        return share, float(n @ np.log(np.maximum(p @ share, 1e-300)))

    def proportions(self, text: str) -> np.ndarray:
        """Share of each language of the chosen set; zeros for a text without a letter. Equal words are looked at once."""
        out = np.zeros(len(self.langs))
        ids, starts, n = folded(*words_of(text))
        logs = self.likelihoods(ids, starts)
        if not len(logs):
            return out
        p = np.exp(np.maximum(logs, -60.0))
        kept = np.arange(len(self.langs))
        share, fit = self._fit(p, n)
        cost = PENALTY * np.log(n.sum() + 1.0)
        while len(kept) > 1:
            drop = int(np.argmin(share))
            rest = np.delete(np.arange(len(kept)), drop)
            sub = p[:, kept[rest]]
            s, f = (np.ones(1), float(n @ np.log(sub[:, 0]))) if len(rest) == 1 else self._fit(sub, n)
            if f < fit - cost:
                break
            kept, share, fit = kept[rest], s, f
        out[kept] = share
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        share = self.proportions(text or "")
        if not share.sum():
            return UNKNOWN, 0.0
        best = int(np.argmax(share))
        return self.langs[best], float(min(1.0, share[best]))


def _counts(sample: DataFrame, langs: list[str], model: Mixture | None = None) -> np.ndarray:
    """Trigram counts (2^BITS, languages); with a model, only of words that it gives mostly to the row's language."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in pieces(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, starts = words_of(text)
                if model is not None and len(ids):
                    p = np.exp(model.likelihoods(ids, starts))
                    own = p[:, model.langs.index(lang)] / p.sum(axis=1) > 0.5
                    ids = ids[np.repeat(own, np.diff(np.append(starts, len(ids))))]
                now = np.bincount(ids, minlength=1 << BITS)
                total[lang] = total[lang] + now if lang in total else now
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])

    rows = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << BITS, len(langs)))
    out[rows["gram"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = rows["n"]
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """Fit on rows of ``docs`` with a language and a text, about ``sample`` of each language; what reaches the driver is bounded by languages times trigrams.

    A second pass counts only the words that the first model gives to their row's language, so that passages in
    another language don't spoil a language's distribution.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Mixture([], np.zeros((1 << BITS, 0)))
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))]), F.col("lang"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.coalesce("id", F.lit(0))), 11) / float(1 << 53)
    drawn = rows.filter(u <= share).select("lang", "text")
    first = Mixture(langs, _counts(drawn, langs))
    return Mixture(langs, _counts(drawn, langs, first))


def identify(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, langs (language -> share of the chosen set) of every row; only id and text are read.

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model of no
    languages. Ties go to the first language by name. Ids may be null or repeat. Whole texts are read.
    """

    def run(batches):
        for b in pieces(batches):
            out = [model.proportions(t or "") for t in b.column(1).to_pylist()]
            best = [int(np.argmax(s)) if s.sum() else -1 for s in out]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([model.langs[i] if i >= 0 else UNKNOWN for i in best], pa.string()), pa.array([min(1.0, float(s[i])) if i >= 0 else 0.0 for s, i in zip(out, best, strict=True)], pa.float64()),
                pa.array([[(model.langs[i], float(s[i])) for i in np.flatnonzero(s)] for s in out], pa.map_(pa.string(), pa.float64())),
            ], names=["doc_id", "lang_pred", "score", "langs"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, langs map<string,double>")
