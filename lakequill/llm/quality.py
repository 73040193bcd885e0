"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Every (label 1, label 0) pair of labelled documents is a preference; the score
is linear in features of the whole text, and its weights minimise the logistic
loss of feature differences over a fixed number of drawn pairs.  The cut is the
quantile of the training scores at the share of label 0; scores are mapped to
0..1 so that the cut lies at ``CUT``.

Fitting uses at most about ``max_labelled`` labelled rows, drawn by hash (the
documented bound); scoring covers every document, row by row, with no shuffle.

Defined results: a null or empty text has all features zero and gets a score
like any other.  Labels that are null or neither 0 nor 1, and labels without a
document, are ignored; a document labelled twice counts twice.  With no pair to
learn from, the score of all is the share of label 1, and 1.0 with no label.
Label, lang, source and id never enter a score.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import each_bytes
from .shared import col, free_name

CUT = 0.7
N_FEATURES = 14
_LIGHT = np.zeros(256, bool)
_LIGHT[[ord(c) for c in ".,;:'\"?-()"]] = True
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_HEAVY = np.zeros(256, bool)
_HEAVY[list(_SYMBOLS)] = True


def text_features(raw: bytes) -> list[float]:
    """Shape of a text: length, character classes, and how much it repeats itself."""
    lines = [(line, line.split()) for line in raw.split(b"\n")]
    lines = [(line, words) for line, words in lines if words]
    if not lines:
        return [0.0] * N_FEATURES
    words = [w for _, ws in lines for w in ws] if len(lines) > 1 else lines[0][1]
    n, kinds, twins = len(words), len(set(words)), 0
    worst_symbols = worst_twins = 0.0  # of the worst line: a clean first line does not hide what follows
    for line, own in lines:
        same = sum(map(operator.eq, own, own[1:]))
        twins += same
        worst_twins = max(worst_twins, same / (len(own) + 3))
        worst_symbols = max(worst_symbols, (len(line) - len(line.translate(None, _SYMBOLS))) / (len(own) + 1))
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = histogram[65:91].sum(), histogram[97:123].sum()
    total = max(1, len(raw) - histogram[32] - histogram[9:14].sum())
    return [
        np.log1p(n), np.log1p(total / n), upper / max(1, upper + lower), histogram[_HEAVY].sum() / total, histogram[48:58].sum() / total,
        histogram[_LIGHT].sum() / total, np.log1p(kinds) / np.log1p(n), twins / n, kinds / n, len({line for line, _ in lines}) / len(lines),
        histogram[128:].sum() / total, np.log1p(n / len(lines)), np.sqrt(worst_symbols), np.sqrt(worst_twins),
    ]


@dataclass(frozen=True)
class Ranker:
    """Centre, scale and weights of the features, and the map of raw scores to 0..1."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float
    constant: float | None = None

    def raw(self, features: np.ndarray) -> np.ndarray:
        return _expand(features, self.centre, self.scale) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        z = (self.raw(features) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _expand(features, centre, scale):
    z = np.clip((features - centre) / scale, -6.0, 6.0)
    return np.hstack([z, z * z])


def fit_ranker(features: np.ndarray, labels: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Minimise the mean logistic loss of feature differences by Newton steps."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    none = np.zeros(0)
    if not len(good) or not len(bad):
        return Ranker(none, none, none, 0.0, 1.0, float(labels.mean()) if len(labels) else 1.0)
    centre, scale = features.mean(0), features.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    x = _expand(features, centre, scale)
    rng = np.random.default_rng(seed)
    diff = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -500, 500)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w)), diff.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = x @ w
    cut = float(np.quantile(raw, len(bad) / len(labels), method="midpoint"))
    return Ranker(centre, scale, w, cut, max(float(raw.std()), 1e-9))


def _features_column(text):
    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([text_features(raw) for raw in each_bytes(texts)], pa.list_(pa.float64()))

    return features(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Ranker:
    """Learn from the labelled rows of ``labels`` whose text is in ``docs``."""
    known = labels.filter(col(label_col).isin(0, 1) & col(id_col).isNotNull()).select(col(id_col).alias("_id"), col(label_col).alias("_label"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    sample = (
        docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")).join(F.broadcast(known), "_id")  # at most about max_labelled rows
        .select("_id", "_label", _features_column(F.col("_text")).alias("f")).orderBy("_id", "_label", "f").collect()
    )
    features = np.array([r["f"] for r in sample], float).reshape(-1, N_FEATURES)
    return fit_ranker(features, np.array([r["_label"] for r in sample], int))


def score(docs: DataFrame, ranker: Ranker, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with score and predicted (1 if score >= ``CUT``); columns of these names are replaced."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        rows = [text_features(raw) for raw in each_bytes(texts)]
        return pa.array(ranker.score(np.array(rows, float).reshape(-1, N_FEATURES)), pa.float64())

    out = docs.withColumn(score_col, scored(col(text_col)))
    return out.withColumn(predicted_col, (col(score_col) >= CUT).cast("int"))


def held_out(ident):
    """Fixed rule: crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject_poor(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents predicted 1, with their own columns."""
    ranker = fit(docs, labels.filter(~held_out(col("doc_id"))), text_col=text_col)
    s = free_name(docs, "_score")
    p = free_name(docs, "_predicted")
    return score(docs, ranker, text_col, s, p).filter(col(p) == 1).select(*[col(c) for c in docs.columns])
