"""Document quality by Bradley-Terry ranking of preference pairs.

Every document gets a small vector of surface features. Labelled documents give preference pairs (a good one over a poor one); the
weights are those that maximise the logistic likelihood of the pairs given the difference of their features. A quantile of the training
scores is the threshold, and scores are moved so that the threshold lies at ``CUT``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orepulse.llm.common import cut, per_batch, remainder

#: Features of a text, each a share or a logarithm, so that no length can overflow them.
FEATURES = (
    "upper", "symbols", "pipes", "marks", "digits", "spaces", "distinct_words", "repeated_next", "long_words", "mean_word", "log_words", "repeated_lines",
)
MAX_TRAINING = 20_000  # labelled rows that the fit may look at: the bound of everything that reaches the driver
PAIRS = 100_000  # preference pairs drawn from them
CUT = 0.3
FOLDS = 5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _PLAIN)


def text_features(text: str | None) -> list[float]:
    """The features of one whole text; a null or empty text has only zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size, letters = int(counts.sum()), max(1, int(counts[_LETTER].sum()))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        counts[_UPPER].sum() / letters,
        counts[_SYMBOL].sum() / size,
        counts[ord("|")] / n,
        counts[ord("!")] / n,
        counts[_DIGIT].sum() / size,
        counts[_SPACE].sum() / size,
        len(set(words)) / n,
        same / n,
        sum(map((20).__lt__, map(len, words))) / n,
        math.log1p(letters / n),
        math.log1p(len(words)),
        1 - len(set(lines)) / len(lines),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the feature columns, one row per row of ``docs``."""

    def work(texts: list) -> list:
        return list(np.array([text_features(t) for t in texts], float).reshape(len(texts), len(FEATURES)).T)

    return per_batch(docs.select("doc_id", "text"), work, ", ".join(f"{f} double" for f in FEATURES))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> dict:
    """Bradley-Terry weights and threshold from a bounded sample; without pairs every document scores the same, above the cut."""
    centre = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    spread = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    spread = np.where(spread > 1e-9, spread, 1.0)
    weights, threshold = np.zeros(len(FEATURES)), -1.0
    best, worst = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if len(best) and len(worst):
        z, rng = (x - centre) / spread, np.random.default_rng(seed)
        difference = z[rng.choice(best, pairs)] - z[rng.choice(worst, pairs)]
        for _ in range(25):  # Newton steps on the mean logistic loss
            p = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
            gradient = difference.T @ (p - 1) / pairs + ridge * weights
            curvature = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + ridge * np.eye(len(weights))
            step = np.linalg.solve(curvature, gradient)
            weights = weights - step
            if np.abs(step).max() < 1e-8:
                break
        threshold = _threshold(z @ weights, good)
    return {"weights": weights / spread, "offset": -float(weights @ (centre / spread)), "threshold": threshold}


def _threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score quantile that parts the labels best (balanced accuracy); between neighbours it lies half-way."""
    order = np.argsort(scores, kind="stable")
    ranked, label = scores[order], good[order]
    below_bad = np.cumsum(label == 0) / max(1, (label == 0).sum())
    below_good = np.cumsum(label == 1) / max(1, (label == 1).sum())
    last_of_tie = np.append(ranked[1:] > ranked[:-1], True)
    value = np.where(last_of_tie, below_bad - below_good, -1.0)
    at = int(value.argmax())
    quantile = (at + 1) / len(ranked)
    low = ranked[min(len(ranked) - 1, max(0, round(quantile * len(ranked)) - 1))]
    higher = ranked[ranked > low]
    return float((low + higher[0]) / 2) if len(higher) else float(low)


def score_quality(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, pairs: int = PAIRS, folds: int = FOLDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Only labelled rows outside the held-out fold are learned from, the ``max_training`` of them with the smallest hash of their id.
    Null labels and labels of unknown documents are ignored. Null and empty texts have the features of an empty text. Rows that share
    an id are scored each by its own text.
    """
    known = cut(features(docs))
    return _scores(known, train_model(known, labels, max_training, pairs, folds), folds)


def keep_good(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, pairs: int = PAIRS, folds: int = FOLDS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; the model is the one of ``score_quality``."""
    model = train_model(cut(features(docs)), labels, max_training, pairs, folds)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            values = np.array([text_features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            raw = values @ model["weights"] + model["offset"] - model["threshold"] + math.log(CUT / (1 - CUT))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def train_model(known: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, pairs: int = PAIRS, folds: int = FOLDS) -> dict:
    """The model of the labelled rows of ``known`` (doc_id and features) outside the held-out fold."""
    train = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), folds) != 0)).select("doc_id", "quality")
    train = train.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_training)
    rows = train.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES, "quality").limit(max_training).toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(int), pairs)


def _scores(known: DataFrame, model: dict, folds: int) -> DataFrame:
    raw = F.lit(model["offset"] - model["threshold"] + math.log(CUT / (1 - CUT)))
    for name, weight in zip(FEATURES, model["weights"]):
        raw = raw + F.lit(float(weight)) * F.col(name)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw))))
    scored = known.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
