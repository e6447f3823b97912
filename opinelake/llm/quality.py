"""Quality scores learned from preference pairs (Bradley-Terry), cut at a score quantile.

A document of quality 1 is preferred to one of quality 0. The score is linear in features of the text, and its weights maximise
the likelihood of the preferences: logistic loss on the feature differences of the pairs, so no intercept. The cut is the score
quantile, among the training documents, that separates the labels best; a logistic map then carries scores to 0..1 with the cut
at ``CUT``.

Weights are fitted on at most about ``SAMPLE`` labelled documents per class, picked by the hash of their id; every document is
scored, without a shuffle.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.3
SAMPLE = 3000
PAIRS = 40_000
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = b"!#$%&*|~^<>{}[]\\=+@_"
_PLAIN = b".,;:'\"?()-/ \n"
FEATURES = (
    "log_chars", "log_words", "upper", "digits", "marks", "bars", "bangs", "plain", "repeated_words", "distinct_words",
    "repeated_lines", "word_length", "long_words", "marked_words",
)


def features(text: str | None) -> list[float]:
    """Shares and logarithms of counts; all of the text is read. Null is the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    n, w = max(len(raw), 1), max(len(words), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    lower = raw.lower().split()
    again = sum(map(operator.eq, lower, lower[1:])) / w
    sizes = list(map(len, words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), share(_UPPER), share(_DIGIT), share(_MARKS), raw.count(b"|") / n,
        raw.count(b"!") / n, share(_PLAIN), again, len(set(lower)) / np.sqrt(w), 1 - len(set(lines)) / max(len(lines), 1),
        sum(sizes) / w, max(sizes, default=0) / n, sum(map(bytes.isupper, words)) / w,
    ]


@dataclass
class Model:
    """Weights over standardised features and the logistic map to 0..1; ``quantile`` is the score quantile of the cut."""

    mean: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    spread: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    slope: float = 1.0
    at: float = 0.0
    quantile: float = 0.0

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.utility(x) - self.at) + np.log(CUT / (1 - CUT)), -30, 30)))


def preference_weights(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-(better - worse) w)) plus a ridge, by Newton steps."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w)), d.T @ p / len(d) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rows(x: np.ndarray, quality: np.ndarray, seed: int = 7) -> Model:
    """The model of feature rows and their labels (1 preferred to 0). With one class only, every text scores ``CUT``."""
    if len(x) == 0 or quality.min() == quality.max():
        return Model()
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -6, 6)
    good, bad = z[quality == 1], z[quality == 0]
    rng = np.random.default_rng(seed)
    w = preference_weights(good[rng.integers(0, len(good), PAIRS)], bad[rng.integers(0, len(bad), PAIRS)])
    u = z @ w
    # The quantile whose cut separates the two classes best, each class counting alike.
    order = np.argsort(u, kind="stable")
    is_bad = (quality == 0)[order]
    right = np.cumsum(is_bad) / is_bad.sum() + 1 - np.cumsum(~is_bad) / (~is_bad).sum()
    k = int(np.argmax(right))
    at = float((u[order[k]] + u[order[min(k + 1, len(u) - 1)]]) / 2)
    return Model(mean.tolist(), spread.tolist(), w.tolist(), 1.0, at, (k + 1) / len(u))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [features(t) for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from documents whose id has a label 0 or 1; about ``sample`` per class, picked by the hash of the id.

    Rows with a null id or label teach nothing; repeated labels of an id count once, as their least value, and so do repeated
    rows of a document, as the one with the least features. The model does not depend on how the rows are partitioned.
    """
    marked = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col("quality") == value, F.lit(min(1.0, sample / n))).otherwise(rate)
    picked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    # About 2 * sample rows of two numbers: bounded, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    measured = rows.mapInPandas(_measured, "doc_id long, quality int, x array<double>")
    one = measured.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("m")).select("doc_id", "m.*")
    found = sorted(one.collect())  # pairs are drawn by position: an order of its own makes the model the same for every layout
    return fit_rows(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in found], int))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for each text, null and empty texts included; no row is dropped or moved."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t) for t in batch], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x), dtype=float)

    return docs.withColumn(column, scores(F.col("text").cast("string")))
