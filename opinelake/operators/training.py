"""Text classifier training in epochs with validation, and a store of fitted models.

A model is a linear classifier over hashed words weighted by inverse document frequency. In an epoch every slice of the training rows
runs stochastic gradient steps from the weights of the last epoch, in its own task; the slices' weights are averaged, block of
features by block. The rate rises over the first epochs and falls to zero over the rest. After each epoch the model scores the
validation rows; training stops when their F1 has not risen for ``patience`` epochs (at the same F1 a smaller loss counts), and the
best epoch's weights are kept.

Fitted models are tables under (name, version) in a folder, so that any session can load one and score with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from opinelake.functions import text as tx
from opinelake.session import shared_dir
from opinelake.sources import readers as rd

BLOCK = 1 << 14  # features of a stored or averaged row


@dataclass(frozen=True)
class Schedule:
    """Settings of a training run.

    The rows of a slice are learned from in one task, in order. There are ``slices`` of them, more where a slice would get over
    ``slice_rows`` rows; their number depends on the rows alone, so the cluster has no say in the model.
    """

    classes: int = 2
    features: int = 1 << 18
    epochs: int = 10
    patience: int = 3
    rate: float = 4.0
    warm_up: float = 0.2
    batch: int = 8
    slices: int = 1
    slice_rows: int = 5000
    decay: float = 1e-5

    def rate_of(self, epoch: int) -> float:
        """The rate of an epoch (from 1): a line up over the share ``warm_up`` of the epochs, then a line down."""
        up = max(1, round(self.warm_up * self.epochs))
        return self.rate * (epoch / up if epoch <= up else (self.epochs - epoch + 1) / (self.epochs - up + 1))


class TextModel:
    """Weights (features, classes), intercepts and feature weights of a classifier."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, idf: np.ndarray):
        self.weights, self.bias, self.idf = weights, bias, idf

    @classmethod
    def blank(cls, schedule: Schedule, idf: np.ndarray) -> TextModel:
        return cls(np.zeros((schedule.features, schedule.classes), np.float32), np.zeros(schedule.classes, np.float32), idf)

    def rows(self, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, value and row of each different term of each row; values of a row have length 1."""
        feature, value, row = [], [], []
        for i, t in enumerate(terms):
            f, n = np.unique(np.asarray(t, np.int64), return_counts=True)
            v = n * self.idf[f]
            feature.append(f)
            value.append(v / max(np.sqrt((v * v).sum()), 1e-12))
            row.append(np.full(len(f), i))
        return (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((feature, np.int64), (value, float), (row, np.int64)))

    def probabilities(self, terms: list[np.ndarray], parts: tuple | None = None) -> np.ndarray:
        feature, value, row = parts or self.rows(terms)
        logits = np.stack(
            [np.bincount(row, value * self.weights[feature, c], minlength=len(terms)) + b for c, b in enumerate(self.bias.tolist())], axis=1
        )
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def learn(self, terms: list[np.ndarray], labels: np.ndarray, rate: float, schedule: Schedule) -> float:
        """One pass of gradient steps over the rows in order; the sum of their losses before each step."""
        loss = 0.0
        for at in range(0, len(terms), schedule.batch):
            own, truth = terms[at : at + schedule.batch], labels[at : at + schedule.batch]
            feature, value, row = parts = tuple(self.rows(own))
            p = self.probabilities(own, parts)
            loss -= float(np.log(np.maximum(p[np.arange(len(own)), truth], 1e-12)).sum())
            p[np.arange(len(own)), truth] -= 1
            step = rate / len(own)
            self.weights *= 1 - rate * schedule.decay
            np.subtract.at(self.weights, feature, (step * value[:, None] * p[row]).astype(np.float32))
            self.bias -= (step * p.sum(axis=0)).astype(np.float32)
        return loss


class Trained(NamedTuple):
    model: TextModel
    history: DataFrame
    best_epoch: int


def terms_of(text: Column, features: int) -> Column:
    """The hashed words of a text; none for null."""
    return F.transform(tx.tokens(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.hash(w), F.lit(features)))


def _idf(rows: DataFrame, features: int) -> np.ndarray:
    """log((n + 1) / (df + 1)) of each feature: at most ``features`` numbers reach the driver."""
    seen = rows.select(F.explode(F.array_distinct("terms")).alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()
    df = np.zeros(features)
    for r in seen:
        df[r["f"]] = r["n"]
    return np.log((rows.count() + 1) / (df + 1))


def _epoch(rows: DataFrame, model: TextModel, rate: float, schedule: Schedule) -> tuple[TextModel, float]:
    """The averaged weights of the slices after an epoch, and the mean loss. Each slice counts by its rows."""

    def run(key: tuple, slice_: pd.DataFrame) -> pd.DataFrame:
        own = TextModel(model.weights.copy(), model.bias.copy(), model.idf)
        slice_ = slice_.sort_values("key", kind="stable")
        loss = own.learn(slice_["terms"].tolist(), slice_["label"].to_numpy(np.int64), rate, schedule)
        n = float(len(slice_))
        blocks = [own.weights[at : at + BLOCK].ravel() * np.float32(n) for at in range(0, schedule.features, BLOCK)]
        return pd.DataFrame({"block": [*range(len(blocks)), -1], "values": [*blocks, np.append(own.bias * n, [n, loss]).astype(np.float32)]})

    def add(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "values": [np.sum(np.stack(block["values"].to_list()), axis=0, dtype=np.float64)]})

    parts = rows.groupBy("slice").applyInPandas(run, "block int, values array<float>")
    summed = {r["block"]: np.array(r["values"]) for r in parts.groupBy("block").applyInPandas(add, "block int, values array<double>").collect()}
    *bias, n, loss = summed.pop(-1)
    weights = np.concatenate([summed[b] for b in sorted(summed)]).reshape(schedule.features, schedule.classes) / n
    return TextModel(weights.astype(np.float32), (np.array(bias) / n).astype(np.float32), model.idf), loss / n


def weighted_f1(confusion: np.ndarray) -> float:
    """F1 by class, weighted by the class's rows; confusion[true, predicted]."""
    hit, support, predicted = np.diag(confusion), confusion.sum(axis=1), confusion.sum(axis=0)
    f1 = 2 * hit / np.maximum(support + predicted, 1)
    return float((f1 * support).sum() / max(support.sum(), 1))


def _validated(rows: DataFrame, model: TextModel, classes: int) -> tuple[float, float]:
    """Mean loss and F1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            terms, truth = b["terms"].tolist(), b["label"].to_numpy(np.int64)
            p = model.probabilities(terms)
            loss = -np.log(np.maximum(p[np.arange(len(terms)), truth], 1e-12))
            yield pd.DataFrame({"label": truth, "guess": p.argmax(axis=1), "loss": loss})

    got = rows.select("terms", "label").mapInPandas(run, "label int, guess int, loss double").groupBy("label", "guess").agg(
        F.count("*").alias("n"), F.sum("loss").alias("loss")
    ).collect()
    confusion = np.zeros((classes, classes))
    for r in got:
        confusion[r["label"], r["guess"]] = r["n"]
    return sum(r["loss"] for r in got) / max(confusion.sum(), 1), weighted_f1(confusion)


def train_validated(df: DataFrame, key: str, text: str, label: str, split: str = "split", schedule: Schedule = Schedule()) -> Trained:
    """Learns from the rows of split ``train`` and stops by those of ``validation``; labels are 0 to classes - 1.

    Slices and the order of rows come from hashes of the key, so a repeated run gives the same model. ``history`` has a row per
    epoch: epoch, rate, train_loss, validation_loss, validation_f1, best.
    """
    spark = df.sparkSession
    hashed = F.xxhash64(F.col(key), F.lit(42))
    n = df.filter((F.col(split) == "train") & F.col(label).isNotNull()).count()
    slices = max(schedule.slices, -(-n // schedule.slice_rows))
    rows = df.select(
        hashed.alias("key"), F.pmod(hashed, F.lit(slices)).cast("int").alias("slice"), F.col(label).cast("int").alias("label"),
        terms_of(F.col(text), schedule.features).alias("terms"), F.col(split).alias("part"),
    ).filter("label IS NOT NULL AND part IN ('train', 'validation')")
    rows = rd.materialise(rows, shared_dir(spark, "training-rows"))  # read in every epoch
    train, held = rows.filter("part = 'train'").drop("part"), rows.filter("part = 'validation'")
    model = TextModel.blank(schedule, _idf(train, schedule.features))
    best, best_score, best_epoch, history = model, (-1.0, 0.0), 0, []
    for epoch in range(1, schedule.epochs + 1):
        rate = schedule.rate_of(epoch)
        model, train_loss = _epoch(train, model, rate, schedule)
        loss, f1 = _validated(held, model, schedule.classes)
        history.append((epoch, rate, float(train_loss), float(loss), f1))
        if (f1, -loss) > best_score:
            best, best_score, best_epoch = model, (f1, -loss), epoch
        elif epoch - best_epoch >= schedule.patience:
            break
    table = spark.createDataFrame(
        [(*h, h[0] == best_epoch) for h in history],
        "epoch int, rate double, train_loss double, validation_loss double, validation_f1 double, best boolean",
    )
    return Trained(best, table, best_epoch)


def score_texts(df: DataFrame, text: str, model: TextModel) -> DataFrame:
    """Adds ``probabilities`` (array<double>) by the model; texts without words get those of the intercepts."""
    features = len(model.idf)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for terms in batches:
            yield pd.Series(list(model.probabilities(terms.tolist())))

    return df.withColumn("_terms", terms_of(F.col(text), features)).withColumn("probabilities", score("_terms")).drop("_terms")


# --- model store ---------------------------------------------------------------------------------------

def model_path(root: str, name: str, version: str) -> str:
    return f"{root}/models/{name}/{version}"


def save_model(spark: SparkSession, model: TextModel, root: str, name: str, version: str, schedule: Schedule) -> str:
    """Writes a model as a table of blocks of features; the path to put into the registry. A stored version is not overwritten."""
    path = model_path(root, name, version)
    blocks = [("idf", b, model.idf[at : at + BLOCK].tolist()) for b, at in enumerate(range(0, len(model.idf), BLOCK))]
    blocks += [("weights", b, model.weights[at : at + BLOCK].ravel().tolist()) for b, at in enumerate(range(0, len(model.weights), BLOCK))]
    rows = [*blocks, ("bias", 0, model.bias.tolist())]
    settings = ",".join(f"{k}={v}" for k, v in asdict(schedule).items())
    spark.createDataFrame([(*r, settings) for r in rows], "kind string, block int, values array<double>, settings string").write.parquet(path)
    return path


def load_model(spark: SparkSession, root: str, name: str, version: str) -> TextModel | None:
    """The stored model, or None when there is none under this name and version."""
    try:
        rows = spark.read.parquet(model_path(root, name, version)).orderBy("kind", "block").collect()  # the size of one model
    except AnalysisException:
        return None
    part = lambda kind: np.concatenate([r["values"] for r in rows if r["kind"] == kind])
    bias = part("bias").astype(np.float32)
    return TextModel(part("weights").reshape(-1, len(bias)).astype(np.float32), bias, part("idf"))
