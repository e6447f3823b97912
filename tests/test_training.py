"""Training in epochs with validation, early stop, and the model store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinelake.operators import training as tr

SMALL = tr.Schedule(features=1 << 10, slices=3, epochs=6)
WORDS = {0: ["awful", "broken", "refund", "waste"], 1: ["great", "lovely", "perfect", "works"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        label = i % 2
        noise = [f"w{x}" for x in rng.integers(0, 40, 8)]
        rows.append((i, " ".join(rng.permutation(noise + list(rng.choice(WORDS[label], 2)))), label))
    df = spark.createDataFrame(rows, "id long, text string, label int")
    return df.withColumn(
        "split", F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "validation").otherwise("test")
    )


def test_held_out_f1_and_history(spark, labelled):
    done = tr.train_validated(labelled, "id", "text", "label", schedule=SMALL)
    history = done.history.orderBy("epoch").collect()
    assert [h["epoch"] for h in history if h["best"]] == [done.best_epoch]
    assert history[-1]["train_loss"] < history[0]["train_loss"]
    test = tr.score_texts(labelled.filter("split = 'test'"), "text", done.model).collect()
    right = [int(np.argmax(r["probabilities"])) == r["label"] for r in test]
    assert np.mean(right) >= 0.95
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in test)


def test_same_model_for_every_layout(spark, labelled):
    one = tr.train_validated(labelled.repartition(7), "id", "text", "label", schedule=SMALL).model
    two = tr.train_validated(labelled.repartition(2, "text"), "id", "text", "label", schedule=SMALL).model
    assert np.allclose(one.weights, two.weights, atol=1e-6)


def test_rate_rises_and_falls():
    rates = [tr.Schedule(epochs=10, rate=1.0, warm_up=0.2).rate_of(e) for e in range(1, 11)]
    assert rates[:3] == [0.5, 1.0, 8 / 9] and rates == sorted(rates[:2]) + sorted(rates[2:], reverse=True) and rates[-1] > 0


def test_stops_when_f1_no_longer_rises(spark, labelled):
    schedule = tr.Schedule(features=1 << 10, slices=2, epochs=10, patience=2)
    done = tr.train_validated(labelled, "id", "text", "label", schedule=schedule)
    n = done.history.count()
    scores = [(h["validation_f1"], -h["validation_loss"]) for h in done.history.orderBy("epoch").collect()]
    assert done.best_epoch == 1 + scores.index(max(scores)) and (n == 10 or n == done.best_epoch + 2)


def test_weighted_f1():
    assert tr.weighted_f1(np.array([[2, 0], [0, 3]])) == 1.0
    assert tr.weighted_f1(np.array([[0, 3], [0, 0]])) == 0.0
    assert abs(tr.weighted_f1(np.array([[1, 1], [1, 1]])) - 0.5) < 1e-12


def test_score_from_the_store_without_fitting(spark, labelled, tmp_path):
    done = tr.train_validated(labelled, "id", "text", "label", schedule=SMALL)
    assert tr.load_model(spark, str(tmp_path), "quality", "v1") is None
    tr.save_model(spark, done.model, str(tmp_path), "quality", "v1", SMALL)
    loaded = tr.load_model(spark, str(tmp_path), "quality", "v1")
    other = spark.createDataFrame([(1, "a perfect thing works"), (2, "broken refund"), (3, None)], "id int, text string")
    a, b = ([r["probabilities"] for r in tr.score_texts(other, "text", m).orderBy("id").collect()] for m in (done.model, loaded))
    assert np.allclose(a, b) and a[0][1] > 0.5 > a[1][1]
    with pytest.raises(Exception, match="exists"):
        tr.save_model(spark, done.model, str(tmp_path), "quality", "v1", SMALL)
