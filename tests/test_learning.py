import pytest
from pyspark.sql import functions as F

from opinelake.functions import values as vl
from opinelake.operators import evaluation as ev
from opinelake.operators import learning as ln
from opinelake.operators import profile as pf
from opinelake.operators import projections as pr
from opinelake.operators import topics as tp
from opinelake.plans import dataset


def predictions(spark, true, pred):
    return spark.createDataFrame(list(zip(range(len(true)), true, pred)), "id int, true_id int, pred_id int")


def test_perfect_prediction(spark):
    row = ev.overall_metrics(predictions(spark, [0, 1, 2, 0, 1, 2], [0, 1, 2, 0, 1, 2])).first()
    assert tuple(row) == (1.0, 1.0, 1.0, 1.0, 6, 6, 0)


def test_all_wrong(spark):
    row = ev.overall_metrics(predictions(spark, [0, 0, 0], [1, 1, 1])).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.0, 0.0, 0.0)


def test_mixed(spark):
    df = predictions(spark, [0, 1, 2, 0, 1, 2], [0, 1, 1, 0, 2, 2])
    assert ev.overall_metrics(df).first()["accuracy"] == 0.6667
    assert [r["f1_score"] for r in ev.per_class_metrics(df).collect()] == [1.0, 0.5, 0.5]
    assert ev.confusion_matrix(df).count() == 3
    report = {r["label"]: r["f1_score"] for r in ev.classification_report(df).collect()}
    assert report["macro avg"] == 0.6667 and report["weighted avg"] == 0.6667
    assert ev.outcome_counts(df).first()["misclassification_rate"] == 33.33


def test_support(spark):
    rows = ev.per_class_metrics(predictions(spark, [0, 0, 0, 1, 1, 2], [0] * 6)).collect()
    assert [r["support"] for r in rows] == [3, 2, 1]


def test_misclassified_order(spark):
    df = spark.createDataFrame(
        [(0, 0, 1, [0.2, 0.7, 0.1], "a" * 300), (1, 1, 0, [0.8, 0.1, 0.1], "b")],
        "id int, true_id int, pred_id int, probabilities array<double>, text string",
    )
    rows = ev.misclassified(df).collect()
    assert [(r["true_label"], r["predicted_label"], r["confidence"]) for r in rows] == [
        ("neutral", "negative", 0.8), ("negative", "neutral", 0.7),
    ]
    assert len(rows[1]["text"]) == 200 and rows[0]["total_misclassified"] == 2


def labelled(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, cleaned_text string, sentiment_label string")


def test_validation(spark):
    base = [("Great product", "positive"), ("Terrible item", "negative"), ("Okay", "neutral")]
    assert dataset.validate(labelled(spark, base), "id").count() == 3
    assert dataset.validate(labelled(spark, base + [("Invalid", "unknown")]), "id").count() == 3
    assert dataset.validate(labelled(spark, base + [("Okay", "neutral"), (None, "neutral")]), "id").count() == 3
    short = [("Great product!", "positive"), ("OK", "neutral"), ("A", "negative")]
    assert dataset.validate(labelled(spark, short), "id").count() == 1
    with pytest.raises(ValueError, match="Missing required columns"):
        dataset.validate(spark.createDataFrame([("x",)], "wrong_col string"), "id")


def test_invalid_label_report(spark):
    rows = pr.invalid_labels(labelled(spark, [("a", "odd"), ("b", "odd"), ("c", "positive")])).collect()
    assert [(r["sentiment_label"], r["rows"]) for r in rows] == [("odd", 2)]


def test_class_balance(spark):
    rows = {r["sentiment_label"]: r for r in pf.class_balance(
        labelled(spark, [("a", "positive"), ("b", "positive"), ("c", "negative"), ("d", "neutral"), ("e", "positive")])
    ).collect()}
    assert {k: r["count"] for k, r in rows.items()} == {"positive": 3, "negative": 1, "neutral": 1}
    assert rows["positive"]["total"] == 5 and rows["positive"]["percentage"] == 60.0


def test_encoding(spark):
    df = labelled(spark, [("good good product", "positive"), ("a b c d e", "neutral"), ("", "neutral"), (None, "neutral")])
    rows = {r["id"]: r for r in ln.encode(df, "cleaned_text", ["good", "product"], max_length=6).collect()}
    assert rows[0]["input_ids"] == [2, 4, 4, 5, 3, 0] and rows[0]["attention_mask"] == [1, 1, 1, 1, 1, 0]
    assert rows[1]["input_ids"] == [2, 1, 1, 1, 1, 3]
    assert rows[2]["input_ids"] == rows[3]["input_ids"] == [2, 3, 0, 0, 0, 0]


def test_prepare_writes_once(spark, tmp_path):
    rows = [(f"text number {i} is {'fine' if i % 2 else 'bad'}", ("positive", "negative", "neutral")[i % 3]) for i in range(60)]
    out = dataset.prepare(labelled(spark, rows), "id", str(tmp_path / "d"))
    assert out.count() == 60
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 48, "validation": 6, "test": 6}
    again = dataset.prepare(labelled(spark, rows[:10]), "id", str(tmp_path / "d"))
    assert again.count() == 60
    assert dataset.prepare(labelled(spark, rows[:30]), "id", str(tmp_path / "d"), force_recreate=True).count() == 30


def test_training_registers_a_version_once(spark):
    df = spark.createDataFrame([(f"{'nice' if i % 2 else 'ugly'} thing {i}", i % 2) for i in range(40)], "cleaned_text string, label int")
    config = ln.TrainConfig(features=256, reg_params=(0.01, 0.1), folds=2, max_iter=5)
    model = ln.train_classifier(df, config)
    scored = model.transform(df).select(F.col("label").alias("true_id"), F.col("prediction").cast("int").alias("pred_id"))
    assert ev.overall_metrics(scored).first()["accuracy"] > 0.9
    from opinelake.schema import MODEL_VERSIONS

    empty = spark.createDataFrame([], MODEL_VERSIONS)
    row = ln.register_model(empty, "m", "v1", ev.overall_metrics(scored), config, vl.as_of_literal("2001-01-01"))
    assert row.first()["version_id"] == 1 and row.first()["parameters"]["seed"] == "42"
    stored = spark.createDataFrame(row.collect(), MODEL_VERSIONS)
    assert ln.register_model(stored, "m", "v1", ev.overall_metrics(scored), config, vl.as_of_literal("2001-01-01")).count() == 0


def test_ngrams_and_frequency_bounds(spark):
    df = spark.createDataFrame([(i, "the red apple pie") for i in range(6)] + [(9, "green pear")], "id long, t string")
    vocabulary = {r["term"]: r["doc_freq"] for r in tp.ngram_vocabulary(df, "t", ["the"], min_df=5, max_df=1.0).collect()}
    assert vocabulary == {"red": 6, "apple": 6, "pie": 6, "red apple": 6, "apple pie": 6}
    assert tp.ngram_vocabulary(df, "t", ["the"], min_df=5, max_df=0.8).count() == 0


def test_class_tf_idf_equals_formula(spark):
    import math

    df = spark.createDataFrame([(0, "aa bb aa"), (1, "bb cc"), (1, "cc cc")], "topic int, t string")
    got = {(r["topic"], r["term"]): r["weight"] for r in tp.class_tf_idf(df, "t", "topic", [], 1, 1.0).collect()}
    tf = {(0, "aa"): 2, (0, "bb"): 1, (0, "aa bb"): 1, (0, "bb aa"): 1, (1, "bb"): 1, (1, "cc"): 3, (1, "bb cc"): 1, (1, "cc cc"): 1}
    mean = sum(tf.values()) / 2
    for (topic, term), n in tf.items():
        f = sum(v for (_, w), v in tf.items() if w == term)
        assert got[(topic, term)] == pytest.approx(n * math.log(1 + mean / f))


def test_topic_sizes_below_minimum_become_outliers(spark):
    rows = [(i, "alpha beta gamma") for i in range(20)] + [(100 + i, "delta epsilon zeta") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, t string")
    assigned = tp.assign_topics(df, tp.fit_topics(df, "t", k=2, features=64), min_topic_size=5)
    assert {r["topic_id"]: r["count"] for r in assigned.groupBy("topic_id").count().collect()} == {0: 20, -1: 3}
