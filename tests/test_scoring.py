import pytest
from pyspark.sql import functions as F

from opinelake.operators import analytics as an
from opinelake.operators import scoring as sc
from opinelake.operators import topics as tp


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("We love the lamp and its perfect light makes me happy", ("positive", 1.0, 0.0, 0.0, 1.0)),
        ("A horrible smell and a useless manual that I regret reading", ("negative", 0.0, 1.0, 0.0, 1.0)),
        ("It came in a blue box with two cables", ("neutral", 0.33, 0.33, 0.34, 0.5)),
        ("A good lens on a bad strap", ("neutral", 0.5, 0.5, 0.0, 0.0)),
        ("", ("neutral", 0.33, 0.33, 0.34, 0.5)),
    ],
)
def test_lexicon(spark, text, expected):
    assert tuple(sc.score_lexicon(texts(spark, text), "text").select(*sc.SCORE_FIELDS).first()) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("The bag is well made and its zip feels solid", {"product_quality": "positive"}),
        (
            "A flimsy stand with a slow motor",
            {"product_quality": "negative", "performance": "negative"},
        ),
        ("", {"product_quality": "neutral", "shipping": "neutral", "packaging": "neutral"}),
    ],
)
def test_phrase_aspects(spark, text, expected):
    row = sc.score_phrase_aspects(texts(spark, text), "text").first()
    assert row["aspects"] == expected
    assert row["num_aspects_detected"] == len(expected) and row["total_aspects"] == 8
    assert set(row["aspect_scores"].values()) == {0.5}


def test_aggregate_aspects(spark):
    df = texts(spark, "Fast shipping of my lamp", "Flimsy stand, slow motor", "The set is good value")
    rows = {r["aspect"]: r for r in sc.aggregate_aspects(sc.score_phrase_aspects(df, "text")).collect()}
    assert set(rows) == {"product_quality", "shipping", "performance", "price"}
    assert (rows["product_quality"]["negative_pct"], rows["product_quality"]["coverage"]) == (100.0, 33.3)
    assert (rows["performance"]["positive_pct"], rows["performance"]["negative_pct"], rows["performance"]["coverage"]) == (50.0, 50.0, 66.7)
    assert rows["price"]["total_reviews"] == 3


def test_taxonomy_counts_opinions_only_near_the_keyword(spark):
    df = texts(spark, "The delivery was great. Setup is difficult and terrible!")
    aspects = sc.with_taxonomy_aspects(df, "text").first()["aspects"]
    assert aspects["shipping"]["sentiment"] == "positive" and aspects["usability"]["sentiment"] == "negative"
    assert aspects["usability"]["keywords"] == ["difficult", "setup"] and aspects["usability"]["score"] == 2


def test_combined_record_for_blank_text(spark):
    row = sc.analyse_texts(texts(spark, "  "), "text").first()
    assert (row["label"], row["neutral_score"], row["aspects"]) == ("neutral", 1.0, {})


def test_two_class_rule(spark):
    df = spark.createDataFrame([([0.45, 0.55],), ([0.1, 0.9],), ([0.8, 0.2],)], "p array<double>")
    rows = [tuple(r[0]) for r in df.select(sc.two_class_sentiment("p")).collect()]
    assert rows == [("neutral", 0.55, 0.45, 0.9, 0.9), ("positive", 0.9, 0.1, 0.2, 0.9), ("negative", 0.2, 0.8, 0.4, 0.8)]


def test_model_failure_falls_back_to_lexicon_row_by_row(spark):
    def load():
        def predict(batch):
            if any("boom" in t for t in batch):
                raise ValueError("boom")
            return [[0.1, 0.9] for _ in batch]

        return predict

    df = texts(spark, "fine", "boom bad", "", "also fine")
    rows = {r["id"]: r for r in sc.score_model(df, "text", load).collect()}
    assert [rows[i]["label"] for i in range(4)] == ["positive", "negative", "neutral", "positive"]
    assert [rows[i]["model_loaded"] for i in range(4)] == [True, False, True, True]


def test_zero_shot_threshold_and_fallback(spark):
    df = spark.createDataFrame(
        [("high quality", {"Price": [0.1, 0.6, 0.3]}), ("high quality", {"Price": [0.1, 0.2, 0.25]})],
        "text string, s map<string,array<double>>",
    )
    rows = sc.zero_shot_aspects(df, "text", "s").collect()
    assert rows[0]["aspects"] == {"price": "negative"} and rows[0]["aspect_scores"] == {"price": 0.6}
    assert rows[1]["aspects"] == {"product_quality": "positive"} and rows[1]["num_aspects_detected"] == 0


def test_rule_topics(spark):
    df = texts(
        spark, "Great product quality, very durable", "Fast shipping, arrived quickly", "Poor customer service, terrible support"
    )
    rows = tp.rule_topic_report(df, "text", "id").collect()
    assert {r["topic"] for r in rows} == {"product_quality", "shipping_delivery", "performance", "customer_service"}
    assert {r["count"] for r in rows} == {1}
    assert (rows[0]["outlier_count"], rows[0]["outlier_percentage"], rows[0]["unmatched_docs"]) == (-1, -33.33, 0)
    assert tp.rule_topic_report(df.filter("false"), "text", "id").count() == 0


def test_unfitted_topic_model_gives_minus_one(spark):
    assert tp.assign_topics(texts(spark, "x"), None).first()["topic_id"] == -1


def test_cohorts(spark):
    df = spark.createDataFrame([("product", "I love it"), ("product", "bad"), ("competitor", "nothing")], "cohort string, text string")
    rows = {r["cohort"]: r for r in an.cohort_comparison(sc.score_lexicon(df, "text"), "cohort").collect()}
    assert (rows["product"]["positive_pct"], rows["product"]["negative_pct"]) == (50.0, 50.0)
    assert rows["competitor"]["neutral_pct"] == 100.0


def test_batch_statistics(spark):
    df = texts(spark, "I love it", "  ", "hate")
    row = an.batch_statistics(sc.score_lexicon(df, "text"), F.trim("text") == "").first()
    assert (row["positive"], row["negative"], row["total_texts"], row["valid_texts"], row["invalid_texts"]) == (1, 1, 3, 2, 1)
