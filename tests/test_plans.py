import pytest
from pyspark.sql import functions as F

from opinelake.functions import values as vl
from opinelake.operators import analytics as an
from opinelake.operators import integrity as ig
from opinelake.operators import ordering as od
from opinelake.operators import profile as pf
from opinelake.operators import words as wd
from opinelake.plans import corpus, ingest
from opinelake.schema import PRODUCTS, REVIEW_CSV, REVIEWS, TWEET_CSV
from opinelake.sources import readers as rd

def now():
    return vl.as_of_literal("2001-08-01")


def raw_reviews(spark, rows):
    """rows: (Id, ProductId, Score, Text)."""
    full = [(i, p, "u", "n", 1, 2, s, 1000, f"sum {i}", t) for i, p, s, t in rows]
    return spark.createDataFrame(full, REVIEW_CSV)


def test_review_cleaning_pipeline(spark):
    df = corpus.preprocess_reviews(
        raw_reviews(
            spark,
            [
                (2, "p", 5, "A <b>really</b> good product"), (1, "p", 1, "A <b>really</b> good product"), (3, "p", 9, "rating is wrong"),
                (4, "p", 3, None), (5, "p", 3, "short"), (6, "p", 3, "long enough text"),
            ],
        )
    )
    rows = {r["Id"]: r for r in df.collect()}
    assert set(rows) == {1, 6}
    assert rows[1]["cleaned_text"] == "a really good product" and rows[1]["sentiment_label"] == "negative"
    assert rows[6]["helpfulness_ratio"] == 0.5 and rows[6]["source"] == "amazon" and "Time" not in df.columns


def test_tweet_pipeline_and_conditional_merge(spark, tmp_path):
    tweets = spark.createDataFrame(
        [(4, 1, "Mon Apr 06 22:19:45 UTC 2009", "q", "u", "@me this is a nice day"), (3, 2, "x", "q", "u", "unmapped polarity code")],
        TWEET_CSV,
    )
    out = corpus.preprocess_tweets(tweets).collect()
    assert [r["cleaned_text"] for r in out] == ["this is a nice day"]
    reviews = raw_reviews(spark, [(1, "p", 5, "a really good product")])
    sources = {"amazon": lambda: corpus.preprocess_reviews(reviews), "twitter": lambda: corpus.preprocess_tweets(tweets)}
    merged, report = corpus.run_corpus(spark, sources, str(tmp_path / "ok"))
    assert merged.count() == 2 and {r["status"] for r in report.collect()} == {"completed"}

    def broken():
        raise FileNotFoundError("gone")

    merged, report = corpus.run_corpus(spark, {**sources, "twitter": broken}, str(tmp_path / "bad"))
    assert merged is None
    assert {r["source"]: r["status"] for r in report.collect()} == {"amazon": "completed", "twitter": "failed"}


def test_csv_round_trip_with_quotes_and_line_breaks(spark, tmp_path):
    text = 'He said "fine",\nthen left  '
    rd.write_cleaned(raw_reviews(spark, [(1, "p", 5, text)]), str(tmp_path / "csv"), "csv")
    assert rd.read_reviews_csv(spark, str(tmp_path / "csv")).first()["Text"] == text


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rd.read_reviews_csv(spark, str(tmp_path / "nothing"))


def test_encoding_fallback(spark, tmp_path):
    schema = rd.T.StructType().add("id", "integer").add("text", "string")
    (tmp_path / "latin.csv").write_bytes("id,text\n1,café\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("id,text\n1,café\n".encode())
    for name in ("latin", "utf"):
        assert rd.read_csv_any_encoding(spark, str(tmp_path / f"{name}.csv"), schema).first()["text"] == "café"
    (tmp_path / "own.csv").write_bytes("id,text\n2,a\ufffdb\n".encode())  # valid UTF-8 that holds the replacement character
    both = rd.read_csv_any_encoding(spark, str(tmp_path), schema, multi_line=False).collect()
    assert sorted(r["text"] for r in both) == ["a\ufffdb", "café", "café"]


def products(spark, *ids):
    return spark.createDataFrame([(i, None, i, None, "c", None, False, None, None) for i in ids], PRODUCTS)


def reviews(spark, *rows):
    return spark.createDataFrame(list(rows), "review_id long, product_id string").select(
        *[F.col(f.name).cast(f.dataType) if f.name in ("review_id", "product_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in REVIEWS]
    )


def test_ingest_numbers_and_creates(spark):
    incoming = spark.createDataFrame(
        [(1, " I love it ", None), (2, "  ", "p"), (3, "bad", "p"), (4, "shipping was great", "new")], "k long, text string, product_id string"
    )
    load = ingest.ingest_reviews(incoming, "k", products(spark, "p"), reviews(spark, (10, "p")), now())
    rows = load.reviews.collect()
    assert sorted(r["review_id"] for r in rows) == [11, 12, 13]
    assert {r["review_text"]: r["product_id"] for r in rows} == {"I love it": "unknown", "bad": "p", "shipping was great": "new"}
    assert {r["product_id"] for r in load.products.collect()} == {"p", "unknown", "new"}
    labels = {r["predicted_sentiment"] for r in load.sentiment_results.collect()}
    assert labels == {"positive", "negative"} and load.sentiment_results.count() == 3


def test_ingest_takes_names_of_new_products_from_the_first_row(spark):
    incoming = spark.createDataFrame(
        [(2, "b", "new", "Second", "x"), (1, "a", "new", "First", None), (3, "c", "p", "Ignored", "y"), (4, "d", None, None, None)],
        "k long, text string, product_id string, product_name string, category string",
    )
    load = ingest.ingest_reviews(incoming, "k", products(spark, "p"), reviews(spark), now())
    got = {r["product_id"]: (r["product_name"], r["category"]) for r in load.products.collect()}
    assert got == {"p": ("p", "c"), "new": ("First", "general"), "unknown": ("unknown", "general")}


def test_ingest_into_empty_tables_repeats(spark):
    incoming = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "k long, text string")
    ids = []
    for parts in (1, 5):
        load = ingest.store_predictions(incoming.repartition(parts), "k", products(spark), reviews(spark), now())
        ids.append({r["review_text"]: r["review_id"] for r in load.reviews.collect()})
    assert ids[0] == ids[1] and sorted(ids[0].values()) == list(range(1, 51))
    assert [(r["product_id"], r["product_name"]) for r in load.products.collect()] == [("default", "Standalone Prediction")]


def test_seed_load(spark):
    raw = raw_reviews(spark, [(i, f"p{i % 25}", 5, f"text {i}") for i in range(50)])
    load = ingest.seed_load(raw, products(spark), now())
    assert load.products.count() == 25 and load.reviews.count() == 50
    load = ingest.seed_load(raw, products(spark), now(), max_products=20)
    assert load.products.count() == 20 and load.reviews.count() == 40
    assert ingest.seed_load(raw, products(spark, "x"), now()) is None


def test_stored_loads(spark, tmp_path):
    root = str(tmp_path / "tables")
    raw = raw_reviews(spark, [(1, "a", 5, "I love it"), (2, "b", 9, "odd rating"), (3, "a", 1, "bad"), (3, "a", 1, "copy")])
    load = ingest.seed_load(raw, products(spark), now(), staging=str(tmp_path / "staged"))
    orphan = load.reviews.limit(1).withColumns({"review_id": F.lit(7).cast("long"), "product_id": F.lit("gone")})
    load = load._replace(reviews=load.reviews.unionByName(orphan))
    got = {(r["table"], r["key"], *r["violations"]) for r in ingest.store(load, root, now()).collect()}
    assert got == {
        ("reviews", "2", "rating_out_of_range"), ("reviews", "7", "product_missing"), ("sentiment_results", "2", "review_missing")
    }
    for _ in range(2):  # storing it again adds nothing
        table = {name: rd.read_table(spark, root, name).collect() for name in ingest.Load._fields}
        assert sorted(r["product_id"] for r in table["products"]) == ["a", "b"] and all(r["created_at"] for r in table["products"])
        assert sorted((r["review_id"], r["review_text"], r["helpful_votes"]) for r in table["reviews"]) == [(1, "I love it", 0), (3, "bad", 0)]
        assert sorted((r["result_id"], r["review_id"]) for r in table["sentiment_results"]) == [(1, 1), (3, 3)]
        ingest.store(load, root, now())


def test_constraints_and_acks(spark):
    rows = spark.createDataFrame([(1, 6, ""), (2, None, "ok"), (3, 3, "ok")], "review_id long, raw_rating short, review_text string")
    bad = {r["review_id"]: r["violations"] for r in ig.quarantined(rows, ig.review_checks()).collect()}
    assert bad == {1: ["rating_out_of_range", "text_empty"]}
    assert ig.accepted(rows, ig.review_checks()).count() == 2
    results = spark.createDataFrame([(1,), (2,)], "result_id long")
    acks = ig.acknowledge(None, results, spark.createDataFrame([(1,), (1,), (9,)], "result_id long"), now())
    assert [r["result_id"] for r in acks.collect()] == [1]
    assert ig.acknowledge(acks, results, results, now()).collect()[0]["result_id"] == 2


def sentiment(spark, *rows):
    return spark.createDataFrame(
        list(rows), "review_id long, predicted_sentiment string, confidence_score double, analyzed_at string"
    ).withColumns({"result_id": F.col("review_id"), "analyzed_at": F.col("analyzed_at").cast("timestamp")})


def test_alert_lists(spark):
    rv = reviews(spark, (1, "a"), (2, "a"), (3, "b"))
    se = sentiment(spark, (1, "positive", 0.4, "2001-07-01"), (2, "negative", 0.9, "2001-07-02"), (3, "neutral", 0.2, "2001-07-03"))
    assert [r["id"] for r in od.alert_list(rv, se).collect()] == [3, 2, 1]
    assert [r["id"] for r in od.alert_list(rv, se, limit=1, offset=1).collect()] == [2]
    assert od.alert_list(rv, se, product_id="b").first()["message"] == "Sentiment prediction: neutral (confidence: 0.20)"
    # The limit comes before the filter: the newest two hold one low-confidence row.
    assert [r["id"] for r in od.alert_check(rv, se, newest=2).collect()] == [3]
    acks = spark.createDataFrame([(3,), (3,)], "result_id long")
    assert [r["id"] for r in od.alert_list(rv, se, acks=acks, acknowledged=False).collect()] == [2, 1]
    assert [r["id"] for r in od.alert_list(rv, se, acks=acks, acknowledged=True).collect()] == [3]
    assert [(r["id"], r["acknowledged"]) for r in od.alert_list(rv, se, acks=acks, limit=2).collect()] == [(3, True), (2, False)]
    orphan = se.unionByName(sentiment(spark, (9, "negative", 0.1, "2001-07-04")))
    assert [(r["id"], r["product_id"]) for r in od.alert_list(rv, orphan, limit=2).collect()] == [(9, None), (3, "b")]


def test_alert_pages_are_taken_before_the_join(spark):
    rv, se = reviews(spark, *[(i, "a") for i in range(9)]), sentiment(spark, *[(i, "positive", 0.4, "2001-07-01") for i in range(9)])
    acks = spark.createDataFrame([(3,)], "result_id long")
    for out in (od.alert_list(rv, se, acks=acks), od.alert_check(rv, se), od.recent_alerts(rv, se, "2001-07-02")):
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        joins = [i for i, line in enumerate(plan) if "Join" in line]
        # Below each outer join lies a page, or what a page has picked from the other table.
        assert joins and all("LeftSemi" in plan[i] or any("LocalLimit" in x for x in plan[i + 1 : i + 6]) for i in joins)


def test_empty_inputs_give_zeros(spark):
    rv = reviews(spark)
    se = sentiment(spark).withColumns({f"{s}_score": F.lit(0.0) for s in ("positive", "negative", "neutral")})
    assert [(r["count"], r["percentage"], r["total"]) for r in an.sentiment_distribution(rv, se).collect()] == [(0, 0.0, 0)] * 3
    assert set(an.average_scores(rv, se).first().asDict().values()) == {0.0}
    assert [r["count"] for r in an.rating_distribution(rv).collect()] == [0] * 5


def test_pages_beyond_the_end_are_empty(spark):
    rv = reviews(spark, *[(i, "a") for i in range(5)])
    se = sentiment(spark, *[(i, "positive", 0.5, "2001-01-01") for i in range(5)])
    assert od.review_page(rv, se, page=2, per_page=3).count() == 2
    assert od.review_page(rv, se, page=9, per_page=3).count() == 0
    assert od.review_page(rv, se, page=1, per_page=3).first()["pages"] == 2


def test_keyword_limits_are_optional(spark):
    rv = spark.createDataFrame([(i, f"word{i} same") for i in range(10)], "review_id long, cleaned_text string")
    top = wd.trending_keywords(rv, rv, top_n=1).first()
    assert (top["word"], top["frequency"], top["total_reviews_analyzed"]) == ("same", 10, 10)
    assert wd.trending_keywords(rv, rv, top_n=1, max_reviews=4).first()["frequency"] == 4
    assert wd.word_frequency_report(rv, "cleaned_text", "review_id", top_n=2, sample_size=3).first()["total_words"] == 6
    assert {r["list"] for r in wd.word_frequency_report(rv, "cleaned_text", "review_id", top_n=20).collect()} == {"most_frequent"}


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "c", 1.5)], "id int, name string, score double")
    rows = [(r["column"], r["missing_count"], r["total_missing"]) for r in pf.missing_values(df).collect()]
    assert rows == [("score", 2, 3), ("name", 1, 3)]
    assert pf.target_column(df) == "score"
    assert pf.dataset_profile(df).count() == 3
    wide = spark.range(50).select(F.col("id").cast("double").alias("rating"))
    stats = {r["statistic"]: r["value"] for r in pf.target_profile(wide).collect()}
    assert stats["count"] == 50 and stats["mean"] == 24.5 and stats["max"] == 49


def test_upsert_keeps_the_key_unique(spark):
    from opinelake.operators.integrity import upsert

    table = spark.createDataFrame([("a", 1, 0)], "id string, v int, created_at int")
    changes = spark.createDataFrame([("a", 5), ("a", 7), ("b", 2), ("b", 2)], "id string, v int")
    rows = upsert(table, changes, "id", F.lit(9)).collect()
    assert sorted((r["id"], r["v"], r["created_at"]) for r in rows) == [("a", 7, 0), ("b", 2, 9)]


def test_stored_products_are_not_broadcast(spark, tmp_path):
    """Before, the ids of a table that compresses well were sent to the driver, since one column of it looks small."""
    from opinelake.operators.joins import get_or_create_products

    path = str(tmp_path / "products")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("product_id"), F.lit("n").alias("product_name"), F.lit("c").alias("category"))
    rows.withColumn("is_competitor", F.lit(False)).write.parquet(path)
    incoming = spark.range(990, 1010).select(F.when(F.col("id") != 995, F.col("id").cast("string")).alias("product_id"))
    out = get_or_create_products(incoming, spark.read.parquet(path), F.col("product_id"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == 1011 and out.filter("product_id is null").count() == 1
