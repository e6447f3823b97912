"""Maintained views against views from scratch; deep pages against plain offsets."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from opinelake.operators import analytics as an
from opinelake.operators import ordering as od
from opinelake.plans.views import DashboardViews

DAY = 86_400


def tables(spark, ids, product):
    rows = [(i, product(i), i % 5 + 1 if i % 7 else None, None if i % 11 == 0 else (i % 9) * DAY) for i in ids]
    reviews = spark.createDataFrame(rows, "review_id long, product_id string, raw_rating int, s long").withColumn(
        "review_date", F.timestamp_seconds("s")
    ).drop("s")
    labels = ["positive", "negative", "neutral"]
    scored = [(i, labels[i % 3], 0.5, 0.25, 0.25, 0.5 + i % 2 / 4) for i in ids if i % 4]
    kind = "review_id long, predicted_sentiment string, positive_score double, negative_score double, neutral_score double, confidence_score double"
    return reviews, spark.createDataFrame(scored, kind)


def rows(df):
    return sorted(map(str, df.collect()))


def test_loads_add_up(spark, tmp_path):
    products = spark.createDataFrame([(f"p{i}", f"name {i}", f"c{i % 2}") for i in range(12)], "product_id string, product_name string, category string")
    views = DashboardViews(str(tmp_path / "views"), buckets=4)
    parts = [range(0, 60), range(60, 61), range(0), range(61, 150), range(150, 155), range(155, 300)]
    every = []
    for load, ids in enumerate(parts):
        # A third of all reviews is of one product; some have a product that is not listed, or none.
        part = tables(spark, list(ids), lambda i: "p1" if i % 3 == 0 else None if i % 50 == 1 else f"p{i % 14}")
        every.append(part)
        views.load(*part, load)
        if load in (1, 3):
            views.load(*part, load)  # a repeat changes nothing
        reviews, results = _all(every, 0), _all(every, 1)
        if load in (1, 5):
            assert rows(views.product_summary(products, reviews, results, load + 1)) == rows(an.product_summary(products, reviews, results))
            assert rows(views.daily_category_trend(products, reviews, results, load + 1)) == rows(an.daily_category_trend(products, reviews, results))


def _all(every, side):
    out = every[0][side]
    for part in every[1:]:
        out = out.unionByName(part[side])
    return out


def test_a_load_writes_its_own_groups_and_one_bucket(spark, tmp_path):
    views = DashboardViews(str(tmp_path / "views"), buckets=4)
    views.load(*tables(spark, list(range(400)), lambda i: f"p{i}"), 0)
    views.load(*tables(spark, [1000], lambda i: "p5"), 1)
    written = spark.read.parquet(*glob.glob(str(tmp_path / "views/products/batch=000000001")))
    other = written.filter("product_id <> 'p5'").select("bucket").distinct().collect()
    assert len(other) <= 1 and written.filter("product_id = 'p5'").first()["total_reviews"] == 2
    assert written.count() < 200


@pytest.mark.parametrize("per_page", [7, 100])
def test_deep_pages(spark, per_page):
    rng = random.Random(3)
    # A third of the rows share one time, some have none, ids are not in the order of time.
    times = [None if i % 37 == 0 else 1_000 if i % 3 == 0 else rng.randint(0, 100_000_000) for i in range(3000)]
    ids = rng.sample(range(-5_000, 10**12), 3000)
    df = spark.createDataFrame(list(zip(ids, times)), "review_id long, s long").select(
        "review_id", F.lit("p").alias("product_id"), F.timestamp_seconds("s").alias("ingested_at")
    ).cache()
    expected = [i for i, _ in sorted(zip(ids, times), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    none = spark.createDataFrame([], "review_id long, predicted_sentiment string")
    last = -(-3000 // per_page)
    for page in (1, 2, last // 3, last // 2, last - 1, last, last + 1, 10**6):
        got = od.review_page(df, none, page=page, per_page=per_page, near=50).collect()
        start = (page - 1) * per_page
        assert [r["review_id"] for r in got] == expected[start : start + per_page]
        assert all(r["total"] == 3000 for r in got)
    empty = df.filter("false")
    assert od.review_page(empty, none, page=100, near=50).count() == 0


def test_skip_leaves_few_rows(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 3).alias("k"))
    left, offset = od.skip_to(df, [F.col("k"), F.col("id")], 70_000, near=100)
    assert offset <= 100 and left.orderBy("k", "id").offset(offset).first()["id"] == 3 * (70_000 - 33_334 - 33_333) + 2


def test_groups_of_one_bucket_are_written_by_several_tasks(spark, tmp_path):
    """Before, one task wrote a bucket, however many groups it had."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        views = DashboardViews(str(tmp_path / "views"), buckets=2)
        views.load(*tables(spark, range(200), lambda i: f"p{i}"), 0)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    for bucket in range(2):
        assert len(glob.glob(f"{tmp_path}/views/products/batch=*/bucket={bucket}/*.parquet")) > 1
