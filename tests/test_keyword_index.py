"""Keyword index against plain containment; bucketed tables against plain joins."""

import random

import pytest

from opinelake.operators import joins as jn
from opinelake.sources import bucketed as bk


def plain(texts, words):
    return sorted((i, w) for i, t in texts if t is not None for w in {w for w in words if w is not None} if w in t.lower())


def found(spark, texts, words):
    t = spark.createDataFrame(texts, "id long, body string")
    k = spark.createDataFrame([(w,) for w in words], "keyword string")
    return sorted(map(tuple, jn.keyword_index_matches(t, "id", "body", k).collect()))


def test_literal_cases(spark):
    texts = [(1, "The quick Brown fox"), (2, "abc ab a"), (3, None), (4, ""), (5, "brownbrown foxes"), (6, "é🙂ab🙂")]
    words = ["brown", "ab", "a", "", None, "fox", "ow", "quick brown", "zzzz", "foxes", "brown", "Brown", "🙂ab", "brownbrown foxes!"]
    assert found(spark, texts, words) == plain(texts, words)
    assert found(spark, texts, []) == []
    assert found(spark, [], words) == []


@pytest.mark.parametrize("n", [15, 10_000])
def test_many_keywords(spark, n):
    rng = random.Random(n)
    letters = "abcdefgh"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(n)]
    # A third of the texts repeat one keyword.
    texts = [(i, words[0] * 30 if i % 3 == 0 else "".join(rng.choices(letters + " ", k=200))) for i in range(120)]
    assert found(spark, texts, words) == plain(texts, words)


def test_substrings_are_looked_up_in_different_words_only(spark, monkeypatch):
    searched = []
    inner = jn._substring_matches
    monkeypatch.setattr(jn, "_substring_matches", lambda t, *rest: searched.append(t.count()) or inner(t, *rest))
    long = "ab" * 60
    texts = [(i, f"same words {long} again\tand again") for i in range(200)]
    words = ["am", "again", "abab", long[:70], "s w", "n\ta"]
    assert found(spark, texts, words[:4]) == plain(texts, words[:4]) and searched == [5]
    assert found(spark, texts, words) == plain(texts, words) and searched == [5, 5, 200]


def test_long_text_and_long_keyword(spark):
    rng = random.Random(5)
    body = "".join(rng.choices("abcé🙂 ", k=300_000))
    words = [body[i : i + n] for i, n in ((0, 500), (299_500, 500), (1000, 70), (77, 3))] + [body[500:999] + "#"]
    assert found(spark, [(1, body)], words) == plain([(1, body)], words)


def test_bucketed_join_needs_no_exchange(spark):
    reviews = spark.range(500).selectExpr("id AS review_id", "concat('t', id) AS review_text")
    results = spark.range(400).selectExpr("CAST(id AS int) AS review_id", "id % 3 AS label")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = bk.store_reviews(reviews, results, buckets=4)
        joined = jn.reviews_with_sentiment(left, right)
        summed = joined.groupBy("review_id").count()
        plan = summed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, joined.collect())) == sorted((i, f"t{i}", i % 3) for i in range(400))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "k long, v string")
    stored = bk.write_bucketed(df, "k", 3)
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
    assert bk.write_bucketed(df.limit(0), "k", 3).count() == 0
