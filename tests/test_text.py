import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinelake.functions import text as tx
from opinelake.functions import values as vl


def one(spark, value, expr, dtype="string"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(expr.alias("r")).first()["r"]


REVIEW_CASES = [
    ("<b>Great!</b> I don't like 5% http://x.co/a me@x.com café_ok", "great i don't like 5 caf_ok"),
    (None, ""),
    ("  A B\n\nC  ", "ab c"),
    ("x@y", ""),
]
TWEET_CASES = [
    ("@bob loves #spark a@b.com 123 www.x.com! it's ok", "loves spark a com it's ok"),
    ("RT <i>hi</i> #one#two 4u", "rt hi onetwo u"),
]


@pytest.mark.parametrize("raw,expected", REVIEW_CASES)
def test_clean_text(spark, raw, expected):
    assert one(spark, raw, tx.clean_text("c")) == expected


@pytest.mark.parametrize("raw,expected", TWEET_CASES)
def test_clean_tweet_text(spark, raw, expected):
    assert one(spark, raw, tx.clean_tweet_text("c")) == expected


def python_clean(text, tweet):
    """The cleaning rule, step by step, in plain Python."""
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"http\S+|https\S+|www\.\S+", " ", text)
    if tweet:
        text = re.sub(r"#(\w+)", r"\1", re.sub(r"@\w+", " ", text))
    text = re.sub(r"\S+@\S+", " ", text)
    text = re.sub(r"[^\w\s']", " ", "".join(ch for ch in text if ord(ch) < 128))
    if tweet:
        text = re.sub(r"\d+", " ", text)
    return re.sub(r"\s+", " ", text).lower().strip()


ALPHABET = "aB9 _'<>@#.!\n\té /"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=20, max_size=40))
def test_cleaning_equals_the_stepwise_rule(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    rows = df.select("c", tx.clean_text("c").alias("r"), tx.clean_tweet_text("c").alias("t")).collect()
    for row in rows:
        assert row["r"] == python_clean(row["c"], False)
        assert row["t"] == python_clean(row["c"], True)


def test_cleaning_is_idempotent_on_clean_text(spark):
    df = spark.createDataFrame([("Some <b>Text</b> it's 5 o'clock!",)], "c string").select(tx.clean_text("c").alias("c"))
    assert df.select(tx.clean_text("c")).first()[0] == df.first()[0]


def test_tokens_drop_empty_and_short(spark):
    assert one(spark, "  One two three ", tx.tokens("c", 3)) == ["three"]
    assert one(spark, "", tx.tokens("c")) == []


def test_blank(spark):
    assert [one(spark, v, tx.is_blank("c")) for v in (None, "", " \t ", "x")] == [True, True, True, False]


def test_week_key_uses_iso_year(spark):
    assert one(spark, "2021-01-01", vl.week_key(F.col("c").cast("timestamp"))) == "2020-W53"


def test_lenient_date(spark):
    assert one(spark, "Mon Apr 06 22:19:45 UTC 2009", vl.iso_text(vl.lenient_tweet_date("c"))) == "2009-04-06T22:19:45"
    assert one(spark, "yesterday", vl.lenient_tweet_date("c")) is None


def test_labels(spark):
    assert [one(spark, v, vl.rating_label("c"), "int") for v in (1, 2, 3, 4, 5)] == ["negative"] * 2 + ["neutral"] + ["positive"] * 2
    assert [one(spark, v, vl.polarity_label("c"), "int") for v in (0, 2, 4, 3)] == ["negative", "neutral", "positive", None]


def test_softmax_is_stable_and_sums_to_one(spark):
    p = one(spark, [1000.0, 1001.0, 999.0], vl.softmax("c"), "array<double>")
    assert abs(sum(p) - 1) < 1e-12 and p[1] > p[0] > p[2]
    assert one(spark, [0.2, 0.9, 0.9], vl.argmax("c"), "array<double>") == 1


def test_aspect_json_accepts_both_shapes(spark):
    assert one(spark, '{"value": {"sentiment": "positive"}}', vl.aspect_sentiment("c", "value")) == "positive"
    assert one(spark, '{"value": "negative"}', vl.aspect_sentiment("c", "value")) == "negative"
    assert one(spark, "{broken", vl.aspect_sentiment("c", "value")) is None


def test_percentage_is_zero_guarded(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "a int, b int")
    assert [r[0] for r in df.select(vl.percentage("a", "b")).collect()] == [0.0, 33.33]


def test_cleaning_steps_keep_their_meaning(spark):
    """Every step against the plain patterns, over texts with each mark at each kind of place."""
    from functools import reduce

    parts = ["a@b.c", "@a", "a@", "a@@b", "@@b", "@", "x", "é@ü", "a @b", "<b>", "<", "http", "https://x@y", "www.", "#t_1", "#", "Z9_'", "-"]
    texts = [f"{a}{gap}{b}{end}" for a in parts for b in parts for gap in ("", " ", "\n") for end in ("", " c@d")]
    plain = {
        "cleaned": [(tx.HTML_TAG, " "), (tx.URL, " "), (r"(?U)\S+@\S+", " "), (tx.NON_ASCII, ""), (tx.NO_WORD, " ")],
        "tweet": [(tx.HTML_TAG, " "), (tx.URL, " "), (tx.MENTION, " "), (tx.HASHTAG, "$1"), (r"(?U)\S+@\S+", " "), (tx.NON_ASCII, ""), ("[^A-Za-z_']+", " ")],
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    want = [
        F.lower(F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.coalesce("t", F.lit(""))))).alias(f"plain_{n}")
        for n, steps in plain.items()
    ]
    for r in df.select("t", tx.clean_text("t").alias("cleaned"), tx.clean_tweet_text("t").alias("tweet"), *want).collect():
        assert (r["cleaned"], r["tweet"]) == (r["plain_cleaned"], r["plain_tweet"]), r["t"]


def test_a_long_word_is_walked_through_once(spark):
    """Before, each of its characters began a walk to its end: minutes for this text."""
    df = spark.createDataFrame([("x" * 300_000 + " a@b.c end",)], "t string")
    began = time.time()
    assert df.select(F.length(tx.clean_text("t")), F.length(tx.clean_tweet_text("t"))).first()[:] == (300_004, 300_008)
    assert time.time() - began < 20
