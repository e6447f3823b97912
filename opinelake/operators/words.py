"""Word counts and trending topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.functions import text as tx
from opinelake.operators.joins import keyword_matches
from opinelake.operators.ordering import bottom_k, top_k
from opinelake.operators.projections import for_product, look_back, one_row_each, top_rows
from opinelake.operators.ranking import seeded_sample
from opinelake.operators.windows import first_n, mode_by_count


def word_counts(texts: DataFrame, text: str, longer_than: int) -> DataFrame:
    """Frequency of whitespace tokens with more than ``longer_than`` characters (map-side partial counts)."""
    words = one_row_each(texts, F.split(F.lower(F.col(text)), tx.UNICODE_SPACES), "word")
    return words.filter(F.length("word") > longer_than).groupBy("word").agg(F.count("*").alias("frequency"))


def trending_keywords(
    reviews: DataFrame,
    sentiment: DataFrame,
    product_id: str | None = None,
    label: str | None = None,
    top_n: int = 20,
    max_reviews: int | None = None,
) -> DataFrame:
    """Most frequent words. ``max_reviews`` limits the scan to the first reviews by id; default is all of them."""
    df = for_product(reviews, product_id)
    if label:
        keys = sentiment.filter(F.col("predicted_sentiment") == label).select("review_id")
        df = df.join(keys, "review_id", "left_semi")
    if max_reviews is not None:
        df = top_rows(df, ["review_id"], max_reviews)
    analysed = df.agg(F.count("*")).scalar()
    top = top_k(word_counts(df, "cleaned_text", 3), "word", "frequency", top_n)
    return top.withColumn("total_reviews_analyzed", analysed)


def trending_topics(
    reviews: DataFrame,
    sentiment: DataFrame,
    as_of,
    hours: int = 168,
    top_n: int = 15,
    product_id: str | None = None,
    first_reviews: int = 20,
) -> DataFrame:
    """Top words of the window, each with the dominant label of the first reviews that contain it."""
    recent = look_back(for_product(reviews, product_id), "ingested_at", as_of, hours=hours)
    recent = recent.select("review_id", "cleaned_text")
    top = top_k(word_counts(recent, "cleaned_text", 3), "word", "frequency", top_n)
    hits = keyword_matches(recent, "cleaned_text", top, "word").select("word", "review_id")
    leading = first_n(hits, "word", ["review_id"], first_reviews)
    labelled = leading.join(sentiment.select("review_id", "predicted_sentiment"), "review_id")
    modes = mode_by_count(labelled, "word", "predicted_sentiment", "review_id", "dominant_sentiment")
    return top.join(modes, "word", "left").select(
        F.col("word").alias("keyword"),
        "frequency",
        F.coalesce("dominant_sentiment", F.lit("neutral")).alias("dominant_sentiment"),
        recent.agg(F.count("*")).scalar().alias("total_reviews_analyzed"),
    )


def trending_words(texts: DataFrame, text: str, stop_words: Sequence[str], top_n: int = 10) -> DataFrame:
    """Most frequent words of three or more letters that are no stop words."""
    words = one_row_each(texts, tx.trend_words(text), "word")
    kept = words.filter(~F.col("word").isin(*stop_words)) if stop_words else words
    return top_k(kept.groupBy("word").agg(F.count("*").alias("frequency")), "word", "frequency", top_n)


def word_frequency_report(
    texts: DataFrame, text: str, key: str, top_n: int = 20, sample_size: int | None = None, seed: int = 42
) -> DataFrame:
    """Top and bottom words with the number of different and of all words.

    ``sample_size`` counts words in a seeded sample of the texts; default is all texts. With fewer
    than ``top_n`` different words there is no bottom list.
    """
    df = texts if sample_size is None else seeded_sample(texts, key, sample_size, seed)
    counts = word_counts(df, text, 2)
    unique, total = counts.agg(F.count("*")).scalar(), counts.agg(F.sum("frequency")).scalar()
    top = top_k(counts, "word", "frequency", top_n)
    rare = bottom_k(counts, "word", "frequency", top_n).filter(unique >= top_n)

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("list"), "word", "frequency", unique.alias("unique_words"), total.alias("total_words"))

    return rows(top, "most_frequent").unionByName(rows(rare, "least_frequent"))


def default_stop_words(spark) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
