"""Column selection, validation, filters and record shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.functions import text as tx
from opinelake.functions import values as vl
from opinelake.schema import SENTIMENT_LABELS


def keep_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select([c for c in wanted if c in df.columns])


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for an expensive value that is filtered on afterwards.

    A filter on a plain column is pushed below the projection, and with it a second copy of the
    expression. A filter on a generated column stays where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def one_row_each(df: DataFrame, array: Column | str, name: str, *keep: str) -> DataFrame:
    """One row per non-null array element, next to the ``keep`` columns.

    Uses the outer form: for the plain ``explode`` the optimizer adds a filter on the array size
    below it, which computes an expensive array a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def top_rows(df: DataFrame, order: Sequence[Column | str], n: int, offset: int = 0) -> DataFrame:
    """First ``n`` rows by an order, always as a top-k: every task keeps its best rows only.

    Several projections on top of a plain ``limit`` are pushed below it and turn the top-k into a sort
    of all rows; they stop at the (otherwise idle) coalesce.
    """
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(n).coalesce(1)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Schema check when the plan is built; no job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def rating_in_range(df: DataFrame, rating: str = "Score", lo: int = 1, hi: int = 5) -> DataFrame:
    return df.filter(F.col(rating).between(lo, hi))


def length_in_range(df: DataFrame, text: str = "cleaned_text", lo: int = 10, hi: int = 2000) -> DataFrame:
    return df.filter(F.length(text).between(lo, hi))


def min_trimmed_length(df: DataFrame, text: str = "cleaned_text", n: int = 3) -> DataFrame:
    return df.filter(F.length(tx.strip(text)) >= n)


def valid_labels(df: DataFrame, label: str = "sentiment_label", valid: Sequence[str] = tuple(SENTIMENT_LABELS)) -> DataFrame:
    return df.filter(F.col(label).isin(*valid))


def invalid_labels(df: DataFrame, label: str = "sentiment_label", valid: Sequence[str] = tuple(SENTIMENT_LABELS)) -> DataFrame:
    """Labels that ``valid_labels`` removes, with their row counts."""
    return df.filter(~F.col(label).isin(*valid)).groupBy(label).agg(F.count("*").alias("rows"))


def for_product(df: DataFrame, product_id: str | None) -> DataFrame:
    """Equality filter; None and 'all' mean no filter."""
    return df if product_id in (None, "all") else df.filter(F.col("product_id") == product_id)


def look_back(df: DataFrame, ts: str, as_of, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows at or after ``as_of`` minus the window. ``as_of`` is given, so the result repeats."""
    return df.filter(F.col(ts) >= vl.since(as_of, days, hours))


def confidence_filter(df: DataFrame, below: float | None = None, acknowledged: bool | None = None) -> DataFrame:
    if below is not None:
        df = df.filter(F.col("confidence_score") < below)
    return df.filter(F.col("confidence_score") >= 0) if acknowledged else df


def with_label(reviews: DataFrame, sentiment: DataFrame, label: str) -> DataFrame:
    """Reviews whose stored prediction is ``label``; the filter runs below the join."""
    return reviews.join(sentiment.filter(F.col("predicted_sentiment") == label), "review_id")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; an empty frame means not found."""
    return df.filter(F.col(key) == value)


def blank_counts(df: DataFrame, text: str = "text") -> DataFrame:
    blank = tx.is_blank(text)
    return df.agg(
        F.count("*").alias("total_texts"),
        F.count_if(~blank).alias("valid_texts"),
        F.count_if(blank).alias("invalid_texts"),
    )


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~tx.is_blank(text))


def review_records(reviews: DataFrame, sentiment: DataFrame, preview: int = 200) -> DataFrame:
    """Review with its prediction as a nested record, null when there is none."""
    nested = F.struct(*[c for c in sentiment.columns if c != "review_id"])
    scored = sentiment.select("review_id", nested.alias("sentiment"))
    out = reviews.join(scored, "review_id", "left")
    for c in ("review_text", "cleaned_text"):
        if c in out.columns:
            out = out.withColumn(c, tx.truncate(c, preview))
    for c in ("review_date", "ingested_at"):
        if c in out.columns:
            out = out.withColumn(c, vl.iso_text(c))
    return out


def product_records(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Product with its review count; counted before the join, so a hot product stays cheap."""
    counts = reviews.groupBy("product_id").agg(F.count("*").alias("n"))
    price = F.when(F.col("price") != 0, F.col("price").cast("double"))
    return (
        products.join(counts, "product_id", "left")
        .withColumn("total_reviews", F.coalesce("n", F.lit(0)).cast("long"))
        .withColumn("price", price)
        .drop("n")
    )


def result_view(df: DataFrame) -> DataFrame:
    """Stored result in the shape of the dashboard, with defaults for missing values."""

    def num(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)).alias(c)

    return df.select(
        "review_id",
        F.coalesce("predicted_sentiment", F.lit("neutral")).alias("label"),
        num("positive_score"),
        num("negative_score"),
        num("neutral_score"),
        num("confidence_score"),
        F.coalesce("aspects", F.from_json(F.lit("{}"), df.schema["aspects"].dataType)).alias("aspects"),
    )


def by_category(products: DataFrame, category: str) -> DataFrame:
    return products.filter(F.col("category") == category)


def competitors(products: DataFrame) -> DataFrame:
    return products.filter("is_competitor")


def newest_reviews(
    reviews: DataFrame, product_id: str | None = None, rating: int | None = None, limit: int = 100
) -> DataFrame:
    """Newest reviews of a product and/or with a rating."""
    df = for_product(reviews, product_id)
    if rating is not None:
        df = df.filter(F.col("raw_rating") == rating)
    return top_rows(df, [F.desc("review_date"), "review_id"], limit)


def score_maps(df: DataFrame) -> DataFrame:
    """Probabilities per label as a map, next to the confidence."""
    pairs = []
    for label in SENTIMENT_LABELS:
        pairs += [F.lit(label), F.col(f"{label}_score")]
    return df.withColumn("probabilities", F.create_map(*pairs)).withColumn("confidence", F.col("confidence_score"))
