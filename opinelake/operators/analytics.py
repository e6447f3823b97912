"""Dashboard aggregates over reviews, predictions and products.

Wherever products come in, reviews are aggregated per product first (map-side partial sums), so a
product that owns a large part of all reviews never becomes one large join task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.functions import values as vl
from opinelake.lexicons import ASPECT_TAXONOMY
from opinelake.operators.joins import competitors_of, lookup_in_order, reviews_with_sentiment
from opinelake.operators.projections import for_product, look_back
from opinelake.schema import SENTIMENT_LABELS

SCORES = ["positive_score", "negative_score", "neutral_score", "confidence_score"]


def _is(label: str) -> Column:
    return F.col("predicted_sentiment") == label


def _label_counts(suffix: str = "") -> list[Column]:
    return [F.count_if(_is(label)).alias(f"{label}{suffix}") for label in SENTIMENT_LABELS]


def _to_rows(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One-row aggregate to one row per struct: gives zero-filled dimensions without a join."""
    return one_row.select(F.inline(F.array(*structs)))


def sentiment_distribution(reviews: DataFrame, sentiment: DataFrame, product_id: str | None = None) -> DataFrame:
    df = reviews_with_sentiment(
        for_product(reviews, product_id).select("review_id"), sentiment.select("review_id", "predicted_sentiment")
    )
    counts = df.agg(*_label_counts(), F.count("*").alias("total"))
    return _to_rows(
        counts,
        [
            F.struct(
                F.lit(label).alias("sentiment"),
                F.col(label).alias("count"),
                vl.percentage(label, "total").alias("percentage"),
                F.col("total").alias("total"),
            )
            for label in SENTIMENT_LABELS
        ],
    )


def average_scores(reviews: DataFrame, sentiment: DataFrame, product_id: str | None = None) -> DataFrame:
    df = reviews_with_sentiment(for_product(reviews, product_id).select("review_id"), sentiment.select("review_id", *SCORES))
    return df.agg(*[vl.mean_or_zero(s).alias(f"avg_{s}") for s in SCORES])


def overall_stats(reviews: DataFrame, sentiment: DataFrame, product_id: str | None = None) -> DataFrame:
    """All counters of the dashboard head in one aggregate over one join."""
    df = reviews_with_sentiment(
        for_product(reviews, product_id).select("review_id", "raw_rating"),
        sentiment.select("review_id", "predicted_sentiment"),
        "left",
    )
    rating = F.when(F.col("raw_rating") != 0, F.col("raw_rating"))
    return df.agg(
        F.count("*").alias("total_reviews"),
        *_label_counts(),
        vl.rounded(F.coalesce(F.avg(rating), F.lit(0.0)), 2).alias("avg_rating"),
    )


def rating_distribution(reviews: DataFrame, product_id: str | None = None) -> DataFrame:
    counts = for_product(reviews, product_id).agg(
        *[F.count_if(F.col("raw_rating") == r).alias(f"r{r}") for r in range(1, 6)]
    )
    return _to_rows(counts, [F.struct(F.lit(r).alias("rating"), F.col(f"r{r}").alias("count")) for r in range(1, 6)])


def _per_product(reviews: DataFrame, sentiment: DataFrame, how: str) -> DataFrame:
    """Sums and counts per product from which every product-level average can be formed."""
    df = reviews_with_sentiment(
        reviews.select("review_id", "product_id", "raw_rating"),
        sentiment.select("review_id", "predicted_sentiment", *SCORES),
        how,
    )
    sums = []
    for c in ["raw_rating", *SCORES]:
        sums += [F.sum(F.col(c).cast("double")).alias(f"s_{c}"), F.count(c).alias(f"n_{c}")]
    return df.groupBy("product_id").agg(
        F.count("*").alias("total_reviews"),
        F.count_if(F.col("raw_rating") >= 4).alias("positive_reviews"),
        F.count_if(F.col("raw_rating") == 3).alias("neutral_reviews"),
        F.count_if(F.col("raw_rating") <= 2).alias("negative_reviews"),
        F.count("predicted_sentiment").alias("scored"),
        *_label_counts(),
        *sums,
    )


def _avg(c: str, digits: int) -> Column:
    return vl.rounded(F.when(F.col(f"n_{c}") > 0, F.col(f"s_{c}") / F.col(f"n_{c}")), digits)


def product_summary(products: DataFrame, reviews: DataFrame, sentiment: DataFrame) -> DataFrame:
    """14-column summary per product; products without reviews are kept."""
    return summary_of_sums(products, product_sums(reviews, sentiment))


def product_sums(reviews: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The sums per product behind ``product_summary``; sums of several loads may be added up."""
    return _per_product(reviews, sentiment, "left")


def summary_of_sums(products: DataFrame, stats: DataFrame) -> DataFrame:
    """``product_summary`` of given sums."""

    def count(c: str, out: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("long").alias(out)

    return products.select("product_id", "product_name", "category").join(stats, "product_id", "left").select(
        "product_id",
        "product_name",
        "category",
        count("total_reviews", "total_reviews"),
        count("positive_reviews", "positive_reviews"),
        count("neutral_reviews", "neutral_reviews"),
        count("negative_reviews", "negative_reviews"),
        _avg("raw_rating", 4).alias("avg_rating"),
        count("positive", "predicted_positive"),
        count("negative", "predicted_negative"),
        count("neutral", "predicted_neutral"),
        _avg("positive_score", 4).alias("avg_positive_score"),
        _avg("negative_score", 4).alias("avg_negative_score"),
        _avg("confidence_score", 4).alias("avg_confidence"),
    )


def daily_category_trend(products: DataFrame, reviews: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Per day and category; reviews without a date are left out. Aggregated per (day, product) before the join."""
    return trend_of_sums(products, daily_sums(reviews, sentiment))


def daily_sums(reviews: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The sums per day and product behind ``daily_category_trend``; sums of several loads may be added up."""
    df = reviews_with_sentiment(
        reviews.select("review_id", "product_id", "raw_rating", "review_date").filter(F.col("review_date").isNotNull()),
        sentiment.select("review_id", "predicted_sentiment"),
    )
    return df.groupBy(F.date_trunc("day", "review_date").alias("day"), "product_id").agg(
        F.count("*").alias("n"),
        F.sum("raw_rating").alias("s_rating"),
        F.count("raw_rating").alias("n_rating"),
        *_label_counts(),
    )


def trend_of_sums(products: DataFrame, partial: DataFrame) -> DataFrame:
    """``daily_category_trend`` of given sums."""
    n_rating, s_rating = F.sum("n_rating"), F.sum("s_rating")
    return (
        partial.join(products.select("product_id", "category"), "product_id")
        .groupBy("day", "category")
        .agg(
            F.sum("n").alias("total_reviews"),
            vl.rounded(F.when(n_rating > 0, s_rating / n_rating), 4).alias("avg_rating"),
            *[F.sum(label).alias(f"{label}_count") for label in SENTIMENT_LABELS],
        )
        .withColumn("review_day", vl.day_key("day"))
        .drop("day")
        .orderBy(F.desc("review_day"), "category")
    )


def _recent_scored(reviews: DataFrame, sentiment: DataFrame, as_of, days: int, product_id: str | None, *extra: str) -> DataFrame:
    recent = look_back(for_product(reviews, product_id), "ingested_at", as_of, days=days)
    return reviews_with_sentiment(
        recent.select("review_id", "ingested_at"), sentiment.select("review_id", "predicted_sentiment", *extra)
    )


def daily_trend(reviews: DataFrame, sentiment: DataFrame, as_of, days: int = 30, product_id: str | None = None) -> DataFrame:
    """Counts per label and day; ``total`` counts every result."""
    df = _recent_scored(reviews, sentiment, as_of, days, product_id)
    return df.groupBy(vl.day_key("ingested_at").alias("date")).agg(*_label_counts(), F.count("*").alias("total"))


def period_trend(
    reviews: DataFrame, sentiment: DataFrame, as_of, interval: str = "day", days: int = 30, product_id: str | None = None
) -> DataFrame:
    """Counts per label and day, week or month; ``total`` is the sum of the three labels."""
    df = _recent_scored(reviews, sentiment, as_of, days, product_id)
    counts = df.groupBy(vl.period_key("ingested_at", interval).alias("period")).agg(*_label_counts())
    return counts.withColumn("total", F.col("positive") + F.col("negative") + F.col("neutral"))


def aspect_trend(
    reviews: DataFrame, sentiment: DataFrame, as_of, aspect: str, days: int = 30, product_id: str | None = None
) -> DataFrame:
    """Daily trend plus the sentiment the last review of the day gives to one aspect (null: not mentioned)."""
    df = _recent_scored(reviews, sentiment, as_of, days, product_id, "aspects")
    found = F.try_element_at(F.col("aspects"), F.lit(aspect))
    value = F.when(found.isNotNull(), F.coalesce(found["sentiment"], F.lit("neutral")))
    order = F.when(found.isNotNull(), F.struct("ingested_at", "review_id"))
    return df.groupBy(vl.day_key("ingested_at").alias("date")).agg(
        *_label_counts(), F.count("*").alias("total"), F.max_by(value, order).alias("aspect_sentiment")
    )


def _aspect_rows(counts: DataFrame, aspects: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    rows = [
        F.struct(
            F.lit(a).alias("aspect"),
            F.col(f"{a}_n").alias("mentions"),
            *[vl.percentage(f"{a}_{label}", f"{a}_n", 1).alias(f"{label}_pct") for label in SENTIMENT_LABELS],
        )
        for a in aspects
    ]
    return counts.select(*keys, F.inline(F.array(*rows)))


def _aspect_counts(aspects: Sequence[str]) -> list[Column]:
    """Counters for a flat ``{aspect: sentiment}`` map column named ``flat``; no explode needed."""
    out = []
    for a in aspects:
        value = F.try_element_at(F.col("flat"), F.lit(a))
        out.append(F.count(value).alias(f"{a}_n"))
        out += [F.count_if(value == label).alias(f"{a}_{label}") for label in SENTIMENT_LABELS]
    return out


def aspect_summary(
    reviews: DataFrame, sentiment: DataFrame, product_id: str | None = None, aspects: Sequence[str] = tuple(ASPECT_TAXONOMY)
) -> DataFrame:
    """Mentions and label shares per fixed aspect over stored results; aspects without mentions stay as zero rows."""
    df = reviews_with_sentiment(for_product(reviews, product_id).select("review_id"), sentiment.select("review_id", "aspects"))
    flat = df.select(vl.flat_aspects("aspects").alias("flat"))
    return _aspect_rows(flat.agg(*_aspect_counts(aspects)), aspects)


def daily_counters(
    reviews: DataFrame, sentiment: DataFrame, as_of, days: int, aspects: Sequence[str] = tuple(ASPECT_TAXONOMY)
) -> DataFrame:
    """Sums per day from which ``overall_stats``, ``daily_trend`` and ``aspect_summary`` can be rolled up.

    One join and one aggregate. ``date`` is null for reviews before the look-back window and for those without a result.
    """
    scored = F.col("_scored").isNotNull()
    df = reviews_with_sentiment(
        reviews.select("review_id", "raw_rating", "ingested_at"),
        sentiment.select("review_id", "predicted_sentiment", "aspects", F.lit(True).alias("_scored")),
        "left",
    ).select(
        F.when(scored & (F.col("ingested_at") >= vl.since(as_of, days)), vl.day_key("ingested_at")).alias("date"),
        "raw_rating", "predicted_sentiment", "_scored", vl.flat_aspects("aspects").alias("flat"),
    )
    rating = F.when(F.col("raw_rating") != 0, F.col("raw_rating"))
    return df.groupBy("date").agg(
        F.count("*").alias("reviews"), F.count("_scored").alias("scored"), *_label_counts(),
        F.coalesce(F.sum(rating), F.lit(0)).alias("s_rating"), F.count(rating).alias("n_rating"), *_aspect_counts(aspects),
    )


def aspect_cohorts(
    scored: DataFrame, cohort: str, aspects_column: str, aspects: Sequence[str] = tuple(ASPECT_TAXONOMY),
    cohorts: Sequence[str] = ("product", "competitor"),
) -> DataFrame:
    """Positive share per aspect, one column per cohort."""
    flat = scored.select(cohort, vl.flat_aspects(aspects_column).alias("flat"))
    rows = _aspect_rows(flat.groupBy(cohort).agg(*_aspect_counts(aspects)), aspects, [cohort])
    wide = rows.groupBy("aspect").pivot(cohort, list(cohorts)).agg(F.first("positive_pct"))
    return wide.select("aspect", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"{c}_positive_pct") for c in cohorts])


def category_comparison(products: DataFrame, reviews: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Reviews, rating and score averages per category; null and empty categories are left out."""
    stats = _per_product(reviews, sentiment, "inner")
    cats = products.select("product_id", "category").filter(F.col("category") != "")

    def mean(c: str, digits: int) -> Column:
        return vl.rounded(F.when(F.sum(f"n_{c}") > 0, F.sum(f"s_{c}") / F.sum(f"n_{c}")), digits)

    rating = mean("raw_rating", 2)
    return (
        stats.join(cats, "product_id")
        .groupBy("category")
        .agg(
            F.sum("total_reviews").alias("total_reviews"),
            F.when(rating != 0, rating).alias("avg_rating"),
            *[F.coalesce(mean(s, 4), F.lit(0.0)).alias(f"avg_{s}") for s in SCORES[:3]],
        )
    )


def product_profiles(products: DataFrame, reviews: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Distribution and average scores for all given products in one grouped aggregate.

    Reviews of other products are summed too and dropped afterwards: for few products give their reviews only.
    """
    stats = _per_product(reviews, sentiment, "inner")
    joined = products.join(stats, "product_id", "left")

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("long")

    return joined.select(
        *products.columns,
        *[n(label).alias(f"{label}_count") for label in SENTIMENT_LABELS],
        *[vl.percentage(n(label), n("scored")).alias(f"{label}_pct") for label in SENTIMENT_LABELS],
        n("scored").alias("total"),
        *[F.coalesce(_avg(s, 4), F.lit(0.0)).alias(f"avg_{s}") for s in SCORES],
    )


def compare_products(products: DataFrame, reviews: DataFrame, sentiment: DataFrame, ids: Sequence[str]) -> DataFrame:
    slim = products.select("product_id", "product_name", "category")
    listed = F.col("product_id").isin(*ids)
    return lookup_in_order(product_profiles(slim.filter(listed), reviews.filter(listed), sentiment), ids)


def compare_with_competitors(products: DataFrame, reviews: DataFrame, sentiment: DataFrame, product_id: str) -> DataFrame:
    """The product and each competitor of its category, told apart by ``role``."""
    cols = ["product_id", "product_name", "category"]
    target = products.filter(F.col("product_id") == product_id).select(*cols, F.lit("product").alias("role"))
    rivals = competitors_of(products, product_id).select(*cols, F.lit("competitor").alias("role"))
    chosen = target.unionByName(rivals)
    return product_profiles(chosen, reviews.join(chosen.select("product_id"), "product_id", "left_semi"), sentiment)


def cohort_comparison(scored: DataFrame, cohort: str) -> DataFrame:
    """Label shares and mean scores per cohort of scored texts."""
    return scored.groupBy(cohort).agg(
        *[
            vl.percentage(F.count_if(F.col("label") == label), F.count("*"), 1).alias(f"{label}_pct")
            for label in SENTIMENT_LABELS
        ],
        vl.mean_or_zero("positive_score").alias("avg_positive_score"),
        vl.mean_or_zero("negative_score").alias("avg_negative_score"),
        F.count("*").alias("total_reviews"),
    )


def batch_statistics(texts: DataFrame, blank: Column) -> DataFrame:
    """Counters of a scored batch; blank texts count as invalid and are left out of the rest."""
    valid = ~blank
    return texts.agg(
        *[F.count_if(valid & (F.col("label") == label)).alias(label) for label in SENTIMENT_LABELS],
        vl.rounded(F.coalesce(F.avg(F.when(valid, F.col("confidence_score"))), F.lit(0.0)), 4).alias("average_confidence"),
        F.count("*").alias("total_texts"),
        F.count_if(valid).alias("valid_texts"),
        F.count_if(blank).alias("invalid_texts"),
    )


def alert_summary(
    reviews: DataFrame, sentiment: DataFrame, as_of, hours: int = 24, product_id: str | None = None
) -> DataFrame:
    recent = look_back(sentiment, "analyzed_at", as_of, hours=hours)
    if product_id not in (None, "all"):
        recent = recent.join(for_product(reviews, product_id).select("review_id"), "review_id", "left_semi")
    c = F.col("confidence_score")
    severity = vl.summary_severity(c)
    return recent.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(c < 0.7).alias("unacknowledged"),
        *[F.count_if(severity == s).alias(s) for s in ("critical", "warning", "info")],
    )


def alert_history(
    reviews: DataFrame, sentiment: DataFrame, as_of, days: int = 30, product_id: str | None = None
) -> DataFrame:
    """One row per result of the window, newest first."""
    return alert_rows(reviews, sentiment, as_of, days, product_id).orderBy(F.desc("date"), "review_id")


def alert_rows(reviews: DataFrame, sentiment: DataFrame, as_of, days: int, product_id: str | None = None) -> DataFrame:
    """The rows of the alert history in no order, for further aggregation."""
    recent = look_back(sentiment, "analyzed_at", as_of, days=days)
    slim = for_product(reviews, product_id).select("review_id", "product_id")
    df = recent.join(slim, "review_id", "left" if product_id in (None, "all") else "inner")
    negative = _is("negative").cast("int")
    return df.select(
        "review_id",
        vl.iso_text("analyzed_at").alias("date"),
        "product_id",
        F.lit(1).alias("total"),
        negative.alias("negative_reviews"),
        negative.cast("double").alias("negative_ratio"),
    )


def alert_history_daily(history: DataFrame) -> DataFrame:
    return history.groupBy(F.substring("date", 1, 10).alias("day")).agg(
        F.sum("total").alias("total"),
        F.sum("negative_reviews").alias("negative_reviews"),
        vl.rounded(F.avg("negative_ratio"), 4).alias("negative_ratio"),
    )


def prediction_distribution(sentiment: DataFrame) -> DataFrame:
    counts = sentiment.groupBy("predicted_sentiment").agg(F.count("*").alias("count"))
    return counts.withColumn("total_predictions", counts.agg(F.sum("count")).scalar())


def gauge(profile: DataFrame) -> DataFrame:
    """Share of each label in the three counts, per entity of a profile frame."""
    total = F.greatest(F.col("positive_count") + F.col("negative_count") + F.col("neutral_count"), F.lit(1))
    return profile.select(
        "product_id",
        "product_name",
        *[vl.rounded(F.col(f"{label}_count") * 100.0 / total, 4).alias(f"{label}_pct") for label in SENTIMENT_LABELS],
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
