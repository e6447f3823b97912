"""Dashboard overview: all blocks as one long frame of JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.functions import values as vl
from opinelake.operators import analytics as an
from opinelake.operators.ordering import recent_reviews


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in sorted(fields.items())]))


def _item(block: str, item: Column) -> Column:
    return F.struct(F.lit(block).alias("block"), item.alias("item"))


def _counted_blocks(reviews: DataFrame, sentiment: DataFrame, as_of, days: int) -> DataFrame:
    """Rows (block, item) of the head counters, the daily trend and the aspects: one join, counted per day and then rolled up."""
    daily = an.daily_counters(reviews, sentiment, as_of, days)
    counters = [c for c in daily.columns if c != "date"]
    # Every day counts for the head, under an empty date; a day of the trend also for itself. Without reviews the head is zeros.
    zeros = daily.sparkSession.range(1, numPartitions=1).select(F.lit(None).cast("string").alias("date"), *[F.lit(0).cast("long").alias(c) for c in counters])
    slots = daily.unionByName(zeros).withColumn("slot", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("date", F.lit(""))))))
    sums = slots.groupBy("slot").agg(*[F.sum(c).alias(c) for c in counters])
    labels = {label: F.col(label) for label in an.SENTIMENT_LABELS}
    rating = F.coalesce(F.col("s_rating") / F.nullif(F.col("n_rating"), F.lit(0)), F.lit(0.0))
    head = _item("stats", _json(total_reviews=F.col("reviews"), avg_rating=vl.rounded(rating, 2), **labels))
    aspects = [
        _item("aspects", _json(
            aspect=F.lit(a), mentions=F.col(f"{a}_n"),
            **{f"{label}_pct": vl.percentage(f"{a}_{label}", f"{a}_n", 1) for label in an.SENTIMENT_LABELS},
        ))
        for a in an.ASPECT_TAXONOMY
    ]
    trend = _item("trends", _json(date=F.col("slot"), total=F.col("scored"), **labels))
    return sums.select(F.inline(F.when(F.col("slot") == "", F.array(head, *aspects)).otherwise(F.array(trend))))


def overview(reviews: DataFrame, sentiment: DataFrame, as_of, days: int = 30, product_id: str | None = None) -> DataFrame:
    """Rows (block, item): head counters, daily trend, aspects, newest reviews, alert summary."""
    mine = an.for_product(reviews, product_id)
    newest = recent_reviews(mine).select("review_id", "product_id", "raw_rating", vl.iso_text("ingested_at").alias("ingested_at"))
    out = _counted_blocks(mine, sentiment, as_of, days)
    for name, df in {
        "recent_reviews": newest,
        "alert_summary": an.alert_summary(mine, sentiment, as_of, product_id=product_id),
    }.items():
        out = out.unionByName(df.select(F.lit(name).alias("block"), _json(**{c: F.col(c) for c in df.columns}).alias("item")))
    return out
