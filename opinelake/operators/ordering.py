"""Pages, alert lists and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.functions import values as vl
from opinelake.operators.projections import for_product, look_back, top_rows

BROADCAST_ROWS = 10_000


#: Stands for a missing time, behind all microseconds of the years up to 9999.
NEVER = 1 << 60


def skip_to(df: DataFrame, keys: Sequence[Column], offset: int, near: int, bins: int = 4096) -> tuple[DataFrame, int]:
    """Drops leading rows by the order of integer ``keys`` and returns the rest with the offset that is left, at most ``near``.

    Counts per bin of the first key tell which bin holds the offset; this bin is cut into bins again until at most ``near`` rows lie
    before the wanted one, or the bin is one value, where the next key goes on. Each step is one aggregate of at most ``bins`` rows.
    More than ``near`` rows may be left where they agree in all keys. Keys are not null and span less than 2 ** 63.
    """
    dropped, same = F.lit(False), F.lit(True)  # rows before the place; rows that agree with it in the keys so far
    for key in keys:
        value = key.cast("long")
        bounds = df.filter(same).agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
        low, high = bounds["low"], bounds["high"]
        if low is None:
            break
        while offset > near and low < high:
            width = (high - low) // bins + 1
            inside = df.filter(same & value.between(low, high))
            left = F.pmod(value - low, F.lit(width))  # without the rest the quotient is whole
            counts = inside.groupBy(F.round((value - low - left) / F.lit(width)).cast("long").alias("bin"))
            place = high + 1
            for row in counts.agg(F.count("*").alias("n")).orderBy("bin").collect():
                if offset < row["n"]:
                    place = low + row["bin"] * width
                    break
                offset -= row["n"]
            if place > high:  # behind the last row
                return df.filter(F.lit(False)), 0
            low, high = place, min(high, place + width - 1)
        dropped = dropped | (same & (value < low))
        same = same & (value == low)
        if offset <= near or low < high:
            break
    return df.filter(~dropped), offset


def review_page(
    reviews: DataFrame,
    sentiment: DataFrame,
    product_id: str | None = None,
    label: str | None = None,
    page: int = 1,
    per_page: int = 20,
    near: int = 10_000,
) -> DataFrame:
    """One page of reviews, newest first, with ``total`` and ``pages``; beyond the end it is empty. A page has at most 100 rows.

    Pages that begin behind the first ``near`` rows skip the rows before them by counts (``skip_to``), so that no task holds more
    than ``near`` rows before the page.
    """
    if not 1 <= per_page <= 100:
        raise ValueError("per_page must be from 1 to 100")
    df = for_product(reviews, product_id)
    if label:
        keys = sentiment.filter(F.col("predicted_sentiment") == label).select("review_id")
        df = df.join(keys, "review_id", "left_semi")
    total = df.agg(F.count("*")).scalar()
    offset = (page - 1) * per_page
    kept = df
    if offset > near:
        newest = F.coalesce(-F.unix_micros("ingested_at"), F.lit(NEVER))  # rows without a time come last
        kept, offset = skip_to(df, [newest, F.col("review_id")], offset, near)
    rows = top_rows(kept, [F.desc("ingested_at"), "review_id"], per_page, offset)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / F.lit(per_page)).cast("long"))


def _of_page(df: DataFrame, page: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of ``df`` whose key is on a page of at most ``limit`` rows; pages up to ``BROADCAST_ROWS`` are broadcast."""
    keys = page.select(key)
    return df.join(F.broadcast(keys) if limit <= BROADCAST_ROWS else keys, key, "left_semi")


def _newest_results(
    reviews: DataFrame, sentiment: DataFrame, product_id: str | None, limit: int, offset: int = 0, acks: DataFrame | None = None
) -> DataFrame:
    """A page of results, newest first, with product_id and, given ``acks`` (result_id), the flag ``acknowledged``.

    Without a product every result has its place, whatever review it belongs to: the page is taken first and only its rows
    meet the reviews and the acknowledgements.
    """
    order = [F.desc("analyzed_at"), "result_id"]
    slim = reviews.select("review_id", "product_id")
    one_product = product_id not in (None, "all")
    if one_product:
        sentiment = sentiment.join(for_product(slim, product_id), "review_id")
    page = out = top_rows(sentiment, order, limit, offset)
    if not one_product:
        out = out.join(_of_page(slim, page, "review_id", limit), "review_id", "left")
    if acks is not None:
        marks = _of_page(acks.select("result_id"), page, "result_id", limit).distinct().withColumn("_ack", F.lit(True))
        out = out.join(marks, "result_id", "left").withColumn("acknowledged", F.col("_ack").isNotNull()).drop("_ack")
    return page if out is page else top_rows(out, order, limit)


def _message(prefix: str, conf: str) -> F.Column:
    return F.format_string(f"{prefix} %s ({conf}%.2f)", "predicted_sentiment", "confidence_score")


def alert_list(
    reviews: DataFrame,
    sentiment: DataFrame,
    acks: DataFrame | None = None,
    product_id: str | None = None,
    acknowledged: bool | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Results as alerts, newest first. ``acks`` (result_id) is the append-only table of acknowledged alerts."""
    if acknowledged is not None:
        if acks is not None:
            sentiment = sentiment.join(acks.select("result_id"), "result_id", "left_semi" if acknowledged else "left_anti")
        elif acknowledged:
            sentiment = sentiment.filter(F.lit(False))
    if acks is None or acknowledged is not None:
        page = _newest_results(reviews, sentiment, product_id, limit, offset).withColumn("acknowledged", F.lit(bool(acknowledged)))
    else:
        page = _newest_results(reviews, sentiment, product_id, limit, offset, acks)
    return page.select(
        F.col("result_id").alias("id"),
        "product_id",
        F.lit("sentiment_low_confidence").alias("alert_type"),
        vl.list_severity("confidence_score").alias("severity"),
        _message("Sentiment prediction:", "confidence: ").alias("message"),
        F.col("confidence_score").alias("metric_value"),
        F.lit(0.5).alias("threshold"),
        vl.iso_text("analyzed_at").alias("triggered_at"),
        "acknowledged",
    )


def recent_reviews(reviews: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(reviews, [F.desc("ingested_at"), "review_id"], n)


def recent_alerts(
    reviews: DataFrame, sentiment: DataFrame, as_of, hours: int = 24, product_id: str | None = None, n: int = 10
) -> DataFrame:
    recent = look_back(sentiment, "analyzed_at", as_of, hours=hours)
    return _newest_results(reviews, recent, product_id, n).select(
        F.col("result_id").alias("id"),
        vl.list_severity("confidence_score").alias("severity"),
        _message("Sentiment:", "conf: ").alias("message"),
        vl.iso_text("analyzed_at").alias("triggered_at"),
        "product_id",
    )


def low_confidence_alerts(df: DataFrame, below: float = 0.5) -> DataFrame:
    """Filter and alert shape; works on batch and streaming frames."""
    return df.filter(F.col("confidence_score") < below).select(
        F.col("result_id").alias("id"),
        "product_id",
        F.lit("low_confidence").alias("alert_type"),
        F.lit("warning").alias("severity"),
        _message("Low confidence prediction:", "").alias("message"),
        F.col("confidence_score").alias("metric_value"),
        F.lit(below).alias("threshold"),
        vl.iso_text("analyzed_at").alias("triggered_at"),
        F.lit(False).alias("acknowledged"),
    )


def alert_check(
    reviews: DataFrame, sentiment: DataFrame, product_id: str | None = None, newest: int = 50, below: float = 0.5
) -> DataFrame:
    """The newest results first, the confidence filter after that."""
    return low_confidence_alerts(_newest_results(reviews, sentiment, product_id, newest), below)


def training_history(versions: DataFrame, n: int = 5) -> DataFrame:
    return top_rows(versions, [F.desc("created_at"), F.desc("version_id")], n)


def top_k(counts: DataFrame, value: str, count: str, k: int) -> DataFrame:
    return top_rows(counts, [F.desc(count), value], k)


def bottom_k(counts: DataFrame, value: str, count: str, k: int) -> DataFrame:
    return top_rows(counts, [count, value], k)


def newest_first(df: DataFrame, ts: str, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(ts), *ties)


def alert_display(alerts: DataFrame, n: int = 20) -> DataFrame:
    """Newest first, alerts without a time last."""
    return top_rows(alerts, [F.desc_nulls_last("triggered_at"), "id"], n)


