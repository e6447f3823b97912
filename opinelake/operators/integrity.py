"""Table constraints, defaults, upserts and acknowledgements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.schema import SENTIMENT_LABELS


def product_checks() -> dict[str, Column]:
    return {"price_not_positive": F.col("price") <= 0}


def review_checks() -> dict[str, Column]:
    return {
        "rating_out_of_range": ~F.col("raw_rating").between(1, 5),
        "text_empty": F.length("review_text") < 1,
    }


def sentiment_checks() -> dict[str, Column]:
    checks = {"unknown_label": ~F.col("predicted_sentiment").isin(*SENTIMENT_LABELS)}
    for c in ("positive_score", "negative_score", "neutral_score"):
        checks[f"{c}_out_of_range"] = ~F.col(c).between(0, 1)
    return checks


def with_violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds ``violations``: the names of the checks a row fails. A null value passes, as in SQL."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])))


def accepted(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    return with_violations(df, checks).filter(F.size("violations") == 0).drop("violations")


def quarantined(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    return with_violations(df, checks).filter(F.size("violations") > 0)


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count; a null in the key exempts the row.

    Counted with map-side partial sums, so a value with very many copies is no heavy group.
    """
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Fills nulls of existing columns and adds missing ones."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), value) if c in df.columns else value for c, value in defaults.items()}
    )


def product_defaults(now: Column) -> dict[str, Column]:
    return {"is_competitor": F.lit(False), "created_at": now, "updated_at": now}


def review_defaults(now: Column) -> dict[str, Column]:
    return {
        "verified_purchase": F.lit(False),
        "helpful_votes": F.lit(0),
        "total_votes": F.lit(0),
        "source": F.lit("amazon"),
        "ingested_at": now,
    }


def upsert(table: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows of ``changes`` replace those with the same key and get a fresh ``updated_at``.

    Of several changes of one key the greatest by its columns, left to right, is taken, so the key stays unique.
    """
    whole = F.struct(*[F.col(c) for c in changes.columns])
    changes = changes.groupBy(key).agg(F.max(whole).alias("_change")).select("_change.*")
    kept = table.join(changes.select(key), key, "left_anti")
    existing = table.select(key, "created_at")
    changed = (
        changes.drop("created_at")
        .join(existing, key, "left")
        .withColumn("created_at", F.coalesce("created_at", now))
        .withColumn("updated_at", now)
    )
    return kept.unionByName(changed, allowMissingColumns=True)


def acknowledge(acks: DataFrame | None, sentiment: DataFrame, result_ids: DataFrame, now: Column) -> DataFrame:
    """New rows for the append-only acknowledgement table: known alerts that were not acknowledged before."""
    wanted = result_ids.select("result_id").distinct().join(sentiment.select("result_id"), "result_id", "left_semi")
    if acks is not None:
        wanted = wanted.join(acks.select("result_id"), "result_id", "left_anti")
    return wanted.withColumn("acknowledged_at", now)
