"""Batch loads: incoming reviews, stored predictions and the seed load."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.functions import text as tx
from opinelake.functions import values as vl
from opinelake.operators import integrity as ig
from opinelake.operators import projections as pr
from opinelake.operators.dedupe import keep_first
from opinelake.operators.joins import get_or_create_products, orphans, with_parent
from opinelake.operators.ranking import hash_rank
from opinelake.operators.scoring import analyse_texts
from opinelake.sources import readers as rd

# Stored with each prediction: the scorer that made it.
MODEL_NAME = "opinion-lexicon"
MODEL_VERSION = "latest"


class Load(NamedTuple):
    """Frames to append (``products`` is the complete new table)."""

    products: DataFrame
    reviews: DataFrame
    sentiment_results: DataFrame


def number_reviews(incoming: DataFrame, key: str, reviews: DataFrame) -> DataFrame:
    """Adds ``review_id``: largest stored id plus an exact rank of the batch in hash order of ``key``.

    The numbers depend only on the batch and the stored maximum, so a repeated run gives the same ids.
    """
    top = F.coalesce(reviews.agg(F.max("review_id")).scalar(), F.lit(0))
    return hash_rank(incoming, key, 0, out="_rank").withColumn("review_id", F.col("_rank") + top).drop("_rank")


def store(load: Load, root: str, now: Column) -> DataFrame:
    """Appends a load to the tables under ``root`` and returns the rows that were refused: (table, key, violations).

    Defaults are filled first. A row is refused if it fails a check of its table or if its product or review is not stored.
    Of rows with one key the first is taken, and keys that are stored already are left out, so storing a load again adds
    nothing; its numbers must then be the same, which a ``staging`` folder ensures.
    """
    spark = load.reviews.sparkSession
    rd.create_tables(spark, root, Load._fields)

    def put(name: str, rows: DataFrame, key: str, order: list[str], checks: dict[str, Column]) -> DataFrame:
        new = keep_first(rows, key, order).join(rd.read_table(spark, root, name).select(key), key, "left_anti")
        tagged = ig.with_violations(new, checks)
        rd.append_table(tagged.filter(F.size("violations") == 0), root, name)
        return refused(name, key, tagged.filter(F.size("violations") > 0))

    def refused(name: str, key: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), "violations")

    def missing(name: str, key: str, rows: DataFrame, what: str) -> DataFrame:
        return refused(name, key, rows.withColumn("violations", F.array(F.lit(what))))

    products = ig.with_defaults(load.products, ig.product_defaults(now))
    out = put("products", products, "product_id", ["product_name"], ig.product_checks() if "price" in products.columns else {})
    known = rd.read_table(spark, root, "products").select("product_id")
    reviews = ig.with_defaults(load.reviews, ig.review_defaults(now))
    accepted = with_parent(reviews, known, "product_id", "review_id")
    out = out.unionByName(put("reviews", accepted, "review_id", ["product_id", "review_text"], ig.review_checks()))
    out = out.unionByName(missing("reviews", "review_id", orphans(reviews, known, "product_id", "review_id"), "product_missing"))
    held = rd.read_table(spark, root, "reviews").select("review_id")
    results = load.sentiment_results.join(held, "review_id", "left_semi")
    out = out.unionByName(put("sentiment_results", results, "result_id", ["predicted_sentiment", "confidence_score"], ig.sentiment_checks()))
    return out.unionByName(missing("sentiment_results", "result_id", load.sentiment_results.join(held, "review_id", "left_anti"), "review_missing"))


def _split(scored: DataFrame, products: DataFrame, now: Column) -> Load:
    """The rows of the tables; a result has the number of its review, of which it is the only one."""
    reviews = scored.select(
        "review_id", "product_id", "reviewer_name", F.col("text").alias("review_text"), F.col("text").alias("cleaned_text"),
        "summary", F.col("score").cast("short").alias("raw_rating"), "source", "review_date", now.alias("ingested_at"),
    )
    results = scored.select(
        F.col("review_id").alias("result_id"), "review_id", F.col("label").alias("predicted_sentiment"), "positive_score", "negative_score", "neutral_score",
        "confidence_score", "aspects", F.lit(MODEL_VERSION).alias("model_version"), F.lit(MODEL_NAME).alias("model_name"),
        now.alias("analyzed_at"),
    )
    return Load(products, reviews, results)


def _with_columns(df: DataFrame, **defaults: str) -> DataFrame:
    """Adds missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in defaults.items() if c not in df.columns})


def _staged(scored: DataFrame, staging: str | None) -> DataFrame:
    """The scored batch, written once to ``staging`` so that the two tables made of it do not score it twice."""
    return scored if staging is None else rd.materialise(scored, staging, force_recreate=True)


def ingest_reviews(
    incoming: DataFrame, key: str, products: DataFrame, reviews: DataFrame, now: Column, staging: str | None = None, **scoring
) -> Load:
    """Incoming (key, text, product_id?, product_name?, category?, summary?, score?, user_id?, source?) rows to
    the three tables.

    Blank texts are rejected; a missing product id becomes 'unknown'; a new product without a name is named by its id.
    """
    df = _with_columns(incoming, product_id="string", summary="string", score="int", user_id="string", source="string")
    df = pr.non_blank(df, "text").withColumns(
        {
            "text": tx.strip("text"),
            "product_id": F.coalesce("product_id", F.lit("unknown")),
            "source": F.coalesce("source", F.lit("api")),
            "reviewer_name": F.col("user_id"),
            "review_date": now,
        }
    )
    scored = _staged(analyse_texts(number_reviews(df, key, reviews), "text", **scoring), staging)
    return _split(scored, get_or_create_products(df, products, F.col("product_id"), order=key), now)


def store_predictions(
    predictions: DataFrame, key: str, products: DataFrame, reviews: DataFrame, now: Column, staging: str | None = None, **scoring
) -> Load:
    """Standalone predictions: product 'default' unless given, source 'api_prediction'."""
    df = _with_columns(predictions, product_id="string", summary="string", score="int").withColumns(
        {
            "product_id": F.coalesce("product_id", F.lit("default")),
            "source": F.lit("api_prediction"),
            "reviewer_name": F.lit(None).cast("string"),
            "review_date": F.lit(None).cast("timestamp"),
        }
    )
    name = F.when(F.col("product_id") == "default", "Standalone Prediction").otherwise(
        F.concat(F.lit("Product-"), F.substring("product_id", 1, 8))
    )
    scored = _staged(analyse_texts(number_reviews(df, key, reviews), "text", **scoring), staging)
    return _split(scored, get_or_create_products(df, products, name), now)


def seed_load(
    raw: DataFrame, products: DataFrame, now: Column, sample_size: int | None = None, max_products: int | None = None,
    staging: str | None = None, **scoring
) -> Load | None:
    """First load of an empty database from raw review rows; None when products exist already.

    Everything is loaded, texts whole. ``sample_size`` keeps the first rows by ``Id`` only; ``max_products`` creates the
    first products by ``Id`` only, and reviews of other products have no parent and are left out.
    """
    if products.limit(1).count():
        return None
    df = pr.drop_null(raw if sample_size is None else pr.top_rows(raw, ["Id"], sample_size), ["Text"])
    seen = df.groupBy("ProductId").agg(F.min("Id").alias("_id"), F.min_by("Summary", "Id").alias("_summary"))
    first = seen if max_products is None else pr.top_rows(seen, ["_id"], max_products)
    name = F.when(F.coalesce(F.length("_summary"), F.lit(0)) > 0, F.col("_summary")).otherwise(
        F.concat(F.lit("Product-"), F.substring("ProductId", 1, 8))
    )
    created = first.select(
        F.col("ProductId").alias("product_id"), name.alias("product_name"), F.lit("general").alias("category"),
        F.lit(False).alias("is_competitor"),
    )
    rows = df.select(
        F.col("Id").alias("review_id"), F.col("ProductId").alias("product_id"), F.col("UserId").alias("reviewer_name"),
        F.col("Score").alias("score"), F.col("Summary").alias("summary"), F.col("Text").alias("text"),
        F.lit("amazon").alias("source"), vl.epoch_timestamp("Time", now).alias("review_date"),
    )
    kept = with_parent(pr.non_blank(rows, "text"), created, "product_id", "review_id")
    return _split(_staged(analyse_texts(kept, "text", **scoring), staging), created, now)


