"""Cleaning of the review and tweet corpora, merge, and the run report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinelake.functions import text as tx
from opinelake.functions import values as vl
from opinelake.operators import projections as pr
from opinelake.operators.dedupe import keep_first
from opinelake.operators.ranking import seeded_shuffle
from opinelake.schema import MERGED_COLUMNS, REVIEW_CSV


def preprocess_reviews(
    raw: DataFrame, min_length: int = 10, max_length: int = 2000, remove_duplicates: bool = True, source: str = "amazon"
) -> DataFrame:
    """Raw review rows to cleaned rows; duplicates keep the row with the smallest ``Id``."""
    df = pr.keep_existing(raw, REVIEW_CSV.names)
    df = pr.rating_in_range(pr.drop_null(df, ["Text", "Score"]))
    if remove_duplicates:
        df = keep_first(df, "Text", ["Id"])
    df = pr.computed_once(df, "cleaned_text", tx.clean_text("Text")).withColumn("review_length", F.length("cleaned_text"))
    df = pr.length_in_range(df, "cleaned_text", min_length, max_length)
    df = df.withColumn("sentiment_label", vl.rating_label("Score"))
    if "Time" in df.columns:
        df = df.withColumn("review_date", vl.epoch_timestamp("Time")).drop("Time")
    if {"HelpfulnessNumerator", "HelpfulnessDenominator"} <= set(df.columns):
        df = df.withColumn("helpfulness_ratio", vl.ratio_or_zero("HelpfulnessNumerator", "HelpfulnessDenominator"))
    return df.withColumn("source", F.lit(source))


def preprocess_tweets(
    raw: DataFrame, min_length: int = 10, max_length: int = 280, remove_duplicates: bool = True, source: str = "twitter"
) -> DataFrame:
    """Raw tweets to cleaned rows; duplicates keep the row with the smallest ``id``."""
    df = pr.drop_null(raw.withColumn("sentiment_label", vl.polarity_label("sentiment")), ["sentiment_label"])
    if remove_duplicates:
        df = keep_first(df, "text", ["id"])
    df = pr.computed_once(df, "cleaned_text", tx.clean_tweet_text("text")).withColumn("review_length", F.length("cleaned_text"))
    df = pr.length_in_range(df, "cleaned_text", max(min_length, 1), max_length)
    return df.withColumn("review_date", vl.lenient_tweet_date("date")).withColumn("source", F.lit(source))


def merge(
    parts: Sequence[DataFrame], shuffle_key: Sequence[str] | None = ("cleaned_text", "source", "review_date"), seed: int = 42
) -> DataFrame:
    """UNION ALL on the shared five columns, in seeded random order unless ``shuffle_key`` is None.

    Source and date are in the key because cleaning makes many short texts equal.
    """
    out = parts[0].select(MERGED_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(MERGED_COLUMNS))
    return out if shuffle_key is None else seeded_shuffle(out, shuffle_key, seed).drop("shuffle_key")


def source_report(name: str, df: DataFrame) -> DataFrame:
    """Outcome row of a source that was processed."""
    label = F.col("sentiment_label")
    return df.agg(
        F.lit(name).alias("source"),
        F.lit("completed").alias("status"),
        F.count("*").alias("total_rows"),
        F.lit(len(df.columns)).alias("columns"),
        *[F.count_if(label == s).alias(s) for s in ("positive", "negative", "neutral")],
        F.lit(None).cast("string").alias("error"),
    )


def failed_report(spark: SparkSession, name: str, error: str) -> DataFrame:
    return spark.createDataFrame(
        [(name, "failed", 0, 0, 0, 0, 0, error)],
        "source string, status string, total_rows long, columns int, positive long, negative long, neutral long, error string",
    )


def run_corpus(
    spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], output: str, seed: int = 42
) -> tuple[DataFrame | None, DataFrame]:
    """Cleans each source, writes it, and merges them only if every source succeeded.

    Each cleaned source is written once; the merge and the report read the stored tables, so the
    cleaning runs once and survives lost executors. Returns (merged or None, report).
    """
    stored: dict[str, DataFrame] = {}
    reports: list[DataFrame] = []
    for name, build in sources.items():
        try:
            path = f"{output}/{name}_cleaned"
            build().write.mode("overwrite").parquet(path)
            stored[name] = spark.read.parquet(path)
            reports.append(source_report(name, stored[name]))
        except Exception as error:  # the run goes on and reports the failure
            reports.append(failed_report(spark, name, str(error)))
    merged = None
    if len(stored) == len(sources):
        merge(list(stored.values()), seed=seed).write.mode("overwrite").partitionBy("source").parquet(f"{output}/merged")
        merged = spark.read.parquet(f"{output}/merged")
        reports.append(source_report("merged", merged))
    report = reports[0]
    for part in reports[1:]:
        report = report.unionByName(part)
    return merged, report
