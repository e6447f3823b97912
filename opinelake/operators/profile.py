"""Dataset profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinelake.functions import values as vl
from opinelake.lexicons import TARGET_HINTS, TARGET_NAMES
from opinelake.operators.windows import with_share


def value_shares(df: DataFrame, column: str, count: str = "count") -> DataFrame:
    """Rows and share per value of a column."""
    return with_share(df.groupBy(column).agg(F.count("*").alias(count)), count)


def class_balance(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Count and share per label, with the total."""
    shares = value_shares(df.filter(F.col(label).isNotNull()), label)
    return shares.withColumn("total", shares.agg(F.sum("count")).scalar())


def class_imbalance(df: DataFrame, label: str = "sentiment_label", warn_above: float = 2.0) -> DataFrame:
    """Distribution with the ratio of the largest to the smallest share (infinite when that is 0)."""
    shares = value_shares(df.filter(F.col(label).isNotNull()), label)
    lo, hi = F.min("percentage"), F.max("percentage")
    ratio = shares.agg(F.when(lo > 0, hi / lo).otherwise(F.lit(float("inf")))).scalar()
    return shares.withColumn("imbalance_ratio", F.round(ratio, 4)).withColumn("imbalanced", F.col("imbalance_ratio") > warn_above)


def source_distribution(df: DataFrame, source: str = "source") -> DataFrame:
    return value_shares(df, source)


def rating_profile(df: DataFrame, rating: str) -> DataFrame:
    """Share per rating, with mean and median of all ratings."""
    shares = value_shares(df.filter(F.col(rating).isNotNull()), rating)
    stats = df.agg(F.struct(F.avg(rating).alias("mean"), F.median(rating).alias("median"))).scalar()
    return (
        shares.withColumn("_t", stats)
        .withColumn("mean_rating", vl.rounded("_t.mean", 4))
        .withColumn("median_rating", F.col("_t.median").cast("double"))
        .drop("_t")
    )


def length_statistics(df: DataFrame, text: str) -> DataFrame:
    """Length statistics; percentiles interpolate linearly.

    The exact percentile keeps one counter per different length, which text lengths keep small.
    """
    n = F.length(text)
    q = F.percentile(n, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]))
    return df.agg(
        F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("lo"), F.max(n).alias("hi"), q.alias("q")
    ).select(
        vl.rounded("mean", 4).alias("average_length"),
        vl.rounded(F.col("q")[1], 4).alias("median_length"),
        vl.rounded("std", 4).alias("std_length"),
        F.col("lo").cast("long").alias("min_length"),
        F.col("hi").cast("long").alias("max_length"),
        *[vl.rounded(F.col("q")[i], 4).alias(name) for i, name in ((0, "q25"), (2, "q75"), (3, "q90"), (4, "q95"), (5, "q99"))],
    )


def missing_values(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Null count and share per column and in total: one pass over the data."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).alias("missing_count"),
            vl.percentage(c, "_rows", 4).alias("missing_percentage"),
            total.alias("total_missing"),
        )
        for c in df.columns
    ]
    out = counts.select(F.inline(F.array(*rows)))
    if only_missing:
        out = out.filter(F.col("missing_count") > 0)
    return out.orderBy(F.desc("missing_count"), "column")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Row count, column count, names and types: one row per column."""
    rows = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in df.dtypes]
    return (
        df.agg(F.count("*").alias("total_rows"))
        .withColumn("total_columns", F.lit(len(df.columns)))
        .select("total_rows", "total_columns", F.inline(F.array(*rows)))
    )


def target_column(df: DataFrame) -> str | None:
    """The likely label column: a known name, else a column whose name holds a hint."""
    exact = [c for c in TARGET_NAMES if c in df.columns]
    hinted = [c for c in df.columns if any(h in c.lower() for h in TARGET_HINTS)]
    return next(iter(exact + hinted), None)


def target_profile(df: DataFrame) -> DataFrame:
    """Profile of the target column as (target, statistic, value).

    Value counts when there are fewer than 20 values, else summary statistics; without a target the
    average length of the first three text columns. The choice needs one look at the number of values.
    """
    target = target_column(df)
    if target is None:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)][:3]
        stats = df.agg(*[F.avg(F.length(c)).alias(c) for c in texts])
        rows = [F.struct(F.lit(c).alias("target"), F.lit("average_length").alias("statistic"), vl.rounded(c, 4).alias("value")) for c in texts]
        return stats.select(F.inline(F.array(*rows)))
    counts = df.groupBy(target).agg(F.count("*").alias("value"))
    if counts.limit(20).count() < 20:
        return counts.select(F.lit(target).alias("target"), F.col(target).cast("string").alias("statistic"), F.col("value").cast("double"))
    c = F.col(target)
    if not isinstance(df.schema[target].dataType, T.NumericType):
        stats = {"count": F.count(c), "unique": F.count_distinct(c)}
    else:
        stats = {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}
        stats.update({f"{int(p * 100)}%": F.percentile_approx(c, p, 100000) for p in (0.25, 0.5, 0.75)})
    row = df.agg(*[e.cast("double").alias(k) for k, e in stats.items()])
    out = [F.struct(F.lit(target).alias("target"), F.lit(k).alias("statistic"), vl.rounded(F.col(f"`{k}`"), 4).alias("value")) for k in stats]
    return row.select(F.inline(F.array(*out)))


def date_range(df: DataFrame, date: str) -> DataFrame:
    ts = vl.lenient_tweet_date(date)
    return df.agg(vl.iso_text(F.min(ts)).alias("min_date"), vl.iso_text(F.max(ts)).alias("max_date"))


def preprocess_summary(
    raw: DataFrame, cleaned: DataFrame, label: str = "sentiment_label", rating: str | None = None, ids: Sequence[str] = ()
) -> DataFrame:
    """Rows before and after cleaning, label and rating counts, mean and median length, distinct ids."""
    before = raw.agg(F.count("*")).scalar()
    stats = cleaned.agg(
        F.count("*").alias("final_rows"),
        *[F.count_if(F.col(label) == s).alias(f"{s}_rows") for s in ("positive", "negative", "neutral")],
        *[F.count_if(F.col(rating) == i).alias(f"rating_{i}") for i in (range(1, 6) if rating else ())],
        vl.rounded(F.avg("review_length"), 1).alias("average_length"),
        vl.rounded(F.median("review_length"), 1).alias("median_length"),
        *[F.count_distinct(c).alias(f"unique_{c}") for c in ids],
    )
    return (
        stats.withColumn("initial_rows", before)
        .withColumn("removed_rows", F.col("initial_rows") - F.col("final_rows"))
        .withColumn("removed_pct", vl.percentage("removed_rows", "initial_rows", 1))
    )
