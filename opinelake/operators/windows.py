"""Spike detection, latest records, first-n per key and modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinelake.operators.projections import top_rows
from opinelake.operators.ranking import quantile_slices


def negative_windows(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    negative: Column,
    window: int = 10,
    slice_rows: int = 10_000_000,
) -> DataFrame:
    """For every row with ``window - 1`` predecessors in its key: the negative share of the last ``window`` rows.

    The time line is cut into slices of about ``slice_rows`` rows, as many as the counted rows need, so no key has to be sorted in
    one task; each (key, slice) receives the last ``window - 1`` flags from before it, taken from at most ``window - 1`` earlier
    slices of the key, since each holds a row. The result does not depend on the slices. Null times come first; a
    null key is a key.
    """
    back = window - 1
    slim = df.select(key, ts, tie, negative.cast("int").alias("_neg"))
    slices = max(1, -(-df.count() // slice_rows))
    timed = quantile_slices(slim.withColumn("_t", F.unix_micros(ts).cast("double")), "_t", slices, "_s")
    base = timed.withColumn("_slice", F.coalesce(F.when(F.col("_t").isNotNull(), F.col("_s")), F.lit(-1.0))).select(key, ts, tie, "_neg", "_slice")
    newest = Window.partitionBy(key, "_slice").orderBy(F.desc(ts), F.desc(tie))
    tails = (
        base.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= back)
        .groupBy(key, "_slice")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_rn"), "_neg"))), lambda s: s["_neg"]).alias("_tail"))
    )
    by_slice = Window.partitionBy(key).orderBy("_slice")
    empty = F.array().cast("array<int>")
    before = F.concat(*[F.coalesce(F.lag("_tail", i).over(by_slice), empty) for i in range(back, 0, -1)])
    carries = tails.select(F.col(key).alias("_k"), F.col("_slice").alias("_at"), before.alias("_carry"))
    inside = Window.partitionBy(key, "_slice").orderBy(ts, tie)
    carried = F.when(
        F.col("_missing") > 0,
        F.aggregate(F.expr("slice(_carry, -_missing, _missing)"), F.lit(0), lambda a, x: a + x),
    ).otherwise(F.lit(0))
    return (
        base.withColumn("_rn", F.row_number().over(inside))
        .withColumn("_in", F.sum("_neg").over(inside.rowsBetween(-back, Window.currentRow)))
        .withColumn("_missing", F.greatest(F.lit(window) - F.col("_rn"), F.lit(0)))
        .join(carries, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_at")), "left")
        .filter(F.col("_missing") <= F.coalesce(F.size("_carry"), F.lit(0)))
        .withColumn("_carried", carried)
        .withColumn("negative_ratio", (F.col("_in") + F.col("_carried")) / F.lit(float(window)))
        .select(key, ts, tie, "negative_ratio")
    )


def spikes(
    df: DataFrame, key: str, ts: str, tie: str, negative: Column, window: int = 10, threshold: float = 0.3, **slicing: int
) -> DataFrame:
    """Window positions whose negative share reaches the threshold."""
    out = negative_windows(df, key, ts, tie, negative, window, **slicing)
    return out.filter(F.col("negative_ratio") >= threshold)


def latest_spikes(
    df: DataFrame, key: str, ts: str, tie: str, negative: Column, window: int = 10, threshold: float = 0.3
) -> DataFrame:
    """Spike state of each key now: only its last ``window`` rows.

    The row limit per key is applied before the shuffle, so a hot key sends few rows.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    recent = (
        df.select(key, ts, tie, negative.cast("int").alias("_neg"))
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= window)
    )
    state = recent.groupBy(key).agg(F.count("*").alias("_n"), F.avg("_neg").alias("negative_ratio"))
    return state.filter((F.col("_n") == window) & (F.col("negative_ratio") >= threshold)).select(key, "negative_ratio")


def latest_by(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """The newest record of the table."""
    return top_rows(df, [F.desc(ts), F.desc(tie)], 1)


def first_n(df: DataFrame, by: str, order: Sequence, n: int, out: str = "position") -> DataFrame:
    """First ``n`` rows per key in an explicit order; limited before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(out) <= n)


def mode_by_count(df: DataFrame, by: str, value: str, order: str, out: str = "mode") -> DataFrame:
    """Most frequent value per key; ties go to the value seen first by ``order``."""
    counted = df.groupBy(by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(by).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(out))


def with_share(grouped: DataFrame, count: str, out: str = "percentage", digits: int = 2) -> DataFrame:
    """Share of the total next to each group, total by scalar subquery over the grouped rows."""
    total = grouped.agg(F.sum(count)).scalar()
    share = F.col(count) * 100.0 / total
    return grouped.withColumn(out, F.round(share.cast("decimal(28,12)"), digits).cast("double"))
