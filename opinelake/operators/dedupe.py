"""Exact duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """First row per value of ``by`` in an explicit order. Null counts as a value.

    Spark limits each group before the shuffle (window group limit), so every map task sends at
    most one row per value, however many copies a value has. Texts are sorted and shuffled by
    their 32-byte digest.
    """
    is_text = isinstance(df.schema[by].dataType, T.StringType)
    first = Window.partitionBy(F.unhex(F.sha2(by, 256)) if is_text else F.col(by)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def duplicate_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Surplus rows: whole-row duplicates and duplicates of the text column. Null counts as a value.

    One scan; rows and texts are shuffled as digests, after partial counts.
    """
    digests = df.select(
        F.unhex(F.sha2(text, 256)).alias("text"), F.unhex(F.sha2(F.to_json(F.struct(*df.columns)), 256)).alias("row")
    )
    rows = digests.groupBy("text", "row").agg(F.count("*").alias("n"))
    texts = rows.groupBy("text").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return texts.agg(
        n.alias("total_rows"),
        (n - F.coalesce(F.sum("rows"), F.lit(0))).alias("total_duplicates"),
        (n - F.count("*")).alias("text_duplicates"),
    )


def report_invalid(observed: DataFrame, label: str, valid: DataFrame) -> DataFrame:
    """Set difference: observed labels that are not valid."""
    return observed.select(label).distinct().subtract(valid.select(label))
