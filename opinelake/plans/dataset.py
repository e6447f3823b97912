"""Validated, split and encoded training data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.functions import values as vl
from opinelake.operators import projections as pr
from opinelake.operators.dedupe import keep_first
from opinelake.operators.learning import encode, vocabulary
from opinelake.operators.ranking import stratified_split
from opinelake.sources.readers import materialise, write_splits


def validate(df: DataFrame, key: str, text: str = "cleaned_text", label: str = "sentiment_label") -> DataFrame:
    """Required columns, no nulls, valid labels, first of each text, at least three characters."""
    df = pr.require_columns(df, [text, label])
    df = pr.valid_labels(pr.drop_null(df, [text, label]), label)
    return pr.min_trimmed_length(keep_first(df, text, [key]), text)


def prepare(df: DataFrame, key: str, output: str, force_recreate: bool = False) -> DataFrame:
    """Validates, splits 80/10/10 per label, encodes and stores; an existing result is returned as it is.

    The validated rows are stored first: split cut points, vocabulary and encoding read them again.
    """
    spark = df.sparkSession
    if not force_recreate and _exists(spark, f"{output}/splits"):
        return spark.read.parquet(f"{output}/splits")
    valid = materialise(validate(df, key), f"{output}/validated", force_recreate=True)
    labelled = valid.withColumn("label", vl.label_id("sentiment_label"))
    split = stratified_split(labelled, key, "sentiment_label")
    words = vocabulary(split.filter(F.col("split") == "train"), "cleaned_text")
    write_splits(encode(split, "cleaned_text", words), f"{output}/splits")
    return spark.read.parquet(f"{output}/splits")


def _exists(spark, path: str) -> bool:
    """True when the folder holds a finished write."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
