"""Tables stored in buckets of their join key, so that joins and sums on it need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.session import shared_dir


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None, sort: Sequence[str] = ()) -> DataFrame:
    """Stores ``df`` as an external table of ``buckets`` files, one per bucket of ``key``, and returns the table.

    Tables that are to be joined need the same number of buckets and the same type of key. The rows are moved to their buckets before
    they are written: one file a bucket instead of one a bucket and task. Choose ``buckets`` so that one bucket fits a task. All rows of
    one key share a bucket, so bucket by a key that is not hot (a review id, never a product id). Null keys share a bucket too.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    writer = (
        df.repartition(buckets, F.col(key)).write.mode("overwrite").format("parquet").option("path", path or shared_dir(spark, "bucketed"))
        .bucketBy(buckets, key).sortBy(*(sort or [key]))
    )
    writer.saveAsTable(name)
    return spark.table(name)


def store_reviews(reviews: DataFrame, results: DataFrame, buckets: int = 64, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """Reviews and their results, bucketed alike by the review's id: their 1:1 join runs without an exchange."""
    kind = reviews.schema[key].dataType
    return write_bucketed(reviews, key, buckets), write_bucketed(results.withColumn(key, F.col(key).cast(kind)), key, buckets)
