"""Rows kept by key between the batches of a stream.

A batch writes only the keys it touched, and one bucket of all keys in turn, so what a trigger writes grows with its own
keys. A key's rows are those of the newest batch that wrote it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


def hadoop(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class KeyedLog:
    """Folders ``batch=N/bucket=B`` below ``root``; batch N holds the keys it touched and, whole, bucket ``N % buckets``.

    A bucket is therefore found in at most the last ``buckets`` batches, older folders of it are removed, and a repeated
    batch reads and overwrites the same folders. Null is a key like others. Keys of one bucket are written by one task:
    choose more buckets for more keys (the number must stay the same for the life of a log), or ``spread`` them over as many
    tasks as their size asks for, which each write a file per bucket (for loads in batches, where AQE finds that number).
    """

    def __init__(self, root: str, key: str, schema: StructType, buckets: int = BUCKETS, spread: bool = False):
        self.root, self.key, self.schema, self.buckets, self.spread = root, key, schema, buckets, spread

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows, at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def turn(self, batch_id: int) -> int:
        """The bucket that a batch writes whole."""
        return batch_id % self.buckets

    def folders(self, spark: SparkSession, batch_id: int, buckets: Iterable[int]) -> list[str]:
        """Folders that hold the rows of these buckets before a batch."""
        found, wanted = [], {f"bucket={b}": b for b in buckets}
        for earlier in range(max(0, batch_id - self.buckets), batch_id):
            path, fs = hadoop(spark, self._folder(earlier))
            names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
            for name in names:
                if name in wanted and earlier >= self._whole(wanted[name], batch_id):
                    found.append(f"{self._folder(earlier)}/{name}")
        return found

    def read(self, spark: SparkSession, batch_id: int, buckets: Iterable[int]) -> DataFrame:
        """Current rows of these buckets before a batch."""
        folders = self.folders(spark, batch_id, buckets)
        if not folders:
            return spark.createDataFrame([], self.schema)
        stored = spark.read.schema(self.schema).option("basePath", self.root).parquet(*folders)
        stored = stored.withColumn("_last", F.max("batch").over(Window.partitionBy(self.key)))
        return stored.filter("batch = _last").select(*self.schema.names)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Stores the rows of a batch: all of each key that it touched, all keys of the bucket whose turn it is."""
        spark = rows.sparkSession
        tagged = rows.select(*self.schema.names, self.bucket().alias("bucket"))
        dealt = tagged.repartition(self.key) if self.spread else tagged.repartition(self.buckets, "bucket")
        dealt.sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(self._folder(batch_id))
        # The batch before wrote its bucket whole and is finished, so nobody opens older folders of that bucket again.
        for old in range(max(0, batch_id - 1 - self.buckets), batch_id - 1):
            path, fs = hadoop(spark, f"{self._folder(old)}/bucket={self.turn(batch_id - 1)}")
            fs.delete(path, True)

    def _folder(self, batch_id: int) -> str:
        return f"{self.root}/batch={batch_id:09d}"

    def _whole(self, bucket: int, batch_id: int) -> int:
        """The newest batch before this one that wrote the bucket whole; 0 if none did."""
        return max(0, batch_id - 1 - (batch_id - 1 - bucket) % self.buckets)


def of_keys(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Rows whose key is (``left_semi``) or is not (``left_anti``) among ``keys``; null equals null."""
    keys = keys.select(F.col(key).alias("_k")).distinct()
    return rows.join(keys, F.col(key).eqNullSafe(F.col("_k")), how)
