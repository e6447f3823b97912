"""Dashboard views kept up to date: each load adds its own sums to the stored ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opinelake.operators import analytics as an
from opinelake.session import shared_dir
from opinelake.sources.readers import materialise
from opinelake.streaming.keyed import BUCKETS, KeyedLog


class SumTable:
    """Sums per group in a ``KeyedLog``: a load reads the buckets of its groups and writes its groups and one bucket in turn."""

    def __init__(self, root: str, groups: Sequence[str], buckets: int = BUCKETS):
        self.root, self.groups, self.buckets = root, list(groups), buckets

    def _log(self, schema: StructType) -> KeyedLog:
        return KeyedLog(self.root, "_group", schema, self.buckets, spread=True)

    def add(self, sums: DataFrame, load_id: int) -> None:
        """Adds the sums of load ``load_id`` (0, 1, 2, ... without a gap). Repeating the newest load changes nothing.

        Nulls are a group like others. A group's sum is null while all its summands are.
        """
        spark = sums.sparkSession
        named = sums.withColumn("_group", F.to_json(F.struct(*self.groups), {"ignoreNullFields": "false"}))
        delta = materialise(named, shared_dir(spark, "sums"))
        log = self._log(delta.schema)
        turn = log.turn(load_id)
        stored = log.read(spark, load_id, {*log.touched(delta), turn})
        values = [c for c in sums.columns if c not in self.groups]
        both = stored.withColumn("_own", F.lit(False)).unionByName(delta.withColumn("_own", F.lit(True)))
        total = both.groupBy("_group", *self.groups).agg(*[F.sum(c).alias(c) for c in values], F.max("_own").alias("_own"))
        total = total.filter(F.col("_own") | (log.bucket() == turn))  # the load's own groups and one bucket in turn
        log.write(total.select(*[F.col(f.name).cast(f.dataType) for f in delta.schema]), load_id)

    def read(self, spark: SparkSession, schema: StructType, loads: int) -> DataFrame:
        """Sums after the first ``loads`` loads; ``schema`` is that of the sums."""
        full = StructType([*schema.fields]).add("_group", "string")
        return self._log(full).read(spark, loads, range(self.buckets)).drop("_group")


class DashboardViews:
    """Product summary and daily trend per category, maintained load by load.

    A load's results belong to reviews of the same load, as ``ingest`` stores them. Products are joined when a view is read, so
    their names may change. Averages are formed from sums of doubles, so the last bits may depend on the loads; reports are rounded.
    """

    def __init__(self, root: str, buckets: int = BUCKETS):
        self.products = SumTable(f"{root}/products", ["product_id"], buckets)
        self.days = SumTable(f"{root}/days", ["day", "product_id"], buckets)

    def load(self, reviews: DataFrame, results: DataFrame, load_id: int) -> None:
        self.products.add(an.product_sums(reviews, results), load_id)
        self.days.add(an.daily_sums(reviews, results), load_id)

    def product_summary(self, products: DataFrame, reviews: DataFrame, results: DataFrame, loads: int) -> DataFrame:
        """``analytics.product_summary`` after ``loads`` loads; of reviews and results only the schemas are used."""
        schema = an.product_sums(reviews, results).schema
        return an.summary_of_sums(products, self.products.read(products.sparkSession, schema, loads))

    def daily_category_trend(self, products: DataFrame, reviews: DataFrame, results: DataFrame, loads: int) -> DataFrame:
        schema = an.daily_sums(reviews, results).schema
        return an.trend_of_sums(products, self.days.read(products.sparkSession, schema, loads))
