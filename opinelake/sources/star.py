"""Review-model views over the star-schema test tables.

products = customer, reviews and sentiment_results = orders, review texts = documents,
live events = events. Each view has a SQL twin in ``opinelake.queries.base``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinelake.functions.text import clean_text

AS_OF = "2001-08-01 00:00:00"
ASPECTS = ["quality", "shipping", "customer_service", "value", "usability"]


@lru_cache(maxsize=None)
def _schema(path: str):
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is looked up once per path."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents. A file of few row groups is spread over all cores, because the text operators are
    bound by CPU; an input with enough splits is left as it is."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    few = docs._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return docs.repartition(cores, "doc_id") if few else docs


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("product_id"),
        F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("asin"),
        F.col("c_name").alias("product_name"),
        F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("brand"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_acctbal").cast("decimal(10,2)").alias("price"),
        (F.col("c_nationkey") % 2 == 1).alias("is_competitor"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_custkey").cast("string").alias("product_id"),
        F.concat(F.lit("user"), (F.col("o_orderkey") % 97).cast("string")).alias("reviewer_id"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("review_text"),
        F.substring("o_orderpriority", 1, 1).cast("short").alias("raw_rating"),
        date.alias("review_date"),
        (F.col("o_orderkey") % 7).cast("int").alias("helpful_votes"),
        (F.col("o_orderkey") % 11).cast("int").alias("total_votes"),
        F.lit("amazon").alias("source"),
        date.alias("ingested_at"),
    )


def sentiment_results(spark: SparkSession, sf_dir: str, aspects: bool = False) -> DataFrame:
    """Stored predictions; the aspect map only on request."""
    key = F.col("o_orderkey")
    label = (
        F.when(F.col("o_orderstatus") == "F", "positive")
        .when(F.col("o_orderstatus") == "O", "negative")
        .otherwise("neutral")
    )
    out = table(spark, sf_dir, "orders").select(
        key.alias("result_id"),
        key.alias("review_id"),
        label.alias("predicted_sentiment"),
        (key % 100 / 100.0).alias("positive_score"),
        (key * 7 % 100 / 100.0).alias("negative_score"),
        (key * 13 % 100 / 100.0).alias("neutral_score"),
        (key * 37 % 100 / 100.0).alias("confidence_score"),
        F.col("o_orderdate").cast("timestamp").alias("analyzed_at"),
    )
    return out.withColumn("aspects", _aspects(F.col("review_id"))) if aspects else out


def _aspects(key: Column) -> Column:
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    key % (i + 2) == 0,
                    F.struct(
                        F.lit(name).alias("key"),
                        F.struct(
                            F.lit(1).alias("score"),
                            F.element_at(
                                F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")),
                                ((key + i) % 7 % 3 + 1).cast("int"),
                            ).alias("sentiment"),
                            F.array(F.lit(name)).alias("keywords"),
                        ).alias("value"),
                    ),
                )
                for i, name in enumerate(ASPECTS)
            ]
        )
    )
    return F.map_from_entries(entries)


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews with cleaned text, one product per source, 40 days of dates."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("product_id"),
        "lang",
        F.col("text").alias("review_text"),
        clean_text("text").alias("cleaned_text"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((F.col("doc_id") % 40).cast("int"))).alias("ingested_at"),
    )


def text_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored label per document."""
    d = F.col("doc_id")
    return documents(spark, sf_dir).select(
        d.alias("review_id"),
        F.when(d % 3 == 0, "positive").when(d % 3 == 1, "negative").otherwise("neutral").alias("predicted_sentiment"),
    )


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class truth, logits and text: one row per labelled document."""
    labels = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    d = F.col("doc_id")
    truth = (F.col("quality") + F.col("toxic")).cast("int")
    logits = F.array(*[((d * m % 23) / 10.0) for m in (7, 11, 13)])
    return labels.join(docs, "doc_id").select(
        d.alias("id"), truth.alias("true_id"), logits.alias("logits"), "text"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of the review CSV."""
    d = F.col("doc_id")
    return documents(spark, sf_dir).select(
        d.alias("Id"),
        F.col("source").alias("ProductId"),
        F.concat(F.lit("user"), (d % 97).cast("string")).alias("UserId"),
        F.concat(F.lit("name "), (d % 97).cast("string")).alias("ProfileName"),
        (d % 7).cast("int").alias("HelpfulnessNumerator"),
        (d % 11).cast("int").alias("HelpfulnessDenominator"),
        (d % 6).cast("int").alias("Score"),
        (F.lit(996624000) - d * 3600).alias("Time"),
        F.concat(F.lit("Review of "), "source", F.lit(" no "), d.cast("string")).alias("Summary"),
        F.when(d % 50 != 49, F.col("text")).alias("Text"),
    )


def raw_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of the tweet CSV: one line each, latin-1 characters only."""
    d = F.col("doc_id")
    ts = F.timestamp_seconds(F.lit(1239056385) + d * 61)
    one_line = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\xFF]", ""), r"[\r\n]+", " ")
    return documents(spark, sf_dir).select(
        F.element_at(F.array(F.lit(0), F.lit(2), F.lit(4), F.lit(3)), (d % 4 + 1).cast("int")).alias("sentiment"),
        d.alias("id"),
        F.date_format(ts, "EEE MMM dd HH:mm:ss 'UTC' yyyy").alias("date"),
        F.lit("NO_QUERY").alias("query"),
        F.concat(F.lit("user"), (d % 89).cast("string")).alias("user"),
        one_line.alias("text"),
    )
