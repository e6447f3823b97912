"""Streams fed in several files against the batch answer."""

from pyspark.sql import functions as F

from opinelake.operators import windows as wn
from opinelake.streaming import live as lv


def feed(spark, tmp_path, n=400, files=4):
    """Events in time order, one file per time range."""
    df = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1000000000) + F.col("id") * 1800).alias("ts"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("user"),
        F.when(F.col("id") * 7 % 11 < 4, "negative").when(F.col("id") % 2 == 0, "positive").otherwise("neutral").alias("label"),
        ((F.col("id") % 10) / 10.0).alias("confidence_score"),
    )
    path = str(tmp_path / "in")
    for i in range(files):
        df.filter(f"event_id >= {i * n // files} and event_id < {(i + 1) * n // files}").coalesce(1).write.mode("append").parquet(path)
    return df, path


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_totals_latest_and_trend(spark, tmp_path):
    df, path = feed(spark, tmp_path)
    stream = lambda: lv.read_stream(spark, path, 1)
    lv.run_totals(lv.label_totals(stream()), f"{tmp_path}/t", f"{tmp_path}/tc").awaitTermination()
    assert rows(lv.newest_batch(spark, f"{tmp_path}/t"), "label", "count") == rows(df.groupBy("label").count(), "label", "count")
    lv.run_latest(stream(), [F.desc("ts")], f"{tmp_path}/l", f"{tmp_path}/lc").awaitTermination()
    assert [r[0] for r in rows(lv.newest_batch(spark, f"{tmp_path}/l"), "event_id")] == list(range(381, 400))
    lv.run_totals(lv.daily_trend(stream(), "ts", "label"), f"{tmp_path}/d", f"{tmp_path}/dc").awaitTermination()
    batch = df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("total"))
    assert rows(lv.newest_batch(spark, f"{tmp_path}/d"), "date", "total") == rows(batch, "date", "total")


def test_spikes_across_batches(spark, tmp_path):
    df, path = feed(spark, tmp_path)
    negative = F.col("label") == "negative"
    for _ in range(2):  # the second run finds nothing new
        lv.run_spikes(lv.read_stream(spark, path, 1), "user", "ts", "event_id", negative, f"{tmp_path}/s", f"{tmp_path}/sc").awaitTermination()
    batch = wn.spikes(df, "user", "ts", "event_id", negative)
    assert rows(spark.read.parquet(f"{tmp_path}/s/spikes"), "user", "event_id") == rows(batch, "user", "event_id")
    kept = lv.newest_batch(spark, f"{tmp_path}/s/state").groupBy("user").count().collect()
    assert {r["user"]: r["count"] for r in kept} == dict.fromkeys(["hot", *[f"k{i}" for i in range(5)]], 9)


def test_spike_state_of_quiet_keys_expires(spark, tmp_path):
    df, path = feed(spark, tmp_path)
    late = df.limit(1).select(
        "event_id", (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit("new").alias("user"), "label", "confidence_score"
    )
    late.write.mode("append").parquet(path)
    stream = lv.read_stream(spark, path, 1)
    lv.run_spikes(stream, "user", "ts", "event_id", F.col("label") == "negative", f"{tmp_path}/s", f"{tmp_path}/sc").awaitTermination()
    assert rows(lv.newest_batch(spark, f"{tmp_path}/s/state"), "user") == [("new",)]


def test_slow_active_keys_keep_their_rows(spark, tmp_path):
    """One row every four days is 36 days for nine predecessors; a row from the future makes no key quiet."""
    start = "timestampadd(DAY, -160, current_timestamp())"
    df = spark.range(40).select(
        F.col("id").alias("event_id"), F.expr(f"timestampadd(DAY, CAST(4 * id AS INT), {start})").alias("ts"), F.lit("slow").alias("user"),
        F.when(F.col("id") % 2 == 0, "negative").otherwise("neutral").alias("label"),
    )
    future = spark.range(1).select(
        F.lit(99).cast("long").alias("event_id"), F.expr("timestampadd(YEAR, 50, current_timestamp())").alias("ts"), F.lit("clock").alias("user"), F.lit("neutral").alias("label")
    )
    path = str(tmp_path / "in")
    steps = [df.filter(f"event_id >= {i} AND event_id < {i + 5}") for i in range(0, 40, 5)]
    for part in (*steps[:-1], future, steps[-1]):
        part.coalesce(1).write.mode("append").parquet(path)
    negative = F.col("label") == "negative"
    batch = rows(wn.spikes(spark.read.parquet(path), "user", "ts", "event_id", negative), "event_id", "negative_ratio")
    assert len(batch) == 31
    for expire in (30, None):
        out = f"{tmp_path}/{expire}"
        lv.run_spikes(lv.read_stream(spark, path, 1), "user", "ts", "event_id", negative, out, f"{out}c", expire_days=expire).awaitTermination()
        assert rows(spark.read.parquet(f"{out}/spikes"), "event_id", "negative_ratio") == batch


def test_days_close_and_late_rows_of_closed_days_are_dropped(spark, tmp_path):
    df, path = feed(spark, tmp_path)
    days = [r[0] for r in df.select(F.date_format("ts", "yyyy-MM-dd")).distinct().orderBy(F.col("date_format(ts, yyyy-MM-dd)")).collect()]
    stream = lv.daily_trend(lv.read_stream(spark, path, 1), "ts", "label")
    lv.run_append(stream, f"{tmp_path}/t", f"{tmp_path}/tc").awaitTermination()
    closed = spark.read.parquet(f"{tmp_path}/t")
    batch = df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("total"))
    expected = [r for r in rows(batch, "date", "total") if r[0] < days[-2]]
    assert [r for r in rows(closed, "date", "total") if r[0] < days[-2]] == expected and days[-1] not in {r["date"] for r in closed.collect()}
    df.limit(1).write.mode("append").parquet(path)  # the first day has been closed
    lv.run_append(lv.daily_trend(lv.read_stream(spark, path, 1), "ts", "label"), f"{tmp_path}/t", f"{tmp_path}/tc").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/t"), "date", "total").count(expected[0]) == 1


def test_old_and_unfinished_batches(spark, tmp_path):
    for i in range(lv.KEPT_BATCHES + 3):
        lv._store_batch(spark.range(i, i + 1), str(tmp_path / "out"), i)
    assert len(list((tmp_path / "out").iterdir())) == lv.KEPT_BATCHES
    (tmp_path / "out" / "batch=000000099").mkdir()
    assert lv.newest_batch(spark, str(tmp_path / "out")).first()["id"] == lv.KEPT_BATCHES + 2


def test_store_once_and_restart(spark, tmp_path):
    df, path = feed(spark, tmp_path)
    for _ in range(2):  # the second run finds nothing new
        lv.run_once_per_key(lv.read_stream(spark, path, 1), "user", ["event_id"], f"{tmp_path}/o", f"{tmp_path}/oc").awaitTermination()
    first = df.groupBy("user").agg(F.min("event_id").alias("event_id"))
    assert rows(spark.read.parquet(f"{tmp_path}/o"), "user", "event_id") == rows(first, "user", "event_id")


def test_alerts_and_repeats(spark, tmp_path):
    df, path = feed(spark, tmp_path)
    scored = lv.read_stream(spark, path, 2).select(
        F.col("event_id").alias("result_id"), F.col("user").alias("product_id"), F.col("label").alias("predicted_sentiment"),
        "confidence_score", F.col("ts").alias("analyzed_at"),
    )
    lv.run_append(lv.alert_stream(scored), f"{tmp_path}/a", f"{tmp_path}/ac").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/a").count() == df.filter("confidence_score < 0.5").count()
    unique = lv.drop_repeats(lv.read_stream(spark, path, 1), "user", "ts", "60 days")
    lv.run_append(unique, f"{tmp_path}/u", f"{tmp_path}/uc").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/u").count() == df.select("user").distinct().count()
