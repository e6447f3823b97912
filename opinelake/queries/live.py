"""Streaming queries over the events, documents and orders; each answer equals the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.queries.base import REL, n_if, query
from opinelake.queries.text import LEXICON, OPINIONS, TAXONOMY, _lex_counts, _lex_sql, _tax_sql, _tax_text
from opinelake.operators.scoring import SCORE_FIELDS
from opinelake.session import shared_dir
from opinelake.streaming import live as lv

_LABEL = "CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' ELSE 'neutral' END"


def _events(spark, sf) -> DataFrame:
    """Events as scored reviews."""
    label = F.when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "purchase", "positive").otherwise("neutral")
    stream = lv.read_stream(spark, f"{sf}/events.parquet")
    return stream.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", label.alias("label"), (F.col("value") / 500).alias("confidence_score")
    )


def _finish(query_handle) -> None:
    query_handle.awaitTermination()


def _append(df: DataFrame, name: str) -> DataFrame:
    """Runs an append stream to its end and reads the sink."""
    spark, root = df.sparkSession, shared_dir(df.sparkSession, name)
    _finish(lv.run_append(df, f"{root}/out", f"{root}/state"))
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query(
    "score_on_arrival_n1",
    f"""SELECT conv_id, turn, label, positive_score, negative_score, neutral_score, confidence_score, aspects FROM (
SELECT conv_id, turn, {_lex_sql('text')}, array_to_string({_tax_sql('text')}, ';') AS aspects FROM (SELECT conv_id, turn, text, {_lex_counts('text')} FROM (
SELECT conv_id, turn, lower(text) AS text FROM conversations)))""",
)
def _(spark, sf):
    stream = lv.read_stream(spark, f"{sf}/conversations.parquet")
    out = _append(lv.score_arrivals(stream, "text", taxonomy=TAXONOMY, opinions=OPINIONS, **LEXICON), "scored")
    return out.select("conv_id", "turn", *SCORE_FIELDS, _tax_text("aspects").alias("aspects"))


@query("running_totals_n2", f"SELECT {_LABEL} AS label, count(*) AS count FROM events GROUP BY 1")
def _(spark, sf):
    root = shared_dir(spark, "totals")
    _finish(lv.run_totals(lv.label_totals(_events(spark, sf)), f"{root}/out", f"{root}/state"))
    return lv.newest_batch(spark, f"{root}/out")


@query("rolling_latest_n3", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 19")
def _(spark, sf):
    root = shared_dir(spark, "latest")
    _finish(lv.run_latest(_events(spark, sf), [F.desc("ts"), F.desc("event_id")], f"{root}/out", f"{root}/state"))
    return lv.newest_batch(spark, f"{root}/out").select("event_id", "user_id")


@query(
    "low_confidence_stream_n4",
    f"""SELECT event_id AS id, CAST(user_id AS VARCHAR) AS product_id, printf('Low confidence prediction: %s (%s)', {_LABEL}, CAST(CAST(round(CAST(value / 500 AS DECIMAL(28,12)), 2) AS DECIMAL(10,2)) AS VARCHAR)) AS message,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS triggered_at FROM events WHERE value / 500 < 0.5""",
)
def _(spark, sf):
    scored = _events(spark, sf).select(
        F.col("event_id").alias("result_id"), F.col("user_id").cast("string").alias("product_id"),
        F.col("label").alias("predicted_sentiment"), "confidence_score", F.col("ts").alias("analyzed_at"),
    )
    return _append(lv.alert_stream(scored), "alerts").select("id", "product_id", "message", "triggered_at")


@query(
    "spike_stream_n5",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, negative_ratio FROM (
SELECT event_id, user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) OVER w AS negative_ratio, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
WHERE n = 10 AND negative_ratio >= 0.3""",
)
def _(spark, sf):
    root = shared_dir(spark, "spikes")
    negative = F.col("label") == "negative"
    _finish(lv.run_spikes(_events(spark, sf), "user_id", "ts", "event_id", negative, f"{root}/out", f"{root}/state", expire_days=None))
    return spark.read.parquet(f"{root}/out/spikes").select("user_id", "event_id", "negative_ratio")


@query(
    "trend_stream_n6",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS date, {n_if(f"{_LABEL} = 'positive'")} AS positive, {n_if(f"{_LABEL} = 'negative'")} AS negative,
  {n_if(f"{_LABEL} = 'neutral'")} AS neutral, count(*) AS total FROM events GROUP BY 1""",
)
def _(spark, sf):
    root = shared_dir(spark, "trend")
    _finish(lv.run_totals(lv.daily_trend(_events(spark, sf), "ts", "label"), f"{root}/out", f"{root}/state"))
    return lv.newest_batch(spark, f"{root}/out")


@query(
    "closed_trend_stream_n6",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS date, {n_if(f"{_LABEL} = 'positive'")} AS positive, {n_if(f"{_LABEL} = 'negative'")} AS negative,
  {n_if(f"{_LABEL} = 'neutral'")} AS neutral, count(*) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1""",
)
def _(spark, sf):
    # Days that the watermark has closed: they ended a day or more before the newest event.
    return _append(lv.daily_trend(_events(spark, sf), "ts", "label"), "closed")


@query("store_once_n7", "SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1")
def _(spark, sf):
    root = shared_dir(spark, "stored")
    stream = lv.read_stream(spark, f"{sf}/conversations.parquet").select("conv_id", "turn")
    _finish(lv.run_once_per_key(stream, "conv_id", ["turn"], f"{root}/out", f"{root}/state"))
    return spark.read.parquet(f"{root}/out").select("conv_id", "turn")


@query("drop_repeats_n8", "SELECT DISTINCT user_id FROM events")
def _(spark, sf):
    # The delay covers all 30 days, so each user passes once.
    return _append(lv.drop_repeats(_events(spark, sf), "user_id", "ts", "60 days").select("user_id"), "distinct")


@query("periodic_refresh_n9", REL + "SELECT predicted_sentiment AS label, count(*) AS count FROM sentiment_results GROUP BY 1")
def _(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative").otherwise("neutral")
    stream = lv.read_stream(spark, f"{sf}/orders.parquet").select(label.alias("label"))
    root = shared_dir(spark, "refresh")
    handle = lv.run_totals(lv.label_totals(stream), f"{root}/out", f"{root}/state", available_now=False, every="1 second")
    # The first refresh takes in every file; later ones would find nothing new.
    handle.processAllAvailable()
    handle.stop()
    return lv.newest_batch(spark, f"{root}/out")
