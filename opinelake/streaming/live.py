"""Live scoring, totals, alerts, spikes and trends with Structured Streaming.

Transformations take and return streaming frames; the ``run_*`` functions attach a sink. Every
sink is idempotent: files carry the batch id and are overwritten when a batch is repeated, so a
restart after a lost executor or driver neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from opinelake.operators.dedupe import keep_first
from opinelake.operators.ordering import low_confidence_alerts
from opinelake.operators.projections import top_rows
from opinelake.operators.scoring import analyse_texts
from opinelake.operators.windows import first_n, spikes
from opinelake.schema import SENTIMENT_LABELS
from opinelake.streaming.keyed import BUCKETS, KeyedLog, hadoop, of_keys

REFRESH = "30 seconds"
KEPT_BATCHES = 10


def read_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a parquet folder (or one file), with the schema of the files that are there."""
    target, fs = hadoop(spark, path)
    if fs.getFileStatus(target).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a glob
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def trigger(available_now: bool = True, every: str = REFRESH) -> dict:
    """Catch up and stop, or refresh periodically."""
    return {"availableNow": True} if available_now else {"processingTime": every}


# --- transformations -------------------------------------------------------------------------

def score_arrivals(arrivals: DataFrame, text: str, **scoring) -> DataFrame:
    """Each arriving text with sentiment and aspects (stateless)."""
    return analyse_texts(arrivals, text, **scoring)


def label_totals(scored: DataFrame, label: str = "label") -> DataFrame:
    """Running count per label; the overall total is their sum. A missing label counts as neutral."""
    return scored.groupBy(F.coalesce(F.col(label), F.lit("neutral")).alias("label")).agg(F.count("*").alias("count"))


def alert_stream(scored: DataFrame, below: float = 0.5) -> DataFrame:
    return low_confidence_alerts(scored, below)


def daily_trend(scored: DataFrame, ts: str, label: str, delay: str = "1 day") -> DataFrame:
    """Counts per day and label; a day is closed ``delay`` after its end."""
    counts = [F.count_if(F.col(label) == s).alias(s) for s in SENTIMENT_LABELS]
    return (
        scored.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"))
        .agg(*counts, F.count("*").alias("total"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), *SENTIMENT_LABELS, "total")
    )


def drop_repeats(arrivals: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """First arrival per key; keys are forgotten ``delay`` after their event time."""
    return arrivals.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# --- sinks -------------------------------------------------------------------------------------

def _batch_path(out: str, batch_id: int) -> str:
    return f"{out}/batch={batch_id:09d}"


def _store_batch(rows: DataFrame, out: str, batch_id: int) -> None:
    """The answer as of a batch. That of ``KEPT_BATCHES`` batches before is removed; later ones may still have readers."""
    rows.write.mode("overwrite").parquet(_batch_path(out, batch_id))
    if batch_id >= KEPT_BATCHES:
        old, fs = hadoop(rows.sparkSession, _batch_path(out, batch_id - KEPT_BATCHES))
        fs.delete(old, True)


def run_append(df: DataFrame, out: str, checkpoint: str, available_now: bool = True, every: str = REFRESH) -> StreamingQuery:
    """Exactly-once append to a parquet folder."""
    return (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger(available_now, every)).start()
    )


def run_batches(
    df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    available_now: bool = True, every: str = REFRESH,
) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(**trigger(available_now, every)).start()
    )


def run_totals(totals: DataFrame, out: str, checkpoint: str, **when) -> StreamingQuery:
    """Writes the complete current totals under the batch id; the newest folder is the answer.

    The totals are gathered into one file after the aggregate, whose state keeps its tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _store_batch(batch.repartition(1), out, batch_id)

    return run_batches(totals, write, checkpoint, "complete", **when)


def newest_batch(spark: SparkSession, out: str) -> DataFrame:
    """Rows of the highest batch folder that is written to its end; no other folder is read."""
    root, fs = hadoop(spark, out)
    folders = [status.getPath().toString() for status in fs.listStatus(root)]
    return spark.read.parquet(max(path for path in folders if fs.exists(hadoop(spark, f"{path}/_SUCCESS")[0])))


def run_spikes(
    scored: DataFrame, key: str, ts: str, tie: str, negative: Column, out: str, checkpoint: str, window: int = 10,
    threshold: float = 0.3, expire_days: int | None = 30, buckets: int = BUCKETS, **when
) -> StreamingQuery:
    """Stores the arrivals at which the last ``window`` rows of their key are negative often enough, in ``out``/spikes.

    A batch is one windowed plan over its rows and the last ``window - 1`` rows of its keys, cut into time slices like the
    batch operator, so a key that owns most of a trigger is many tasks. These rows stand in a ``KeyedLog`` (``out``/state):
    a batch reads the buckets of its keys and writes its keys and one bucket. Keys without a row in the
    last ``expire_days`` days of event time are forgotten, whole; all others keep their rows however old these are. Event
    time ends at the clock, so a row from the future makes no key look quiet. With None no key is forgotten and the answer
    is that of the batch operator. Feed the stream in time order: a late row is placed among the rows that are kept.
    """
    slim = scored.select(
        F.col(key).cast("string").alias(key), F.col(ts).alias("ts"), F.col(tie).cast("long").alias("id"), negative.cast("int").alias("neg")
    )
    log = KeyedLog(f"{out}/state", key, slim.schema, buckets)

    def alive(rows: DataFrame, now: Column) -> DataFrame:
        """Rows of the keys that were not quiet for ``expire_days``; at most ``window - 1`` rows per key come in."""
        rows = rows.withColumn("_last", F.max("ts").over(Window.partitionBy(key)))
        kept = F.col("_last").isNull() | now.isNull() | (F.col("_last") >= now - F.make_dt_interval(F.lit(expire_days)))
        return rows.filter(kept).drop("_last")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Read several times below, hence written once.
        _store_batch(batch, f"{out}/arrivals", batch_id)
        batch = spark.read.schema(batch.schema).parquet(_batch_path(f"{out}/arrivals", batch_id))
        stored = log.read(spark, batch_id, {*log.touched(batch), log.turn(batch_id)})
        now = None
        if expire_days is not None:
            newest = batch.agg(F.max("ts").alias("newest"))
            if batch_id:
                before = spark.read.parquet(_batch_path(f"{out}/clock", batch_id - 1))
                stored = alive(stored, before.select("now").scalar())
                newest = newest.unionByName(before.select("newest")).agg(F.max("newest").alias("newest"))
            _store_batch(newest.withColumn("now", F.least("newest", F.current_timestamp())).coalesce(1), f"{out}/clock", batch_id)
            now = spark.read.parquet(_batch_path(f"{out}/clock", batch_id)).select("now").scalar()
        rows = batch.withColumn("new", F.lit(True)).unionByName(of_keys(stored, batch, key, "left_semi").withColumn("new", F.lit(False)))
        _store_batch(rows, f"{out}/rows", batch_id)
        rows = spark.read.schema(rows.schema).parquet(_batch_path(f"{out}/rows", batch_id))
        found = spikes(rows.withColumn("tie", F.struct("id", "new")), key, "ts", "tie", F.col("neg") == 1, window, threshold)
        found = found.filter("tie.new").select(key, F.col("tie.id").alias(tie), "negative_ratio")
        found.write.mode("overwrite").parquet(_batch_path(f"{out}/spikes", batch_id))
        quiet = of_keys(stored.filter(log.bucket() == log.turn(batch_id)), batch, key, "left_anti")
        state = first_n(rows, key, [F.desc("ts"), F.desc("id")], window - 1).select(*batch.columns).unionByName(quiet)
        log.write(state if now is None else alive(state, now), batch_id)

    return run_batches(slim, write, checkpoint, **when)


def run_latest(df: DataFrame, order: list[Column], out: str, checkpoint: str, n: int = 19, **when) -> StreamingQuery:
    """Keeps the ``n`` newest rows: each batch merges its rows with the list stored by the batch before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id:
            batch = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(_batch_path(out, batch_id - 1)))
        _store_batch(top_rows(batch, order, n), out, batch_id)

    return run_batches(df, write, checkpoint, **when)


def run_once_per_key(
    df: DataFrame, key: str, order: list, out: str, checkpoint: str, buckets: int = BUCKETS, **when
) -> StreamingQuery:
    """Stores at most one row per key: rows whose key an earlier batch stored are left out.

    The stored keys stand in a ``KeyedLog`` beside ``out`` (``out``-keys), apart from the rows: a batch opens only the
    buckets that its keys fall into, each in at most ``buckets`` folders. Rows without a key are never repeats.
    """
    log = KeyedLog(f"{out.rstrip('/')}-keys", key, df.select(key).schema, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _store_batch(keep_first(batch, key, order), f"{out.rstrip('/')}-arrivals", batch_id)
        rows = spark.read.schema(batch.schema).parquet(_batch_path(f"{out.rstrip('/')}-arrivals", batch_id))
        stored = log.read(spark, batch_id, {*log.touched(rows), log.turn(batch_id)})
        rows = rows.join(stored, key, "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(_batch_path(out, batch_id))
        new = spark.read.schema(batch.schema).parquet(_batch_path(out, batch_id)).select(key)
        whole = stored.filter(log.bucket() == log.turn(batch_id))
        log.write(new.unionByName(whole).filter(F.col(key).isNotNull()), batch_id)

    return run_batches(df, write, checkpoint, **when)
