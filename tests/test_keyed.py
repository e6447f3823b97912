"""Key state of streams: what a trigger reads and writes, over more batches than buckets."""

import random

from pyspark.sql import functions as F

from opinelake.operators import windows as wn
from opinelake.streaming import keyed as kd
from opinelake.streaming import live as lv


def batches(spark, path, parts, schema):
    """One file per part, in this order of time stamps."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return lv.read_stream(spark, path, 1)


def test_log_equals_a_dictionary(spark, tmp_path):
    """Random writes, a repeated batch, a null key; the newest rows of each key are read, from a bounded number of folders."""
    rng, schema = random.Random(3), "k string, v int"
    log = kd.KeyedLog(str(tmp_path / "log"), "k", spark.createDataFrame([], schema).schema, buckets=3)
    expected = {}
    for batch_id in range(8):
        touched = {rng.choice([None, *"abcdefgh"]) for _ in range(2)}
        new = [(k, batch_id * 10 + i) for k in touched for i in range(rng.randint(1, 2))]
        frame = spark.createDataFrame(new, schema)
        for _ in range(2 if batch_id == 5 else 1):  # a batch that is repeated after a failure
            whole = log.read(spark, batch_id, [log.turn(batch_id)]).filter(log.bucket() == log.turn(batch_id))
            log.write(frame.unionByName(kd.of_keys(whole, frame, "k", "left_anti")), batch_id)
        expected.update({k: sorted(r for r in new if r[0] == k) for k in touched})
        assert len(log.folders(spark, batch_id + 1, range(3))) <= 9
    found = sorted(map(tuple, log.read(spark, 8, range(3)).collect()), key=str)
    assert found == sorted((r for rows in expected.values() for r in rows), key=str)


def test_spike_state_grows_with_the_batch(spark, tmp_path):
    """600 keys in the first batch, two in each later one: these write their own keys and one bucket."""
    n, schema = 600, "event_id int, user string, at int, label string"
    first = [(i, f"k{i % n}", i, "negative" if i % 3 == 0 else "positive") for i in range(2 * n)]
    parts, at = [first], 2 * n
    for b in range(6):
        parts.append([(at + i, f"k{b % 3 + i % 2}", at + i, "negative" if i % 2 else "neutral") for i in range(12)])
        at += 12
    raw = batches(spark, str(tmp_path / "in"), parts, schema)
    negative, ts = F.col("label") == "negative", F.timestamp_seconds(F.lit(1000000000) + F.col("at") * 60)
    out = str(tmp_path / "s")
    lv.run_spikes(raw.withColumn("ts", ts), "user", "ts", "event_id", negative, out, f"{out}c", expire_days=3650, buckets=4).awaitTermination()
    everything = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", ts)
    wanted = wn.spikes(everything, "user", "ts", "event_id", negative).select("user", "event_id", "negative_ratio").collect()
    found = spark.read.parquet(f"{out}/spikes").select("user", "event_id", "negative_ratio").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, wanted)) and wanted
    for batch_id in (len(parts) - 2, len(parts) - 1):  # of older ones, buckets that were written whole since are gone
        assert spark.read.parquet(f"{out}/state/batch={batch_id:09d}").select("user").distinct().count() < n // 4 + 60


def test_stored_keys_are_opened_by_bucket(spark, tmp_path, monkeypatch):
    """A batch with one key opens at most its own bucket and the one in turn; each key is stored once over many batches."""
    schema, keys = "k string, v int", [f"k{i}" for i in range(40)]
    parts = [[(k, 0) for k in keys]] + [[(f"k{b}", b), (f"n{b}", b), (None, b)] for b in range(1, 7)]
    opened, real = [], kd.KeyedLog.folders
    monkeypatch.setattr(kd.KeyedLog, "folders", lambda *a: opened.append(real(*a)) or opened[-1])
    out = str(tmp_path / "o")
    lv.run_once_per_key(batches(spark, str(tmp_path / "in"), parts, schema), "k", ["v"], out, f"{out}c", buckets=4).awaitTermination()
    rows = [tuple(r) for r in spark.read.parquet(out).select("k", "v").collect()]
    named = [r for r in rows if r[0] is not None]
    assert sorted(named) == sorted([(k, 0) for k in keys] + [(f"n{b}", b) for b in range(1, 7)])
    assert len(rows) - len(named) == 6  # rows without a key are no repeats of each other
    assert all(len({p.rsplit("=", 1)[1] for p in paths}) <= 4 and len(paths) <= 16 for paths in opened)
