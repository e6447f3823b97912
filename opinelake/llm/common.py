"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinelake.session import shared_dir

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def id_crc(col: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: later steps use it without repeating its work."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def releasing(run: Callable[[Iterator], Iterator], *clear: Callable[[], object]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task's batches that gives its memory back at the end: Python workers are used again by later tasks.

    ``clear`` empties caches of the module.
    """

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for c in clear:
                c()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)  # what the allocator holds back for the next task
            except (AttributeError, OSError):
                pass  # another allocator

    return whole


def by_bytes(texts: list[str | None], limit: int) -> Iterator[slice]:
    """Slices of ``texts`` of up to ``limit`` characters, or of one longer text."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > limit:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def scan_tasks(spark: SparkSession) -> int:
    """Partitions for the next shuffle: the session's number, as AQE merges small ones."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold every row of the keys in them, from batches sorted by ``keys``.

    Only the rows of the last key of a batch wait for the next one.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        start = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if start == 0 and held and not (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
            yield pd.concat(held, ignore_index=True)
            held = []
        if start:
            yield pd.concat([*held, batch.iloc[:start]], ignore_index=True)
            held = []
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, label) per id, label = smallest id reachable.

    Labels fall to the smallest label of the neighbours and then to the label of their label, until nothing changes;
    each round is a table in the shared folder, so a lost executor costs one round at most. An empty input gives no rows.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("to"))
        up = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        step = stored(
            lower.join(up, "to").select("id", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("label")).alias("moved")),
            "labels",
        )
        labels = step.select("id", "label")
        if step.filter("moved").isEmpty():
            return labels
