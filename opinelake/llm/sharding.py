"""Shards by fixed virtual slots.

A row's slot is a hash of its id modulo ``SLOTS``, for ever. What changes is the map from slots to shards, a table of ``SLOTS``
rows with a version. Version 1 deals the slots round; rebalancing counts the bytes of every slot and edits the map into the next
version, moving as few slots as it takes to bring the shards' bytes near each other. Rows follow their slot, so no row has to be
looked at to decide where it goes. Only the map and the sums per slot (``SLOTS`` rows each) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinelake.session import shared_dir

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    version: int
    shard: tuple[int, ...]  # by slot

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, tuple(s % shards for s in range(slots)))

    def rebalanced(self, weight: list[int], shards: int) -> SlotMap:
        """The next version: over-full shards give up slots, smallest first, which go to the emptiest shards, largest first;
        then single moves from the fullest to the emptiest shard as long as they bring the two closer."""
        own: list[list[int]] = [[] for _ in range(shards)]
        pool = []
        for slot, shard in enumerate(self.shard):
            (own[shard] if shard < shards else pool).append(slot)
        load = [sum(weight[s] for s in slots) for slots in own]
        target = sum(weight) / shards
        for shard in range(shards):
            own[shard].sort(key=lambda s: (-weight[s], s))
            while own[shard] and load[shard] > target:
                slot = own[shard].pop()
                load[shard] -= weight[slot]
                pool.append(slot)
        for slot in sorted(pool, key=lambda s: (-weight[s], s)):
            to = min(range(shards), key=lambda k: (load[k], k))
            own[to].append(slot)
            load[to] += weight[slot]
        for _ in range(4 * shards):
            high, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            fits = [s for s in own[high] if 0 < weight[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(gap - 2 * weight[s]), s))
            own[high].remove(slot)
            own[low].append(slot)
            load[high] -= weight[slot]
            load[low] += weight[slot]
        shard = [0] * len(self.shard)
        for k, slots in enumerate(own):
            for s in slots:
                shard[s] = k
        return SlotMap(self.version + 1, tuple(shard))


def slot_of(key: Column, other: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a row by its key; rows without a key are spread by ``other``."""
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(other, F.lit(1))), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 and virtual slot of every row; null texts have no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def _column(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<long>")


def store_map(spark: SparkSession, slot_map: SlotMap, weight: list[int], rows: list[int], folder: str) -> DataFrame:
    """Writes one version as ``folder``/version=N and returns it with each slot's bytes, rows and first place in its shard."""
    place, filled = [], dict.fromkeys(slot_map.shard, 0)
    for slot, shard in enumerate(slot_map.shard):
        place.append(filled[shard])
        filled[shard] += rows[slot]
    columns = {"shard": list(slot_map.shard), "bytes": weight, "rows": rows, "first": place}
    zipped = F.arrays_zip(*[_column(v).alias(k) for k, v in columns.items()])
    table = spark.range(1, numPartitions=1).select(F.posexplode(zipped).alias("virtual_slot", "x")).select(
        "virtual_slot", F.col("x.shard").cast("int").alias("shard"), "x.bytes", "x.rows", "x.first"
    )
    table.write.parquet(f"{folder}/version={slot_map.version}")
    return spark.read.schema(table.schema).parquet(f"{folder}/version={slot_map.version}")


def load_map(spark: SparkSession, folder: str, version: int, slots: int = SLOTS) -> SlotMap:
    """A stored version; ``slots`` rows."""
    shard = [0] * slots
    for r in spark.read.parquet(f"{folder}/version={version}").select("virtual_slot", "shard").collect():
        shard[r["virtual_slot"]] = r["shard"]
    return SlotMap(version, tuple(shard))


def shard_by_bytes(docs: DataFrame, shards: int = 16, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; more columns are ignored) with its shard and its place there.

    Columns: doc_id, size, text_crc32, shard, slot (place in the shard, gapless from 0, ordered by virtual slot and doc_id),
    virtual_slot. Shards are near equal in bytes. Rows without a doc_id are dealt by their text; repeated rows each have a
    place; a null text has size 1 and crc32 0; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = sized(docs, slots)
    weight, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        weight[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["n"]
    folder = folder or shared_dir(spark, "slot-map")
    first = SlotMap.first(shards, slots)
    store_map(spark, first, weight, count, folder)
    current = store_map(spark, first.rebalanced(weight, shards), weight, count, folder)
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("rank", F.row_number().over(order))
    # The map has `slots` rows, a fixed number.
    joined = placed.join(F.broadcast(current.select("virtual_slot", "shard", "first")), "virtual_slot")
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "virtual_slot")
