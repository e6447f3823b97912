"""Line dedup: lines that stand in many documents are dropped from all of them.

A line's key is its text without white space at both ends, A to Z in lower case. The keys of a document are counted once each, as
128-bit hashes that are summed in tasks before they are shuffled. The hashes that reach the count are indexed by a minimal perfect
hash, one for each shard of the hash space, built in a task of its own: levels of bit arrays in which a hash owns a place if no
other falls on it, the others trying the next level; the number of set bits before its place is its index. The index leads into
compact arrays: the second half of the hash as fingerprint, and the count. A line that is not in the index gets the index of
another one, or none, and its fingerprint differs.

Documents probe these arrays instead of joining their lines. While all arrays together stay below ``SMALL`` bytes (a checked
size) they are broadcast, and documents never move. Beyond that the arrays stay in their shards: a document sends one packed row of
hashes to each shard it needs, salted so that a frequent shard is split, and gets back the numbers of the lines to drop.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.llm.common import releasing, scan_tasks, stored

#: What is stripped from the ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
SMALL = 64 << 20
SHARD_KEYS = 1 << 18
GAMMA = 2.0
SALTS = 8
_ONE = np.uint64(1)


def keys_of(text: str | None) -> list[bytes]:
    """The key of each line of a text; null is one empty line."""
    return [line.strip(SPACE) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of the keys' 128-bit hashes."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), "<u8").reshape(-1, 2)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least < 2 or len(key.decode("utf-8", "surrogatepass")) >= least)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x ^ np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of different 64-bit numbers: each gets an index of its own below their count."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        left = keys
        while len(left):
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            place = (_mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            own = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(own, bitorder="little").view("<u8"))
            left = left[~own[place]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; some index or -1 for numbers that it was not built for."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = (_mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            here = self.bits[word] >> bit & _ONE == _ONE
            below = np.bitwise_count(self.bits[word] & ((_ONE << bit) - _ONE)).astype(np.int64)
            found[left[here]] = (self.before[word] + below)[here]
            left = left[~here]
            if not len(left):
                break
        return found


class Shard:
    """Fingerprints and counts behind a perfect hash, to and from one row of binary columns."""

    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes):
        self.hash = PerfectHash(list(sizes), np.frombuffer(bits, "<u8"))
        self.prints, self.counts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<i8")

    @staticmethod
    def row(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[list[int], bytes, bytes, bytes]:
        if len(np.unique(first)) < len(first):  # 2e-9 for a shard of the usual size
            raise ValueError("two hashes of a shard share their first half: use another number of keys a shard")
        perfect = PerfectHash.build(first)
        at = perfect.index(first)
        prints, number = np.empty(len(at), "<u8"), np.empty(len(at), "<i8")
        prints[at], number[at] = second, counts
        return perfect.sizes, perfect.bits.tobytes(), prints.tobytes(), number.tobytes()

    def count(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 for one that is not indexed."""
        at = self.hash.index(first)
        known = at >= 0
        known[known] = self.prints[at[known]] == second[known]
        out = np.zeros(len(first), np.int64)
        out[known] = self.counts[at[known]]
        return out


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[bytes] = Counter()
            for text in batch.column("text").to_pylist():
                n.update({k for k in keys_of(text) if long_enough(k, least)})
            halves = _hashes(list(n)).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(list(n.values()), pa.int64())], ["first", "second", "n"]
            )

    return run


def frequent_lines(texts: DataFrame, min_docs: int, least: int) -> DataFrame:
    """(first, second, n): halves of the hash and number of documents of the line keys in at least ``min_docs`` documents."""
    counts = texts.select("text").mapInArrow(releasing(_counted(least)), "first long, second long, n long")
    return counts.groupBy("first", "second").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)


def _shard_of(shards: int) -> Column:
    return F.pmod("second", F.lit(shards)).cast("int")


_SHARD = "shard int, sizes array<int>, bits binary, prints binary, counts binary"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard, from rows sorted by shard; a shard's rows are held, about ``SHARD_KEYS`` of them."""

    def row(shard: int, held: list[np.ndarray]) -> pa.RecordBatch:
        first, second, n = np.concatenate(held, axis=1)
        sizes, *arrays = Shard.row(first.view("<u8"), second.view("<u8"), n)
        return pa.RecordBatch.from_pylist(
            [dict(zip(("shard", "sizes", "bits", "prints", "counts"), (shard, sizes, *arrays), strict=True))],
            pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("bits", "prints", "counts")]]),
        )

    now, held = None, []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        values = np.stack([batch.column(c).to_numpy() for c in ("first", "second", "n")])
        cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            if held and shard[lo] != now:
                yield row(int(now), held)
                held = []
            now = shard[lo]
            held.append(values[:, lo:hi])
    if held:
        yield row(int(now), held)


def index_lines(texts: DataFrame, min_docs: int, least: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The stored shards, their number and the bytes of all arrays."""
    found = stored(frequent_lines(texts, min_docs, least), "frequent-lines")
    shards = max(1, -(-found.count() // shard_keys))
    dealt = found.withColumn("shard", _shard_of(shards)).repartition(scan_tasks(texts.sparkSession), "shard")
    built = stored(dealt.sortWithinPartitions("shard").mapInArrow(releasing(_built), _SHARD), "line-index")
    size = built.select(F.coalesce(F.sum(F.length("bits") + F.length("prints") + F.length("counts")), F.lit(0)).alias("s")).first()["s"]
    return built, shards, int(size)


def _kept(text: str | None, drop: np.ndarray) -> str:
    if not drop.any():
        return text or ""
    return "\n".join([line for line, gone in zip((text or "").split("\n"), drop.tolist(), strict=True) if not gone])


def _answer(batch: pa.RecordBatch, drops: Iterator[np.ndarray]) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    n_lines, n_dropped, kept = [], [], []
    for text, drop in zip(texts, drops, strict=True):
        n_lines.append(len(drop))
        n_dropped.append(int(drop.sum()))
        kept.append(_kept(text, drop))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
        ["doc_id", "n_lines", "n_dropped", "text"],
    )


_RESULT = "doc_id long, n_lines long, n_dropped long, text string"


def _probed(arrays, shards: int, least: int):
    """Documents against the broadcast arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: Shard(*row) for s, row in arrays.value.items()}

        def drop(text: str | None) -> np.ndarray:
            keys = keys_of(text)
            out = np.zeros(len(keys), bool)
            at = [i for i, k in enumerate(keys) if long_enough(k, least)]
            if at:
                first, second = _hashes([keys[i] for i in at]).T
                own = second.view("<i8") % shards
                hit = np.zeros(len(at), bool)
                for s in np.unique(own).tolist() if shards > 1 else (0,):
                    if s in index:
                        mine = own == s
                        hit[mine] = index[s].count(first[mine], second[mine]) > 0
                out[np.array(at)[hit]] = True
            return out

        for batch in batches:
            yield _answer(batch, map(drop, batch.column("text").to_pylist()))

    return run


def _asking(shards: int, least: int):
    """A packed row of line numbers and hashes for each document and shard that it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"name": [], "shard": [], "lines": [], "hashes": []}
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys = keys_of(text)
                at = np.array([i for i, k in enumerate(keys) if long_enough(k, least)], "<i8")
                if not len(at):
                    continue
                hashes = _hashes([keys[i] for i in at.tolist()])
                own = hashes[:, 1].view("<i8") % shards
                for s in np.unique(own).tolist():
                    rows["name"].append(name)
                    rows["shard"].append(s)
                    rows["lines"].append(at[own == s].tobytes())
                    rows["hashes"].append(hashes[own == s].tobytes())
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("name", pa.binary()), ("shard", pa.int32()), ("lines", pa.binary()), ("hashes", pa.binary())])
            )

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to drop per asking row; rows sorted by shard and salt, the arrays before those that ask."""
    shard, now = None, None
    for batch in batches:
        names, dropped = [], []
        for r in batch.to_pylist():
            if r["bits"] is not None:
                now, shard = (r["shard"], r["salt"]), Shard(r["sizes"], r["bits"], r["prints"], r["counts"])
            elif now == (r["shard"], r["salt"]):
                first, second = np.frombuffer(r["hashes"], "<u8").reshape(-1, 2).T
                gone = np.frombuffer(r["lines"], "<i8")[shard.count(first, second) > 0]
                if len(gone):
                    names.append(r["name"])
                    dropped.append(gone.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(dropped, pa.binary())], ["name", "lines"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def drop(text: str | None, gone: list[bytes] | None) -> np.ndarray:
        out = np.zeros((text or "").count("\n") + 1, bool)
        for part in gone or []:
            out[np.frombuffer(part, "<i8")] = True
        return out

    for batch in batches:
        yield _answer(batch, map(drop, batch.column("text").to_pylist(), batch.column("gone").to_pylist()))


def without_common_lines(
    docs: DataFrame, min_docs: int = 10, least: int = 1, small: int = SMALL, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of every row of ``docs`` (doc_id, text; more columns are ignored), common lines dropped.

    A line is common if its key has at least ``least`` code points and stands in at least ``min_docs`` rows; a row is a document,
    also a repeated one or one without doc_id, and a key counts once in it. n_lines counts lines before, n_dropped those that go;
    the others are joined by line breaks, unchanged. Null and empty texts are one empty line, which stays. Rows come back as
    often as they came; an empty table gives an empty result. ``small`` bounds what is broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index, shards, size = index_lines(rows, min_docs, least, shard_keys)
    if size <= small:
        arrays = spark.sparkContext.broadcast({r["shard"]: (r["sizes"], bytes(r["bits"]), bytes(r["prints"]), bytes(r["counts"])) for r in index.collect()})
        return rows.mapInArrow(releasing(_probed(arrays, shards, least)), _RESULT)
    # Equal rows have equal answers, so a digest of the text names the rows that ask.
    named = rows.withColumn("name", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    asking = named.select("name", "text").mapInArrow(releasing(_asking(shards, least)), "name binary, shard int, lines binary, hashes binary")
    salt = F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")
    both = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).unionByName(
        asking.dropDuplicates(["name", "shard"]).withColumn("salt", salt), allowMissingColumns=True
    )
    met = both.repartition(scan_tasks(spark), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("bits").isNull())
    gone = met.mapInArrow(releasing(_answered), "name binary, lines binary").groupBy("name").agg(F.collect_list("lines").alias("gone"))
    told = named.join(gone, "name", "left").select("doc_id", "text", "gone")
    return told.mapInArrow(releasing(_applied), _RESULT)
