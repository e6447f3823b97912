"""Near-duplicate groups by MinHash samples folded into odd sketches.

Every document becomes its set of distinct five-word shingles (64-bit hashes) and 140 MinHash samples of it. The samples serve
twice: 28 bands of five samples give the buckets in which candidates meet, and all of them are folded into a 512-bit parity
bitmap (odd sketch), whose exclusive-or population count estimates high similarities closely. Within a bucket the bitmaps decide
which documents may be similar; what they connect is then confirmed on the full shingle sets.

No step emits the pairs of a group: documents with equal sets are one representative, a bucket returns a star per connected
part, and the confirmation returns a star per confirmed part. Large buckets and large parts are cut into blocks; each pair of
blocks is a task of its own, so that no group has to fit one task. A pair of similarity 0.85 has no common band with
probability 7e-8, one of 0.8 with 1.5e-5. The sketches' bound lies ``MARGIN`` below the similarity asked for, which loses 4e-8 and
1.4e-6 of such pairs (binomial samples, exact sums over the parity of their bits): less than the bands do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.llm.common import by_bytes, components, releasing, scan_tasks, stored, whole_groups

WORDS, BANDS, ROWS, BITS = 5, 28, 5, 512
SAMPLES = BANDS * ROWS
BLOCK = 1024
SLICE = 1 << 20  # characters that are hashed at a time
_LONG_WORD = re.compile(rb"[^\t-\r ]{65536,}")
_WORD = re.compile(rb"[^\t-\r ]+")
MARGIN = 0.2
_RNG = np.random.default_rng(20240501)
_ODD = lambda n: _RNG.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _PLACE, _SAMPLE, _BAND = _ODD(256), _ODD(WORDS), _ODD(SAMPLES), _ODD(ROWS)
_BASE = _ODD(1)[0]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _lowered(text: str | None) -> bytes:
    """The text's bytes; a word of more than 65,535 bytes stands as its digest."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
    return _LONG_WORD.sub(lambda m: b"\0" + hashlib.blake2b(m.group(), digest_size=16).hexdigest().encode(), raw) if len(raw) > 65535 else raw


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of a text, one space between words, each beginning with the last four words of the one before."""
    words: list[bytes] = []
    size = fresh = 0
    for m in _WORD.finditer(raw):
        words.append(m.group())
        size, fresh = size + len(words[-1]) + 1, fresh + 1
        if size >= SLICE and fresh >= WORDS:
            yield b" ".join(words)
            words = words[1 - WORDS :]
            size, fresh = sum(map(len, words)), 0
    if fresh:
        yield b" ".join(words)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for null and for texts without words.

    Texts are hashed ``SLICE`` characters at a time, longer ones in pieces that share four words, so memory does not grow with
    them beyond their sets.
    """
    out: list[np.ndarray] = []
    for part in by_bytes(texts, SLICE):
        raw = [_lowered(t) for t in texts[part]]
        if len(raw) == 1 and len(raw[0]) > 2 * SLICE:
            sets = [_shingles([p])[0] for p in _pieces(raw[0])]
            out.append(np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64))
        else:
            out += _shingles(raw)
    return out


def _shingles(raw: list[bytes]) -> list[np.ndarray]:
    size = np.array([len(r) + 1 for r in raw])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    up, down = _powers(max(2 * SLICE, 1 << int(len(buf)).bit_length()))
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])))
    word = _mix((sums[end] - sums[start]) * down[start])
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(size))))
    n = len(word) - WORDS + 1
    window = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS if n > 0 else 0):
        window += word[k : k + n] * _PLACE[k]
    window = _mix(window)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= WORDS:
            x = np.sort(window[lo : hi - WORDS + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif hi > lo:
            out.append(_mix((word[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (_SAMPLE[:, None] * shingles[None, at : at + 1024]).min(axis=1), out=low)
    return low >> np.uint64(32)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (n, BITS / 64) of the rows of MinHash samples: each sample flips one bit."""
    n = len(samples)
    bit = _mix(samples ^ (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flips = np.bincount((bit.astype(np.int64) + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, BITS), axis=1).view(np.uint64)


def sketch_bound(similarity: float) -> int:
    """The most differing bits that two sketches of this similarity are expected to have."""
    return int(np.ceil(BITS / 2 * (1 - np.exp(-2 * (2 * SAMPLES * (1 - similarity)) / BITS))))


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for at in by_bytes(texts, SLICE):
            part = batch.iloc[at]
            sets = shingle_sets(texts[at])
            samples = np.array([minhashes(s) for s in sets], np.uint64).reshape(len(sets), SAMPLES)
            bands = _mix(
                (samples.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[0]
            ).view(np.int64)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(),
                "n_shingles": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [b if len(s) else None for b, s in zip(bands, sets, strict=True)],
                "sketch": [x.tobytes() for x in odd_sketches(samples)],
            })


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null when empty), band hashes and odd sketch of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        releasing(_profile, _powers.cache_clear), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"
    )


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """(smallest id of its part, id) for the ids that the index pairs (a, b) connect."""
    label = np.arange(len(ids))  # ids ascend, so the smallest index is the smallest id
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[label]]
        while (new != (up := new[new])).any():
            new = up
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[moved]].tolist(), ids[moved].tolist()


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _groups(frame: pd.DataFrame, keys: list[str]) -> Iterator[slice]:
    change = np.zeros(len(frame), bool)
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    cut = [0, *np.flatnonzero(change).tolist(), len(frame)]
    return (slice(x, y) for x, y in zip(cut[:-1], cut[1:], strict=True))


def _likely(bound: int):
    """Stars of the documents of one bucket (or pair of its blocks) whose sketches differ in ``bound`` bits at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["bucket", "lo", "hi"]):
            ids, block = frame["id"].to_numpy(), frame["block"].to_numpy()
            sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
            lo, hi = frame["lo"].to_numpy(), frame["hi"].to_numpy()
            left: list[int] = []
            right: list[int] = []
            pairs = []
            for g in _groups(frame, ["bucket", "lo", "hi"]):
                if g.stop - g.start == 2:
                    pairs.append(g.start)
                elif g.stop - g.start > 2:
                    x, y = [], []
                    s, own = sketch[g], block[g]
                    for i in range(len(s) - 1):
                        near = i + 1 + np.flatnonzero(_bits(s[i + 1 :] ^ s[i]) <= bound)
                        if lo[g.start] != hi[g.start]:
                            near = near[own[near] != own[i]]
                        x.append(np.full(len(near), i))
                        y.append(near)
                    a, b = _stars(ids[g], np.concatenate(x), np.concatenate(y))
                    left += a
                    right += b
            p = np.array(pairs, np.int64)
            p = p[(_bits(sketch[p] ^ sketch[p + 1]) <= bound) & ((lo[p] == hi[p]) | (block[p] != block[p + 1]))] if len(p) else p
            yield pd.DataFrame({"a": np.concatenate((ids[p], left)).astype(np.int64), "b": np.concatenate((ids[p + 1], right)).astype(np.int64)})

    return run


def _similar(sets: list[np.ndarray], part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j with whole * |intersection| >= part * |union|, by exact counts of common shingles."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate(([0], values[1:] != values[:-1])))
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, 8_000_000 // len(sets))  # columns at a time: 32 MB
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        for at in range(0, int(column[-1]) + 1, step):
            x, y = np.searchsorted(column, (at, at + step))
            m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - at)), np.float32)
            m[owner[x:y], column[x:y] - at] = 1
            common += m @ m.T
    both = common.astype(np.int64)
    return np.nonzero(np.triu(whole * both >= part * (size[:, None] + size[None, :] - both), 1))


def _confirmed(part: int, whole: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["label", "lo", "hi"]):
            for g in _groups(frame, ["label", "lo", "hi"]):
                rows = frame.iloc[g]
                if len(rows) > 1:
                    a, b = _stars(rows["id"].to_numpy(), *_similar(shingle_sets(rows["text"].tolist()), part, whole))
                    if a:
                        yield pd.DataFrame({"a": a, "b": b})

    return run


def _blocks(df: DataFrame, count: str, block: int) -> DataFrame:
    """Columns block, lo, hi: groups of up to ``block`` rows are one task, larger ones a task per pair of blocks."""
    return (
        df.withColumn("n_blocks", F.ceil(F.col(count) / F.lit(block)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("n_blocks", "other", count)
    )


def likely_links(people: DataFrame, sketch_similarity: float = 0.85 - MARGIN, block: int = BLOCK) -> DataFrame:
    """(a, b) stars of representatives (id, bands, sketch) that meet in a bucket with near sketches."""
    rows = people.select("id", F.explode("bands").alias("bucket"))
    # The second key keeps this sum's partitioning apart from the join's, so that a hot bucket's rows can be split.
    shared = rows.groupBy("bucket", F.col("bucket").bitwiseAND(7).alias("side")).count().filter("count > 1").select("bucket", "count")
    met = _blocks(rows.join(shared, "bucket").join(people.select("id", "sketch"), "id"), "count", block)
    n = scan_tasks(people.sparkSession)
    dealt = met.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "id")
    return dealt.mapInPandas(releasing(_likely(sketch_bound(sketch_similarity))), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, part: int = 85, whole: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; more columns are ignored).

    Two documents are linked when whole * |A and B| >= part * |A or B| for their shingle sets; component_id is the smallest
    doc_id that links reach. Texts that are null, empty or white space have an empty set and are linked with nothing.
    Repeated rows of a doc_id are returned as often as they come. A null doc_id cannot be named: such rows are linked with
    nothing, their component_id is null and they are kept. An empty table gives an empty result.
    """
    seen = stored(profiles(docs), "profiles")
    named = seen.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    # Equal sets are one representative: the smallest doc_id. The second key as in likely_links.
    sets = stored(
        named.groupBy("digest", F.substring("digest", 1, 1).alias("side")).agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("x"))
        .select("digest", F.col("x.doc_id").alias("id"), "x.bands", "x.sketch"),
        "sets",
    )
    parts = components(likely_links(sets, part / whole - MARGIN, block))
    sizes = parts.groupBy("label", F.col("label").bitwiseAND(7).alias("side")).count().select("label", "count")
    members = _blocks(parts.join(sizes, "label"), "count", block)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    asked = members.join(texts, "id").repartition(scan_tasks(docs.sparkSession), "label", "lo", "hi")
    links = asked.sortWithinPartitions("label", "lo", "hi", "id").mapInPandas(releasing(_confirmed(part, whole), _powers.cache_clear), "a long, b long").filter("a <> b")
    groups = components(links)
    found = sets.join(groups, "id", "left").select("digest", F.coalesce("label", "id").alias("component_id"))
    linked = named.select("doc_id", "n_shingles", "digest").join(found, "digest").drop("digest")
    alone = seen.filter("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
