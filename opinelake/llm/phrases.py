"""Phrase collocations by Toivonen's sampling method.

A sample of the documents proposes words and word pairs that may be frequent. Together with their negative border (the phrases that
are not proposed although all shorter phrases inside them are) they are counted exactly in a pass over all documents: every word,
every pair of proposed words, every triple whose two pairs are proposed. Border phrases that turn out to be frequent are failures:
they are added to the proposals, and another pass counts exactly what the larger set lets in and the smaller did not, until a pass
brings no failure. Then every frequent phrase is counted, whatever the sample missed.

Proposals travel as bitmaps of phrase hashes, whose size is bounded; a false positive only lets a phrase be counted that need not be.
A pass counts inside Arrow batches, in pieces of bounded length. Most phrases of a piece occur in it once, so one row a phrase would
carry little: a row holds the phrases of a piece that fall, by their hash, into one part, and their counts. Spark shuffles these rows
by part, and each part, of which there are more the longer the texts are, is summed on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinelake.llm.common import releasing, stored

#: What separates pieces and words, and what counts as the other case of a letter.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LEAST, KEPT, TOP = 10, 50, 2000
SAMPLE_SHARE, SAMPLE_LEAST = 4, 2
PIECE, TAIL = 1 << 21, 1 << 16  # the more a piece holds, the fewer rows repeat a phrase
BITS = (1 << 20, 1 << 27)
PART = 1 << 22  # bytes of texts per part that is summed at once
_TABLE = bytes(10 if c in BREAKS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxhash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The 64-bit xxHash of 8-byte numbers, as the SQL function ``xxhash64`` has it."""
    h = seed + _P5 + np.uint64(8) ^ _turned(x * _P2, 31) * _P1
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _buffers(texts: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
    """Normalised bytes, pieces ended by line breaks, and how many of the first words an earlier buffer has counted."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.translate(_TABLE)
        if len(raw) > PIECE:
            yield from _long(raw)
            continue
        held.append(raw)
        size += len(raw)
        if size > PIECE:
            yield b"\n".join(held), 0
            held, size = [], 0
    if held:
        yield b"\n".join(held), 0


def _long(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a long text, cut at blanks or breaks, each after the last two words of a piece that goes on."""
    start, carried = 0, b""
    while start < len(raw):
        cut = start + PIECE
        if cut < len(raw):
            ends = [i for i in (raw.find(b" ", cut), raw.find(b"\n", cut)) if i >= 0]
            cut = min(ends) if ends else len(raw)
        part = raw[start:cut]
        yield carried + b" " + part, len(carried.split())
        whole = carried + b" " + part
        words = [w for w in whole[-TAIL:].rsplit(b"\n", 1)[-1].split(b" ") if w]
        if len(words) < 3 and len(whole) > TAIL:  # very long words, of which the tail may begin inside one
            words = [w for w in whole.rsplit(b"\n", 1)[-1].split(b" ") if w]
        carried = b" ".join(words[-2:])
        start = cut


class Phrases:
    """The words of a buffer as codes, and its phrases of one to three words as rows of codes with their counts."""

    def __init__(self, buffer: bytes, counted: int, lang: str):
        words = pc.split_pattern(pa.array([buffer.replace(b"\n", b" \n ")], pa.binary()), b" ").flatten()
        words = words.filter(pc.not_equal(words, pa.scalar(b"", pa.binary()))).dictionary_encode()
        self.words = words.dictionary
        codes = words.indices.to_numpy().astype(np.int64)
        plain = self.words.to_pylist()
        stop = plain.index(b"\n") if b"\n" in plain else -1
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in plain], np.uint64)
        inside = codes != stop
        new = np.ones(len(codes), bool)
        new[:counted] = False  # the words before are of one piece: no breaks among them
        bits = max(len(plain) - 1, 1).bit_length()  # at most 21, as a buffer has up to 2 * PIECE bytes: three codes fit in 63
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.counts: list[np.ndarray] = []
        code, good = codes, inside
        for k in (1, 2, 3):
            if k > 1:
                n = max(len(codes) - k + 1, 0)
                code = (code[:n] << bits) + codes[k - 1 :]
                good = good[:n] & inside[k - 1 :]
            unique, count = np.unique(code[good & new[k - 1 :]], return_counts=True)
            self.parts.append(tuple(unique >> bits * i & (1 << bits) - 1 for i in reversed(range(k))))
            self.counts.append(count.astype(np.int64))

    def pair_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return xxhash_long(self.hashes[b], xxhash_long(self.hashes[a], np.uint64(42)))

    def rows(self, lang: str, k: int, parts: int, take: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """lang, k, part, phrases and counts of the phrases of k words: one row for each part that has any."""
        words, counts = self.parts[k - 1], self.counts[k - 1]
        if take is not None:
            words, counts = tuple(w[take] for w in words), counts[take]
        if not len(counts):
            return
        hashes = self.hashes[words[0]] if k == 1 else self.pair_hashes(words[0], words[1])
        if k == 3:
            hashes = xxhash_long(self.hashes[words[2]], hashes)
        place = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(place, kind="stable")
        own = [self.words.take(pa.array(w[order])) for w in words]
        phrases = pc.binary_join_element_wise(*own, pa.scalar(b" ", pa.binary())) if k > 1 else own[0]
        yield _rows(lang, k, place[order], phrases, counts[order])


def _rows(lang: str, k: int, place: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal ``place``: its phrases, one a line, and their counts as 8-byte numbers."""
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    ends = np.r_[starts, len(place)].astype(np.int32)
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), phrases), pa.scalar(b"\n", pa.binary()))
    numbers = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * np.int32(8)), pa.py_buffer(counts.astype("<i8"))])
    same = [pa.repeat(pa.scalar(lang, pa.string()), len(starts)), pa.repeat(pa.scalar(k, pa.int32()), len(starts))]
    return pa.RecordBatch.from_arrays([*same, pa.array(place[starts].astype(np.int64)), lines, numbers], ["lang", "k", "part", "phrases", "counts"])


class Bitmap:
    """A set of hashes, with false positives."""

    def __init__(self, data: np.ndarray):
        self.data, self.last = data, np.uint64(len(data) * 8 - 1)

    def __contains__(self, other: Bitmap) -> bool:
        return not (other.data & ~self.data).any()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.last
        return self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))


def _in_phrases(texts: DataFrame, rows: Callable[[Phrases, str], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``rows`` of the phrases of each buffer; a buffer holds texts of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column("text").filter(pc.equal(langs.indices, i)).view(pa.binary())
                texts = chain.from_iterable(own.slice(at, 256).to_pylist() for at in range(0, len(own), 256))
                for buffer, counted in _buffers(texts):
                    yield from rows(Phrases(buffer, counted, lang), lang)

    return texts.mapInArrow(releasing(run), "lang string, k int, part long, phrases binary, counts binary")


def _parts(texts: DataFrame) -> int:
    """The number of parts that phrases are dealt to: it grows with the length of the texts, so parts do not."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + size // PART


def _summed(rows: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, f) of what is found at least so often; k = 0 holds the number of words of a language."""

    def add(part: pa.Table) -> pa.Table:
        found = []
        for kind in part.group_by(["lang", "k"], use_threads=False).aggregate([]).to_pylist():
            own = part.filter((pc.field("lang") == kind["lang"]) & (pc.field("k") == kind["k"]))
            phrases = pc.list_flatten(pc.split_pattern(own["phrases"], b"\n"))
            counts = np.frombuffer(b"".join(own["counts"].to_pylist()), "<i8")
            sums = pa.table({"phrase": phrases, "f": counts}).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
            if kind["k"]:
                sums = sums.filter(pc.field("f_sum") >= least)
            same = [pa.repeat(pa.scalar(kind["lang"], pa.string()), len(sums)), pa.repeat(pa.scalar(kind["k"], pa.int32()), len(sums))]
            phrase = sums["phrase"].combine_chunks().view(pa.string())
            found.append(pa.table([*same, phrase, sums["f_sum"]], ["lang", "k", "phrase", "f"]))
        return pa.concat_tables(found)

    return rows.groupBy("part").applyInArrow(add, "lang string, k int, phrase string, f long")


def sampled(texts: DataFrame, least: int, parts: int) -> DataFrame:
    """Words and pairs that occur at least so often in the sample: a quarter of the documents, by a hash of the text."""

    def rows(p: Phrases, lang: str) -> Iterator[pa.RecordBatch]:
        yield from p.rows(lang, 1, parts)
        yield from p.rows(lang, 2, parts)

    return _summed(_in_phrases(texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0), rows), least)


def _admitted(p: Phrases, words, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs and triples of a buffer have all shorter phrases inside them proposed."""
    word = words.value.has(p.hashes)
    a, b = p.parts[1]
    x, y, z = p.parts[2]
    both = pairs.value.has(p.pair_hashes(x, y))
    both[both] = pairs.value.has(p.pair_hashes(y[both], z[both]))
    return word[a] & word[b], both


def counted(texts: DataFrame, now: tuple, before: tuple | None, parts: int) -> DataFrame:
    """Exact counts of what the proposals ``now`` admit and those of ``before`` did not; all words in the first pass."""

    def rows(p: Phrases, lang: str) -> Iterator[pa.RecordBatch]:
        admitted = _admitted(p, *now)
        if before is None:
            yield _rows(lang, 0, np.zeros(1, np.int64), pa.array([b""], pa.binary()), p.counts[0].sum(keepdims=True))
            yield from p.rows(lang, 1, parts)
        else:
            admitted = tuple(new & ~old for new, old in zip(admitted, _admitted(p, *before), strict=True))
        yield from p.rows(lang, 2, parts, admitted[0])
        yield from p.rows(lang, 3, parts, admitted[1])

    return _in_phrases(texts, rows)


def bitmap(found: DataFrame, k: int, bits: int) -> Bitmap:
    """The bitmap of the phrases of k words: built in tasks, at most ``bits`` of it reach the driver."""
    words = F.split("phrase", " ", -1)
    hashes = [F.xxhash64("lang", F.get(words, F.lit(i))) for i in range(k)]
    hashed = F.xxhash64(*hashes) if k > 1 else hashes[0]
    place = hashed.bitwiseAND(bits - 1)
    size = min(bits, 1 << 15)  # of the rows that are collected
    parts = found.filter(F.col("k") == k).select(F.bitmap_bucket_number(place + 1).alias("bucket"), F.bitmap_bit_position(place + 1).alias("at")).groupBy("bucket")
    data = np.zeros(bits // 8, np.uint8)
    for r in parts.agg(F.bitmap_construct_agg("at").alias("map")).toLocalIterator():
        low = (r["bucket"] - 1) * (size // 8)
        data[low : low + size // 8] = np.frombuffer(r["map"], np.uint8)[: size // 8]
    return Bitmap(data)


def frequent_phrases(texts: DataFrame, least: int = LEAST, sample_least: int = SAMPLE_LEAST) -> tuple[DataFrame, int]:
    """Counts (lang, k, phrase, f) of all words and phrases of up to three words with f >= least, and the number of passes."""
    spark = texts.sparkSession
    parts = _parts(texts)
    proposed = stored(sampled(texts, sample_least, parts), "proposed")
    bits = BITS[0]
    while bits < min(BITS[1], 16 * proposed.count()):
        bits *= 2
    sets = [bitmap(proposed, k, bits) for k in (1, 2)]
    found: list[DataFrame] = []
    before = None
    while True:
        now = tuple(spark.sparkContext.broadcast(b) for b in sets)
        found.append(stored(_summed(counted(texts, now, before, parts), least), "counted"))
        fresh = [bitmap(found[-1], k, bits) for k in (1, 2)]
        if all(f in s for f, s in zip(fresh, sets, strict=True)):  # no border phrase was frequent
            return reduce(DataFrame.unionByName, found), len(found)
        before, sets = now, [Bitmap(f.data | s.data) for f, s in zip(fresh, sets, strict=True)]


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, top: int = TOP, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of two or three words of each language.

    docs: text, lang; more columns are ignored. a is the phrase's count (at least ``least``), n the language's number of words, l and
    r the counts of the two parts at the cut with the least score floor(1000000 a a / (l r)), ties to the earlier cut. Phrases
    inside a longer one that is frequent too and makes up at least ``kept`` percent of a are left out. Order: score, a (both
    descending), phrase. Null texts are empty, a null language is ``und``; repeated rows count again; an empty table gives an empty
    result. Products are exact for counts below 10 ** 16.
    """
    texts = _texts(docs)
    counts, _ = frequent_phrases(texts, least, sample_least)
    phrases = counts.filter("k >= 2").withColumn("w", F.split("phrase", " ", -1)).withColumnRenamed("f", "a")
    part = lambda lo, hi: F.array_join(F.slice("w", lo, hi), " ")
    side = lambda c, name: counts.filter("k > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(c))
    cuts = phrases.select("lang", "phrase", "k", "a", F.inline(F.array(
        F.struct(F.lit(1).alias("cut"), part(1, 1).alias("left"), part(2, 2).alias("right")),
        F.struct(F.lit(2).alias("cut"), part(1, 2).alias("left"), part(3, 1).alias("right")),
    ))).filter("cut < k")
    # The square of a count may pass 64 bits, not 38 digits; ``div`` cuts off the rest.
    scored = cuts.join(side("l", "left"), ["lang", "left"]).join(side("r", "right"), ["lang", "right"]).withColumn(
        "score", F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    # What a pair loses to the most frequent triple around it.
    longer = phrases.filter("k = 3").select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), F.col("a").alias("longer"))
    around = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("around"))
    n = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    alone = best.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * kept))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
