"""Benchmark decontamination by spaced seeds.

Texts are words (runs of letters and digits, lower-cased). A seed is a window of words of which a fixed mask ignores some, so
two texts that differ in a word still share seeds whose mask skips it. Three masks of weight 6 are hashed at every place of the
benchmark, and in the training texts at every place whose first two words stand together somewhere in the benchmark (a bitmap of
word pairs tells; all masks begin with two kept words, so this leaves out nothing that could match). Equal hashes give hits; around
a hit both texts are laid over each other, and an item leaks if in some stretch of up to ``STRETCH`` words over the hit at least
``SHARE`` of the words agree, or if the ``LEAST_WORDS`` words at the hit agree in full. Substituted words cost only themselves, and
a verbatim excerpt is found whatever stands around it.

Everything is a column expression on one pass over the documents; only hits that hold are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ("11101011", "11010111", "110110011")
STRETCH, SHARE = 20, 0.8
LEAST_WORDS = len(MASKS[0])
SHORT_WORDS = 4
BITMAP = 1 << 16  # places of the pair bitmap per 8,192 benchmark pairs
BROADCAST_SEEDS = 50_000  # places: three seeds each with up to 49 words of 8 bytes, about 64 MB in all


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no words for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(text: Column) -> Column:
    """The words of a text as 64-bit hashes."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _pair(words: Column, at: Column) -> Column:
    """Hash of the words at a place (from 0) and the next."""
    return F.get(words, at).bitwiseXOR(F.shiftrightunsigned(F.get(words, at + 1), 7))


def _seed(words: Column, at: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, at + k) for k, bit in enumerate(mask) if bit == "1"])


def _seeds(words: Column, at: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """One hash per mask of the window that starts at a place; null where the window does not fit."""
    return F.array(*[F.when(at + len(m) <= F.size(words), _seed(words, at, m, i)) for i, m in enumerate(masks)])


def _around(words: Column, at: Column) -> tuple[Column, Column]:
    """The words that stretches over a hit at a place can reach, and the place within them."""
    low = F.greatest(F.lit(0), at - STRETCH)
    return F.slice(words, low + 1, F.lit(2 * STRETCH + max(map(len, MASKS)))), at - low


def _agree(words: Column, n_words: Column, item: Column, n_item: Column, shift: Column, place: Column, span: Column) -> Column:
    """Largest share of equal words in a stretch over the hit; ``item`` begins ``shift`` words into ``words``."""
    low, high = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(words) - shift)
    length = F.least(F.lit(STRETCH), n_item, n_words)
    first, last = F.greatest(low, place + span - length), F.least(high - length, place)  # of the stretches over the hit
    equal = lambda at: F.when(F.get(item, at) == F.get(words, at + shift), 1).otherwise(0)
    flags = F.when(last >= first, F.transform(F.sequence(first, last + length - 1), equal))
    totals = F.transform(
        F.sequence(F.lit(0), last - first),
        lambda s: F.aggregate(F.slice(flags, s + 1, length), F.lit(0), lambda a, x: a + x),
    )
    return F.when(last >= first, F.array_max(totals) / length).otherwise(F.lit(0.0))


def _verbatim(words: Column, item: Column, here: Column, place: Column) -> Column:
    """Whether ``LEAST_WORDS`` words from a hit on agree in full; every run of that many equal words has such a hit."""
    return F.forall(F.sequence(F.lit(0), F.lit(LEAST_WORDS - 1)), lambda k: F.get(words, here + k) == F.get(item, place + k))


def _pair_map(places: DataFrame, bits: int) -> bytes:
    """A byte for each place of the pair bitmap; tasks build it, ``bits`` / 8 bytes at most reach the driver."""
    place = F.pmod(_pair(F.col("item"), F.col("item_at")), F.lit(bits)) + 1
    parts = places.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("bucket")
    out = bytearray(bits)
    for r in parts.agg(F.bitmap_construct_agg("at").alias("map")).collect():
        low = (r["bucket"] - 1) << 15
        for i, byte in enumerate(r["map"]):
            if byte:
                out[low + 8 * i : low + 8 * i + 8] = bytes(byte >> k & 1 for k in range(8))
    return bytes(out)


def _whole_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are all of an item of fewer than ``SHORT_WORDS`` words."""
    few = lambda c: F.size(c).between(1, SHORT_WORDS - 1)
    whole = docs.filter(few("words")).join(items.filter(few("item")), F.col("words") == F.col("item"))
    return whole.select("doc_id", "item_id", F.lit(1.0).alias("matched_share"), F.lit(0).alias("doc_word")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched_share, doc_word) for each document and benchmark item that share a stretch of words.

    docs: doc_id, text; benchmark: item_id, text; more columns are ignored. ``matched_share`` is the best stretch's share of equal
    words, 1 for a short stretch that agrees in full, and ``doc_word`` the place of its hit. Items of four to seven words match
    where they stand in full, those of one to three words match a document of just these words; documents of fewer than eight
    words match such items alone. Null and empty texts have no words and match nothing. Rows without an id take part, under a null
    id; repeated rows are one result. An empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), hashed(F.col("text").cast("string")).alias("item"))
    items = items.filter(F.size("item") > 0)
    sizes = [r["n"] for r in items.filter(F.size("item") < LEAST_WORDS).select(F.size("item").alias("n")).distinct().collect()]  # seven at most
    short = sorted(n for n in sizes if n >= SHORT_WORDS)
    least = min([*short, LEAST_WORDS])
    places = items.filter(F.size("item") >= least).select(
        "item_id", "item", F.explode(F.sequence(F.lit(0), F.greatest(F.size("item") - LEAST_WORDS, F.lit(0)))).alias("item_at")
    )
    n = places.count()
    bits = BITMAP
    while bits < 8 * n and bits < BITMAP << 6:
        bits <<= 1
    bitmap = _pair_map(places, bits)
    # An item too short for the masks has one seed, of all its words.
    masks = (*MASKS, *["1" * m for m in short])
    own = lambda at: F.array(*[
        F.when(F.size("item") == len(m), _seed(F.col("item"), at, m, len(MASKS) + i)) for i, m in enumerate(masks[len(MASKS) :])
    ])
    item_seeds = F.concat(_seeds(F.col("item"), F.col("item_at")), own(F.col("item_at"))) if short else _seeds(F.col("item"), F.col("item_at"))
    part, place = _around(F.col("item"), F.col("item_at"))
    seeds = places.select(
        "item_id", part.alias("part"), place.alias("place"), F.size("item").alias("n_item"), F.posexplode(item_seeds).alias("mask", "seed")
    ).filter("seed IS NOT NULL")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed(F.col("text").cast("string")).alias("words"))
    pair = lambda at: F.pmod(_pair(F.col("words"), at), F.lit(bits)).cast("int") + 1
    hot = F.filter(
        F.sequence(F.lit(0), F.size("words") - least), lambda at: F.substring(F.lit(bitmap), pair(at), F.lit(1)) == F.lit(b"\x01")
    )

    def near(at: Column) -> Column:  # what goes on holds the words around a place only
        words, here = _around(F.col("words"), at)
        return F.struct(at.alias("at"), words.alias("near"), here.alias("here"), _seeds(F.col("words"), at, masks).alias("seeds"))

    found = rows.filter(F.size("words") >= least).select("doc_id", F.size("words").alias("n_words"), F.inline(F.transform(hot, near)))
    found = found.select("doc_id", "n_words", "at", F.col("near").alias("words"), "here", F.explode("seeds").alias("seed")).filter("seed IS NOT NULL")
    # Small benchmarks are broadcast (at most BROADCAST_SEEDS places); larger ones are joined by shuffling on the seed.
    hits = found.join(F.broadcast(seeds) if n <= BROADCAST_SEEDS else seeds, "seed")
    spans = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)
    share_ = _agree(
        F.col("words"), F.col("n_words"), F.col("part"), F.col("n_item"), F.col("here") - F.col("place"), F.col("place"), spans
    )
    whole = _verbatim(F.col("words"), F.col("part"), F.col("here"), F.col("place"))
    full = F.forall(F.sequence(F.lit(0), F.col("n_item") - 1), lambda k: F.get(F.col("words"), F.col("here") + k) == F.get(F.col("part"), k))
    agreed = F.when(whole, F.lit(1.0)).otherwise(share_)
    if short:
        agreed = F.when(F.col("n_item") < LEAST_WORDS, F.when(F.coalesce(full, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(agreed)
    scored = hits.select("doc_id", "item_id", "at", agreed.alias("matched_share"))
    stretches = scored.filter(F.col("matched_share") >= share).groupBy("doc_id", "item_id").agg(
        F.max("matched_share").alias("matched_share"), F.max_by(F.col("at"), F.struct("matched_share", -F.col("at"))).alias("doc_word")
    )
    if min([*sizes, SHORT_WORDS]) < SHORT_WORDS:
        return stretches.unionByName(_whole_documents(rows, items))
    return stretches


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that share no stretch with a benchmark item; rows without a doc_id cannot be named and stay."""
    found = leaks(docs, benchmark, share).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col("_leaked"), "left_anti")
