"""Aspect scores from word vectors learned on the texts themselves: no labelled sentences are needed.

The vectors come from Word2Vec. Each aspect has two directions: what it is about (its name and the words its good and bad phrases
share), and the axis from its bad to its good phrases. A word counts for a direction by its cosine with it, so a sentence needs only
sums of a small table of words by directions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake import lexicons as lx
from opinelake.functions import values as vl
from opinelake.operators.ordering import top_k
from opinelake.operators.ranking import seeded_sample

WORD = r"[a-z']+"


@dataclass(frozen=True)
class WordVectors:
    """``table``: word and its unit vector, at most ``max_words`` rows."""

    table: DataFrame
    size: int


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def fit_word_vectors(
    texts: DataFrame, key: str, text: str, size: int = 32, window: int = 5, min_count: int = 5, epochs: int = 5,
    sample_rows: int = 4_000, max_words: int = 50_000, seed: int = 42,
) -> WordVectors:
    """Word2Vec over ``sample_rows`` texts in seeded hash order (all, when there are fewer).

    The sample bounds the fit, which runs in one task so that it repeats; ``max_words`` keeps the commonest words of at least
    ``min_count`` occurrences (ties: the smaller word). Scoring covers all texts.
    """
    sample = seeded_sample(texts.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull()), key, sample_rows, seed)
    words = sample.select(key, _words(text).alias("_words")).orderBy(key).coalesce(1).select("_words")
    counts = words.select(F.explode_outer("_words").alias("word")).filter(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
    if counts.filter(F.col("n") >= min_count).isEmpty():
        return WordVectors(texts.sparkSession.createDataFrame([], "word string, vector array<double>"), size)
    fitted = Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, numPartitions=1, seed=seed, inputCol="_words",
        outputCol="_vector", maxSentenceLength=1000,
    ).fit(words)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    unit = F.when(norm > 0, F.transform("vector", lambda v: v / norm))
    known = fitted.getVectors().select("word", vector_to_array("vector").alias("vector")).select("word", unit.alias("vector"))
    kept = top_k(counts, "word", "n", max_words).select("word")
    return WordVectors(known.filter(F.col("vector").isNotNull()).join(kept, "word"), size)


def _directions(vectors: WordVectors, aspects: Sequence[str], phrases: Mapping) -> dict[str, np.ndarray]:
    """Unit vectors (about, from bad to good) per aspect, from the few words of its phrases. Unknown words add nothing; without a known
    word on either side the axis is zero."""
    slugs = {a.lower().replace(" ", "_") for a in aspects}
    spoken = {s: [re.findall(WORD, " ".join(p).lower()) for p in phrases[s]] for s in slugs if s in phrases}
    named = {s: s.split("_") for s in slugs}
    wanted = sorted({w for s in slugs for w in named[s] + [w for p in spoken.get(s, []) for w in p]})
    found = {r["word"]: np.array(r["vector"]) for r in vectors.table.filter(F.col("word").isin(wanted)).collect()}

    def unit(v):
        length = np.linalg.norm(v)
        return v / length if length else v

    def mean(words):
        known = [found[w] for w in words if w in found]
        return unit(np.sum(known, axis=0)) if known else np.zeros(vectors.size)

    out = {}
    for s in sorted(slugs):
        good, bad = spoken.get(s, [[], []])
        # Words of both sides tell nothing about the side: they name the thing.
        about = named[s] + sorted(set(good) & set(bad))
        ends = [mean([w for w in side if w not in about]) for side in (good, bad)]
        out[s] = np.stack([mean(about), unit(ends[0] - ends[1]) if all(e.any() for e in ends) else np.zeros(vectors.size)])
    return out


def aspect_scores(
    texts: DataFrame, key: str, text: str, vectors: WordVectors, aspects: Sequence[str] = tuple(lx.ASPECT_CANDIDATES),
    phrases: Mapping = lx.ASPECT_PHRASES, sharpness: float = 10.0, margin: float = 0.05, out: str = "scores",
) -> DataFrame:
    """Adds ``out``: ``map<aspect, array<double>>`` with (positive, negative, neutral), as ``scoring.zero_shot_aspects`` reads it.

    Per aspect the sentence with the word closest to it speaks (ties: the first one). The three numbers are a softmax of the mean
    cosine ``c`` of its words with the axis, of ``-c`` and of ``margin``, times the cosine of the closest word with the aspect (0 when
    negative): an aspect no word comes near stays below any threshold. Texts without known words have an empty map. ``key`` is unique; rows with a null key or text get an empty map too.
    """
    directions = _directions(vectors, aspects, phrases)
    names = list(directions)
    flat = np.concatenate([directions[s] for s in names])  # 2 rows per aspect

    def cosine(row):
        return F.aggregate(
            F.zip_with("vector", F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v
        )

    # One row per word, at most max_words: two numbers per aspect.
    weighed = vectors.table.select("word", *[cosine(row).alias(f"_c{i}") for i, row in enumerate(flat)])
    sentences = texts.filter(F.col(key).isNotNull()).select(key, F.posexplode_outer(F.split(F.col(text), r"[.!?]+")).alias("_s", "_t"))
    words = sentences.select(key, "_s", F.explode_outer(_words("_t")).alias("word")).filter(F.col("word").isNotNull())
    per_sentence = (
        words.join(F.broadcast(weighed), "word").groupBy(key, "_s").agg(
            *[e for i, s in enumerate(names) for e in (
                F.max(f"_c{2 * i}").alias(f"_near{i}"), F.avg(f"_c{2 * i + 1}").alias(f"_side{i}"),
            )]
        )
    )
    speaking = per_sentence.groupBy(key).agg(
        *[F.max(F.struct(F.col(f"_near{i}").alias("near"), (-F.col("_s")).alias("s"), F.col(f"_side{i}").alias("side"))).alias(f"_a{i}")
          for i in range(len(names))]
    )
    entries = []
    for i, s in enumerate(names):
        side, near = F.col(f"_a{i}.side"), F.greatest(F.col(f"_a{i}.near"), F.lit(0.0))
        logits = F.array(side * sharpness, -side * sharpness, F.lit(margin * sharpness))
        shares = vl.softmax(logits)
        entries += [F.lit(_named(s, aspects)), F.zip_with(shares, F.array_repeat(near, 3), lambda p, n: p * n)]
    empty = F.create_map().cast("map<string, array<double>>")
    scored = speaking.select(F.col(key).alias("_key"), F.create_map(*entries).alias("_map"))
    return texts.join(scored, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_map", empty)).drop("_key", "_map")


def _named(slug: str, aspects: Sequence[str]) -> str:
    return next(a for a in aspects if a.lower().replace(" ", "_") == slug)
