"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is bound as the product of its letters' vectors, each permuted
(rotated) by its place; the n-grams of a text are bundled by addition. A language's prototype is the bundle of its training
texts, and a text gets the language whose prototype has the largest cosine with its own vector.

The vector of a text is its n-gram counts times the n-gram vectors, so texts are counted first and each distinct n-gram is added
once. Letters outside the ``LETTERS`` table share places of the alphabet by code point, so every script takes part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, N, SYMBOLS = 512, 3, 40  # dimensions, letters of an n-gram, letter vectors (0 is the word edge)
SAMPLE = 400
_LIMIT = 0x110000  # all code points


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Letter vector of each code point: 0 for what is not a letter. Lower-case forms share a vector with upper-case ones."""
    out = np.zeros(_LIMIT, np.uint8)
    for c in range(_LIMIT):
        if (ch := chr(c)).isalpha():
            low = ord(ch.lower()[0])
            out[c] = 1 + (low - 97 if 97 <= low <= 122 else 26 + low % (SYMBOLS - 27))
    return out


@lru_cache(maxsize=1)
def _grams(seed: int = 11) -> np.ndarray:
    """Bound vectors of all n-grams (SYMBOLS ** N, SIZE)."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, SIZE))
    out = letters
    for _ in range(N - 1):
        out = (np.roll(out, 1, axis=1)[:, None, :] * letters[None, :, :]).reshape(-1, SIZE)
    return out.astype(np.float32)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and how often each occurs; runs of other characters are one word edge."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _codes()[np.minimum(points, _LIMIT - 1)]
    x = np.concatenate(([0], x[(x > 0) | (np.concatenate(([0], x[:-1])) > 0)], [0])) if len(x) else x
    if not x.any():
        return np.zeros(0, np.int64), np.zeros(0)
    gram = np.zeros(len(x) - N + 1, np.int64)
    for k in range(N):
        gram = gram * SYMBOLS + x[k : len(x) - N + 1 + k]
    found = np.bincount(gram)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(text: str | None) -> np.ndarray:
    """The bundle of a text; zero if it has no letter."""
    at, n = counts(text)
    if not len(at):
        return np.zeros(SIZE, np.float32)
    return n.astype(np.float32) @ _grams()[at]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    prototypes: list[str] = field(default_factory=list)  # base64 of float32

    def matrix(self) -> np.ndarray:
        rows = [np.frombuffer(base64.b64decode(p), np.float32) for p in self.prototypes]
        return np.array(rows, np.float32).reshape(-1, SIZE)


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            v = vector(text)
            if (norm := np.linalg.norm(v)) > 0:
                total[lang] = total.get(lang, np.zeros(SIZE)) + v / norm
    if total:
        yield pd.DataFrame({"lang": list(total), "v": [v.tolist() for v in total.values()]})


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Prototypes of the languages in ``docs`` (doc_id, text, lang): each the bundle of about ``sample`` of its texts.

    Texts are picked by the hash of their id, so every run takes the same ones; a language with fewer texts gives them all.
    Rows whose lang or text is null teach nothing. Partial bundles are added in the tasks; one vector per task and
    language reaches the driver.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))]) if sizes else None
    if rates is None:
        return Model()
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000)
    parts = picked.select("lang", "text").mapInPandas(_bundled, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v")).collect()
    rows = sorted((r["lang"], np.array(r["v"], np.float64)) for r in rows)
    unit = [base64.b64encode((v / (np.linalg.norm(v) or 1)).astype(np.float32).tobytes()).decode() for _, v in rows]
    return Model([lang for lang, _ in rows], unit)


def detect(docs: DataFrame, model: Model, unknown: str = "und") -> DataFrame:
    """``docs`` with lang_pred and score (cosine brought to 0..1) for each whole text; no row is dropped or moved.

    Null texts, texts without a letter and texts that meet a model without languages are ``unknown`` with score 0. Ties go to
    the language that sorts first.
    """
    languages = list(model.languages)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        prototypes = model.matrix()
        for batch in batches:
            names, scores = [], []
            for text in batch:
                v = vector(text)
                norm = np.linalg.norm(v)
                if norm == 0 or not languages:
                    names.append(unknown)
                    scores.append(0.0)
                    continue
                cosine = prototypes @ v / norm
                best = int(np.argmax(cosine))
                names.append(languages[best])
                scores.append(float(np.clip((1 + cosine[best]) / 2, 0, 1)))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    out = docs.withColumn("guess", guess(F.col("text").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], "guess.lang_pred", "guess.score")
