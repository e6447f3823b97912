"""Sentiment, aspect and topic scoring of texts.

Rule scorers are column expressions that run inside the scan. Model scoring takes an injected
predictor that is loaded once per task and called on Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinelake import lexicons as lx
from opinelake.functions import text as tx
from opinelake.functions import values as vl

Predictor = Callable[[list[str]], Sequence[Sequence[float]]]

SCORE_FIELDS = ["label", "positive_score", "negative_score", "neutral_score", "confidence_score"]


def _scores(label, positive, negative, neutral, confidence) -> Column:
    return F.struct(
        label.alias("label"),
        positive.alias("positive_score"),
        negative.alias("negative_score"),
        neutral.alias("neutral_score"),
        confidence.alias("confidence_score"),
    )


def _constant(label: str, *scores: float) -> Column:
    return _scores(F.lit(label), *[F.lit(float(s)) for s in scores])


def _from_counts(pos: Column, neg: Column) -> Column:
    ratio = pos / (pos + neg)
    label = F.when(ratio > 0.6, "positive").when(ratio < 0.4, "negative").otherwise("neutral")
    scored = _scores(
        label,
        vl.rounded(ratio, 4),
        vl.rounded(1 - ratio, 4),
        F.lit(0.0),
        vl.rounded(F.abs(ratio - 0.5) * 2, 4),
    )
    return F.when(pos + neg > 0, scored).otherwise(_constant("neutral", 0.33, 0.33, 0.34, 0.5))


def two_class_sentiment(probabilities: Column | str, text: Column | str | None = None) -> Column:
    """Decision rule for (negative, positive) probabilities; near ties and blank texts are neutral."""
    p = tx.as_col(probabilities)
    neg, pos = p[0], p[1]
    diff = F.abs(pos - neg)
    label = F.when(diff < 0.15, "neutral").when(pos > neg, "positive").otherwise("negative")
    confidence = F.when(diff < 0.15, 1.0 - diff).otherwise(F.greatest(pos, neg))
    scored = _scores(
        label,
        vl.rounded(pos, 4),
        vl.rounded(neg, 4),
        vl.rounded(F.greatest(F.lit(0.0), 1.0 - diff), 4),
        vl.rounded(confidence, 4),
    )
    return scored if text is None else F.when(tx.is_blank(text), blank_sentiment()).otherwise(scored)


def blank_sentiment() -> Column:
    return _constant("neutral", 0, 0, 1, 1)


def score_lexicon(
    df: DataFrame,
    text: str,
    positive: Sequence[str] = tuple(lx.POSITIVE_WORDS),
    negative: Sequence[str] = tuple(lx.NEGATIVE_WORDS),
) -> DataFrame:
    """Label and scores from counts of whitespace tokens; punctuation stays on the tokens.

    Token list and hit counts are columns of their own, so that each is computed once per row
    although the score formulas use them several times.
    """
    return _expand(_with_hits(df, text, positive, negative), _from_counts(F.col("_pos"), F.col("_neg"))).drop("_pos", "_neg")


def _with_hits(df: DataFrame, text: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    return (
        df.withColumn("_words", tx.tokens(text))
        .withColumns(
            {
                "_pos": F.size(F.filter("_words", lambda w: w.isin(*positive))),
                "_neg": F.size(F.filter("_words", lambda w: w.isin(*negative))),
            }
        )
        .drop("_words")
    )


def _expand(df: DataFrame, scores: Column) -> DataFrame:
    return df.withColumn("_s", scores).select("*", "_s.*").drop("_s")


def score_model(
    df: DataFrame, text: str, load_predictor: Callable[[], Predictor], batch_size: int = 32, **lexicon: Sequence[str]
) -> DataFrame:
    """Adds two-class model scores; rows the model fails on get the lexicon scores (``model_loaded`` false).

    ``load_predictor`` runs once per task and returns a function from a list of texts to
    (negative, positive) probabilities. A failing batch is retried text by text.
    """
    extra = [T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("inference_time_ms", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_predictor()
        for pdf in batches:
            probabilities: list = [None] * len(pdf)
            millis = [0.0] * len(pdf)
            todo = [i for i, t in enumerate(pdf[text]) if isinstance(t, str) and t.strip()]
            for start in range(0, len(todo), batch_size):
                part = todo[start : start + batch_size]
                texts = [pdf[text].iat[i] for i in part]
                began = time.perf_counter()
                for i, p in zip(part, _predict_or_none(predict, texts)):
                    probabilities[i] = p
                spent = (time.perf_counter() - began) * 1000 / len(part)
                for i in part:
                    millis[i] = spent
            yield pdf.assign(probabilities=probabilities, inference_time_ms=millis)

    words = {"positive": lx.POSITIVE_WORDS, "negative": lx.NEGATIVE_WORDS, **lexicon}
    failed = F.col("probabilities").isNull() & ~tx.is_blank(text)
    predicted = df.mapInPandas(run, schema).withColumn("model_loaded", ~failed)
    # Only failed rows pay for tokenising.
    counted = _with_hits(predicted.withColumn("_t", F.when(~F.col("model_loaded"), F.col(text))), "_t", **words)
    fallback = _from_counts(F.col("_pos"), F.col("_neg"))
    model = two_class_sentiment("probabilities", text)
    return _expand(counted, F.when(F.col("model_loaded"), model).otherwise(fallback)).drop("_t", "_pos", "_neg")


def _predict_or_none(predict: Predictor, texts: list[str]) -> list:
    try:
        return [[float(v) for v in p] for p in predict(texts)]
    except Exception:
        if len(texts) == 1:
            return [None]
        return [row for t in texts for row in _predict_or_none(predict, [t])]


def score_pipeline(df: DataFrame, text: str, model: Transformer, probability: str = "probability") -> DataFrame:
    """Scores with a fitted ``pyspark.ml`` pipeline of two classes (no Python per row)."""
    scored = model.transform(df).withColumn("probabilities", vector_to_array(probability))
    return _expand(scored.select(*df.columns, "probabilities"), two_class_sentiment("probabilities", text))


def score_probabilities(df: DataFrame, text: str, probabilities: str = "probabilities") -> DataFrame:
    """Scores from a column of two-class probabilities, which is dropped."""
    return _expand(df, two_class_sentiment(probabilities, text)).drop(probabilities)


# --- phrase-based aspects (flat shape) --------------------------------------------------

Phrases = Mapping[str, tuple[Sequence[str], Sequence[str]]]


def with_phrase_aspects(
    df: DataFrame, text: str, phrases: Phrases = lx.ASPECT_PHRASES, candidates: Sequence[str] = tuple(lx.ASPECT_CANDIDATES), out: str = "aspects"
) -> DataFrame:
    """Adds flat ``{aspect: sentiment}``; with no hit at all the first three candidates are neutral."""
    low, counts, labels = F.col("_low"), {}, {}
    for aspect, (positive, negative) in phrases.items():
        counts[f"_p_{aspect}"] = tx.containment_count(low, positive)
        counts[f"_n_{aspect}"] = tx.containment_count(low, negative)
        pos, neg = F.col(f"_p_{aspect}"), F.col(f"_n_{aspect}")
        labels[f"_l_{aspect}"] = F.when(pos > neg, "positive").when(neg > pos, "negative").when(pos > 0, "neutral")
    entries = [F.when(F.col(f"_l_{a}").isNotNull(), F.struct(F.lit(a).alias("key"), F.col(f"_l_{a}").alias("value"))) for a in phrases]
    slugs = [c.lower().replace(" ", "_") for c in candidates[:3]]
    fallback = F.create_map(*[F.lit(v) for slug in slugs for v in (slug, "neutral")])
    return (
        df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumns(counts)
        .withColumns(labels)
        .withColumn("_found", F.map_from_entries(F.array_compact(F.array(*entries))))
        .withColumn(out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(fallback))
        .drop("_low", "_found", *counts, *labels)
    )


def score_phrase_aspects(
    df: DataFrame, text: str, candidates: Sequence[str] = tuple(lx.ASPECT_CANDIDATES), phrases: Phrases = lx.ASPECT_PHRASES
) -> DataFrame:
    return (
        with_phrase_aspects(df, text, phrases, candidates)
        .withColumn("aspect_scores", F.transform_values("aspects", lambda k, v: F.lit(0.5)))
        .withColumn("num_aspects_detected", F.size("aspects"))
        .withColumn("total_aspects", F.lit(len(candidates)))
    )


def zero_shot_aspects(
    df: DataFrame,
    text: str,
    scores: str,
    aspects: Sequence[str] = tuple(lx.ASPECT_CANDIDATES),
    threshold: float = 0.3,
    phrases: Phrases = lx.ASPECT_PHRASES,
) -> DataFrame:
    """Thresholded aspects from an injected scorer, with the phrase rule as fallback.

    ``scores`` is ``map<aspect, array<double>>`` with (positive, negative, neutral) per candidate.
    """
    labels = F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral"))
    entries = []
    for aspect in aspects:
        vector = F.try_element_at(F.col(scores), F.lit(aspect))
        best = F.array_max(vector)
        label = F.element_at(labels, vl.argmax(vector) + 1)
        slug = aspect.lower().replace(" ", "_")
        entries.append(F.when(best >= threshold, F.struct(F.lit(slug), F.struct(label.alias("l"), vl.rounded(best, 4).alias("s")))))
    found = F.map_from_entries(F.array_compact(F.array(*entries)))
    labels_only = F.transform_values("_shot", lambda k, v: v["l"])
    return (
        with_phrase_aspects(df, text, phrases, aspects, "_rule")
        .withColumn("_shot", found)
        .withColumn("aspects", F.when(F.size("_shot") > 0, labels_only).otherwise(F.col("_rule")))
        .withColumn("aspect_scores", F.transform_values("_shot", lambda k, v: v["s"]))
        .withColumn("num_aspects_detected", F.size("_shot"))
        .withColumn("total_aspects", F.lit(len(aspects)))
        .drop("_shot", "_rule")
    )


def aggregate_aspects(scored: DataFrame, candidates: Sequence[str] = tuple(lx.ASPECT_CANDIDATES)) -> DataFrame:
    """Label shares, mentions and coverage per aspect over flat aspect maps; unseen aspects are left out."""
    total = scored.agg(F.count("*")).scalar()
    slugs = [c.lower().replace(" ", "_") for c in candidates]
    label = F.col("sentiment")
    return (
        scored.select(F.explode_outer("aspects").alias("aspect", "sentiment"))
        .filter(F.col("aspect").isin(*slugs))
        .groupBy("aspect")
        .agg(
            *[vl.percentage(F.count_if(label == s), F.count("*"), 1).alias(f"{s}_pct") for s in ("positive", "negative", "neutral")],
            F.count("*").alias("total_mentions"),
        )
        .withColumn("coverage", vl.percentage("total_mentions", total, 1))
        .withColumn("total_reviews", total)
    )


# --- taxonomy aspects (nested shape) -----------------------------------------------------

def with_taxonomy_aspects(
    df: DataFrame,
    text: str,
    taxonomy: Mapping[str, Sequence[str]] = lx.ASPECT_TAXONOMY,
    positive: Sequence[str] = tuple(lx.OPINION_WORDS_POSITIVE),
    negative: Sequence[str] = tuple(lx.OPINION_WORDS_NEGATIVE),
    out: str = "aspects",
) -> DataFrame:
    """Adds nested ``{aspect: {score, sentiment, keywords}}``.

    Opinion words count only inside sentences that hold a keyword of the aspect. Each
    intermediate value is a column of its own and is computed once per row.
    """
    low = F.col("_low")
    matched = {f"_m_{a}": tx.contained_phrases(low, kws) for a, kws in taxonomy.items()}
    near, counts = {}, {}
    for a, kws in taxonomy.items():
        near[f"_t_{a}"] = F.array_join(F.filter("_parts", _holds(kws)), " ")
        counts[f"_p_{a}"] = tx.containment_count(F.col(f"_t_{a}"), positive)
        counts[f"_n_{a}"] = tx.containment_count(F.col(f"_t_{a}"), negative)
    entries = []
    for a in taxonomy:
        hit, pos, neg = F.col(f"_m_{a}"), F.col(f"_p_{a}"), F.col(f"_n_{a}")
        label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
        value = F.struct(F.size(hit).alias("score"), label.alias("sentiment"), hit.alias("keywords"))
        entries.append(F.when(F.size(hit) > 0, F.struct(F.lit(a).alias("key"), value.alias("value"))))
    return (
        df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumns({"_parts": tx.sentences(low), **matched})
        .withColumns(near)
        .withColumns(counts)
        .withColumn(out, F.map_from_entries(F.array_compact(F.array(*entries))))
        .drop("_low", "_parts", *matched, *near, *counts)
    )


def _holds(keywords: Sequence[str]) -> Callable[[Column], Column]:
    return lambda sentence: tx.contains_any(sentence, keywords)


def analyse_texts(df: DataFrame, text: str, taxonomy=lx.ASPECT_TAXONOMY, opinions=None, **lexicon: Sequence[str]) -> DataFrame:
    """Lexicon sentiment and taxonomy aspects in one record; blank texts are neutral with no aspects."""
    words = {"positive": lx.POSITIVE_WORDS, "negative": lx.NEGATIVE_WORDS, **lexicon}
    scored = with_taxonomy_aspects(_with_hits(df, text, **words), text, taxonomy, **(opinions or {}))
    scores = F.when(tx.is_blank(text), blank_sentiment()).otherwise(_from_counts(F.col("_pos"), F.col("_neg")))
    return _expand(scored, scores).drop("_pos", "_neg")


# --- rule topics ---------------------------------------------------------------------------

def with_rule_topics(
    df: DataFrame, text: str, topics: Mapping[str, Sequence[str]] = lx.TOPIC_KEYWORDS, out: str = "topics"
) -> DataFrame:
    """Adds all topics with at least one keyword in the text."""
    found = [F.when(tx.contains_any(F.col("_low"), kws), F.lit(t)) for t, kws in topics.items()]
    return df.withColumn("_low", F.lower(F.col(text))).withColumn(out, F.array_compact(F.array(*found))).drop("_low")
