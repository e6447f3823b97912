"""Rule topics, topic models and class-based TF-IDF keywords."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinelake import lexicons as lx
from opinelake.functions import text as tx
from opinelake.functions import values as vl
from opinelake.operators.ordering import top_k
from opinelake.operators.projections import one_row_each
from opinelake.operators.scoring import with_rule_topics
from opinelake.operators.windows import first_n

OUTLIER = -1
WORD = r"\b(\w\w+)\b"


def rule_topic_report(
    texts: DataFrame, text: str, key: str, topics: Mapping[str, Sequence[str]] = lx.TOPIC_KEYWORDS, top_n: int = 10, docs: int = 3
) -> DataFrame:
    """Documents per rule topic with share, keywords and the first documents.

    A document counts for every topic it matches, so ``outlier_count`` (documents minus matches) can
    be negative; ``unmatched_docs`` is the number of documents without any topic.
    """
    tagged = with_rule_topics(texts.select(key, text), text, topics, "_topics").select(
        key, tx.truncate(text, 200).alias("_doc"), "_topics"
    )
    totals = tagged.agg(
        F.struct(F.count("*").alias("docs"), F.count_if(F.size("_topics") == 0).alias("unmatched"))
    ).scalar()
    hits = one_row_each(tagged, "_topics", "topic", key, "_doc")
    counts = top_k(hits.groupBy("topic").agg(F.count("*").alias("count")), "topic", "count", top_n)
    examples = (
        first_n(hits, "topic", [key], docs)
        .groupBy("topic")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "_doc"))), lambda s: s["_doc"]).alias("representative_docs"))
    )
    matched = counts.agg(F.sum("count")).scalar()
    keywords = F.try_element_at(
        F.create_map(*[c for t, kws in topics.items() for c in (F.lit(t), F.array(*[F.lit(k) for k in kws]))]), F.col("topic")
    )
    return (
        counts.join(examples, "topic")
        .withColumn("_t", totals)
        .select(
            "topic",
            tx.topic_title("topic").alias("name"),
            "count",
            vl.percentage("count", "_t.docs").alias("percentage"),
            keywords.alias("keywords"),
            "representative_docs",
            F.col("_t.docs").alias("total_documents"),
            (F.col("_t.docs") - matched).alias("outlier_count"),
            vl.percentage(F.col("_t.docs") - matched, "_t.docs").alias("outlier_percentage"),
            F.col("_t.unmatched").alias("unmatched_docs"),
        )
    )


def topic_distribution(assigned: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Count and share per topic; outliers are reported next to each row."""
    counts = assigned.groupBy(topic).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    outliers = counts.agg(F.coalesce(F.sum(F.when(F.col(topic) == OUTLIER, F.col("count"))), F.lit(0))).scalar()
    return counts.filter(F.col(topic) != OUTLIER).select(
        topic,
        "count",
        vl.percentage("count", total).alias("percentage"),
        outliers.alias("outlier_count"),
        vl.percentage(outliers, total).alias("outlier_percentage"),
    )


# --- n-grams and keywords --------------------------------------------------------------------

def with_ngrams(df: DataFrame, text: str, stop_words: Sequence[str], out: str = "_terms") -> DataFrame:
    """Adds the words of two or more characters that are no stop words, followed by their bigrams."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 1)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    following = F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1)))
    # The last word has no successor: its pair is null.
    pairs = F.zip_with("_w", "_next", lambda a, b: F.concat(a, F.lit(" "), b))
    return (
        df.withColumn("_w", words)
        .withColumn("_next", following)
        .withColumn(out, F.concat("_w", F.array_compact(pairs)))
        .drop("_w", "_next")
    )


def ngram_vocabulary(
    texts: DataFrame, text: str, stop_words: Sequence[str], min_df: int = 5, max_df: float = 0.8
) -> DataFrame:
    """Unigrams and bigrams by document frequency, bounds inclusive."""
    total = texts.agg(F.count("*")).scalar()
    terms = one_row_each(with_ngrams(texts.select(text), text, stop_words), F.array_distinct("_terms"), "term")
    counts = terms.groupBy("term").agg(F.count("*").alias("doc_freq"))
    return counts.filter((F.col("doc_freq") >= min_df) & (F.col("doc_freq") <= total * max_df))


def class_tf_idf(
    texts: DataFrame, text: str, topic: str, stop_words: Sequence[str], min_df: int = 5, max_df: float = 0.8
) -> DataFrame:
    """Keyword weight per topic: ``tf(t, c) * log(1 + A / f(t))``, A the mean number of terms per topic.

    One pass over the texts counts occurrences and documents per (topic, term), with map-side partial
    sums. Everything else is formed from these counts; the window per term holds one row per topic.
    """
    total_docs = texts.agg(F.count("*")).scalar()
    lists = with_ngrams(texts.select(topic, text), text, stop_words).select(
        topic, F.posexplode_outer(F.array("_terms", F.array_distinct("_terms"))).alias("_kind", "_list")
    )
    counted = (
        one_row_each(lists, "_list", "term", topic, "_kind")
        .groupBy(topic, "term")
        .agg(F.count_if(F.col("_kind") == 0).alias("tf"), F.count_if(F.col("_kind") == 1).alias("_docs"))
    )
    term = Window.partitionBy("term")
    kept = (
        counted.withColumns({"_df": F.sum("_docs").over(term), "_f": F.sum("tf").over(term)})
        .filter((F.col("_df") >= min_df) & (F.col("_df") <= total_docs * max_df))
    )
    mean_terms = kept.groupBy(topic).agg(F.sum("tf").alias("n")).agg(F.avg("n")).scalar()
    return kept.select(topic, "term", "tf", (F.col("tf") * F.log(1 + mean_terms / F.col("_f"))).alias("weight"))


def topic_keywords(weights: DataFrame, topic: str, n: int = 10, topic_id=None) -> DataFrame:
    """Strongest ``n`` keywords per topic, or of one topic."""
    if topic_id is not None:
        weights = weights.filter(F.col(topic) == topic_id)
    # Compared and reported at 4 digits, ties by term.
    scored = weights.withColumn("score", vl.rounded("weight", 4))
    return first_n(scored, topic, [F.desc("score"), "term"], n, "position").select(topic, "position", "term", "score")


# --- fitted topic model ------------------------------------------------------------------------

def fit_topics(texts: DataFrame, text: str, k: int = 10, features: int = 1 << 12, seed: int = 42) -> PipelineModel:
    """Hashed TF-IDF vectors on the unit sphere, clustered by k-means."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+", minTokenLength=2),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_vector"),
            KMeans(featuresCol="_vector", predictionCol="_cluster", k=k, seed=seed),
        ]
    ).fit(texts)


def fit_text_vectors(texts: DataFrame, text: str, features: int = 1 << 8) -> PipelineModel:
    """Hashed TF-IDF vectors on the unit sphere, short enough to be compared as dense arrays."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+", minTokenLength=2),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_vector"),
        ]
    ).fit(texts)


def text_vectors(df: DataFrame, model: PipelineModel, out: str = "vector") -> DataFrame:
    """Adds the array of ``fit_text_vectors``; null for texts without a known word, which have no direction."""
    array = vector_to_array("_vector")
    return model.transform(df).select(*df.columns, F.when(F.exists(array, lambda v: v != 0), array).alias(out))


def fit_vector_topics(vectors: DataFrame, vector: str, k: int = 10, seed: int = 42) -> PipelineModel:
    """Topic model over given embeddings (``pyspark.ml`` vectors)."""
    return Pipeline(stages=[KMeans(featuresCol=vector, predictionCol="_cluster", k=k, seed=seed)]).fit(vectors)


def assign_topics(df: DataFrame, model: PipelineModel | None, min_topic_size: int = 1) -> DataFrame:
    """Adds ``topic_id``: 0 is the largest topic. Without a model, and in topics smaller than
    ``min_topic_size``, it is -1. The topic numbers are one row per cluster, at most k."""
    if model is None:
        return df.withColumn("topic_id", F.lit(OUTLIER))
    placed = model.transform(df).select(*df.columns, "_cluster")
    sizes = placed.groupBy("_cluster").agg(F.count("*").alias("_n"))
    by_size = Window.partitionBy(F.lit(0)).orderBy(F.desc("_n"), "_cluster")
    numbers = sizes.filter(F.col("_n") >= min_topic_size).select(
        "_cluster", (F.row_number().over(by_size) - 1).alias("_topic")
    )
    return (
        placed.join(F.broadcast(numbers), "_cluster", "left")
        .withColumn("topic_id", F.coalesce("_topic", F.lit(OUTLIER)))
        .drop("_cluster", "_topic")
    )


def topic_report(
    assigned: DataFrame, text: str, key: str, stop_words: Sequence[str], top_topics: int = 10, words: int = 10, docs: int = 3,
    min_df: int = 5, max_df: float = 0.8,
) -> DataFrame:
    """Largest topics with size, share, name, keywords and representative documents."""
    sizes = topic_distribution(assigned)
    known = assigned.filter(F.col("topic_id") != OUTLIER)
    keywords = topic_keywords(class_tf_idf(known, text, "topic_id", stop_words, min_df, max_df), "topic_id", words)
    named = keywords.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("position", "term", "score"))).alias("_k"))
    examples = (
        first_n(known.select("topic_id", key, tx.truncate(text, 200).alias("_doc")), "topic_id", [key], docs)
        .groupBy("topic_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "_doc"))), lambda s: s["_doc"]).alias("representative_docs"))
    )
    terms = F.transform("_k", lambda s: s["term"])
    return (
        top_k(sizes, "topic_id", "count", top_topics)
        .join(named, "topic_id", "left")
        .join(examples, "topic_id", "left")
        .select(
            "topic_id", "count", "percentage", "outlier_count", "outlier_percentage",
            F.concat_ws("_", F.col("topic_id").cast("string"), F.slice(terms, 1, 4)).alias("name"),
            terms.alias("keywords"),
            F.transform("_k", lambda s: s["score"]).alias("keyword_scores"),
            "representative_docs",
        )
    )
