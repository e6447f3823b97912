"""Token encoding, classifier training and the model registry."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from opinelake.functions import text as tx
from opinelake.operators.ordering import top_k
from opinelake.operators.words import word_counts
from opinelake.schema import LABEL_TO_ID

# Fixed values of the encoding: length, vocabulary size and reserved ids.
MAX_LENGTH = 256
VOCABULARY_SIZE = 30522
PAD, UNKNOWN, START, END = 0, 1, 2, 3
RESERVED = 4


def vocabulary(texts: DataFrame, text: str, size: int = VOCABULARY_SIZE) -> list[str]:
    """Most frequent words, ties by word. The list has at most ``size`` entries, so it may be collected."""
    top = top_k(word_counts(texts, text, 0), "word", "frequency", size - RESERVED)
    return [row["word"] for row in top.collect()]


def encode(df: DataFrame, text: str, words: list[str], max_length: int = MAX_LENGTH) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask``: start, word ids, end, padding to ``max_length``.

    Tokens are cut on the JVM; the id lookup is one hash lookup per Arrow batch. A join with the
    vocabulary would have to shuffle every token and gather it again.
    """
    vocabulary_array = pa.array(words, pa.string())
    room = max_length - 2

    @pandas_udf("array<int>")
    def ids(tokens: pd.Series) -> pd.Series:
        lengths = tokens.str.len().to_numpy()
        out = np.full((len(tokens), max_length), PAD, dtype=np.int32)
        out[:, 0] = START
        flat = pa.array(np.concatenate(tokens.to_list()) if lengths.sum() else [], pa.string())
        found = pc.index_in(flat, value_set=vocabulary_array).fill_null(UNKNOWN - RESERVED).to_numpy() + RESERVED
        rows = np.repeat(np.arange(len(tokens)), lengths)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, np.arange(len(found)) - starts + 1] = found
        out[np.arange(len(tokens)), lengths + 1] = END
        return pd.Series(list(out))

    tokens = F.slice(tx.tokens(F.coalesce(F.col(text), F.lit(""))), 1, room)
    used = F.size("_tokens") + 2
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used))
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("input_ids", ids("_tokens"))
        .withColumn("attention_mask", mask)
        .drop("_tokens")
    )


@dataclass(frozen=True)
class TrainConfig:
    """Settings of the text classifier."""

    text: str = "cleaned_text"
    label: str = "label"
    features: int = 1 << 18
    reg_params: tuple[float, ...] = (0.01,)
    max_iter: int = 50
    folds: int = 3
    seed: int = 42
    label_to_id: dict = field(default_factory=lambda: dict(LABEL_TO_ID))


def train_classifier(df: DataFrame, config: TrainConfig = TrainConfig()) -> PipelineModel:
    """Hashed TF-IDF with multinomial logistic regression, fitted on the executors.

    With several ``reg_params`` the best one by F1 is chosen by cross-validation.
    """
    lr = LogisticRegression(labelCol=config.label, featuresCol="features", maxIter=config.max_iter, regParam=config.reg_params[0])
    pipeline = Pipeline(
        stages=[
            RegexTokenizer(inputCol=config.text, outputCol="words", pattern=r"\s+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=config.features),
            IDF(inputCol="tf", outputCol="features"),
            lr,
        ]
    )
    if len(config.reg_params) == 1:
        return pipeline.fit(df)
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(config.reg_params)).build(),
        evaluator=MulticlassClassificationEvaluator(labelCol=config.label, metricName="f1"),
        numFolds=config.folds,
        seed=config.seed,
    )
    return search.fit(df).bestModel


def register_model(
    versions: DataFrame, name: str, version: str, metrics: DataFrame, config: TrainConfig, trained_at: Column, notes: str = ""
) -> DataFrame:
    """The row to append to the registry; empty when (name, version) is registered already.

    ``metrics`` is the one-row frame of ``overall_metrics``.
    """
    parameters = [F.lit(v) for k, value in asdict(config).items() for v in (k, str(value))]
    known = versions.filter((F.col("model_name") == name) & (F.col("version") == version))
    row = metrics.select(
        (F.coalesce(versions.agg(F.max("version_id")).scalar(), F.lit(0)) + 1).cast("int").alias("version_id"),
        F.lit(name).alias("model_name"),
        F.lit(version).alias("version"),
        "accuracy",
        "f1_score",
        "precision",
        "recall",
        trained_at.alias("training_date"),
        F.create_map(*parameters).alias("parameters"),
        F.lit(notes).alias("notes"),
        trained_at.alias("created_at"),
    )
    return row.join(known, ["model_name", "version"], "left_anti").select(*versions.columns)
