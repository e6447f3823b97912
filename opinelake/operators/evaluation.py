"""Classifier evaluation over (id, true_id, pred_id, probabilities) rows.

All count-based metrics come from one nine-counter aggregate; the ranking metrics group by score first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.functions import text as tx
from opinelake.functions import values as vl
from opinelake.operators.projections import top_rows
from opinelake.operators.ranking import running_totals
from opinelake.schema import CLASS_NAMES

N = range(len(CLASS_NAMES))


def predictions(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Probabilities, predicted class and confidence from logits."""
    return (
        df.withColumn("probabilities", vl.softmax(logits))
        .withColumn("pred_id", vl.argmax("probabilities"))
        .withColumn("confidence", F.array_max("probabilities"))
    )


def confusion_counts(df: DataFrame) -> DataFrame:
    """One row with the nine counters ``m<true><pred>``."""
    return df.agg(
        *[F.count_if((F.col("true_id") == t) & (F.col("pred_id") == p)).alias(f"m{t}{p}") for t in N for p in N],
        F.count("*").alias("total"),
    )


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def _m(t: int, p: int) -> Column:
    return F.col(f"m{t}{p}")


def _support(t: int) -> Column:
    return _sum([_m(t, p) for p in N])


def _precision(c: int) -> Column:
    return vl.ratio_or_zero(_m(c, c), _sum([_m(t, c) for t in N]))


def _recall(c: int) -> Column:
    return vl.ratio_or_zero(_m(c, c), _support(c))


def _f1(c: int) -> Column:
    p, r = _precision(c), _recall(c)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _accuracy() -> Column:
    return vl.ratio_or_zero(_sum([_m(c, c) for c in N]), F.col("total"))


METRICS = {"precision": _precision, "recall": _recall, "f1_score": _f1}


def confusion_matrix(df: DataFrame) -> DataFrame:
    """3×3 counts with row percentages."""
    rows = [
        F.struct(
            F.lit(CLASS_NAMES[t]).alias("true_label"),
            *[_m(t, p).alias(f"pred_{CLASS_NAMES[p]}") for p in N],
            *[vl.percentage(_m(t, p), _support(t), 1).alias(f"pct_{CLASS_NAMES[p]}") for p in N],
        )
        for t in N
    ]
    return confusion_counts(df).select(F.inline(F.array(*rows)))


def overall_metrics(df: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    weighted = [
        vl.rounded(vl.ratio_or_zero(_sum([f(c) * _support(c) for c in N]), F.col("total")), 4).alias(name)
        for name, f in METRICS.items()
    ]
    correct = _sum([_m(c, c) for c in N])
    return confusion_counts(df).select(
        vl.rounded(_accuracy(), 4).alias("accuracy"),
        *weighted,
        F.col("total").alias("total_samples"),
        correct.alias("correct_predictions"),
        (F.col("total") - correct).alias("incorrect_predictions"),
    )


def _report_row(name: str, metrics: Sequence[Column], support: Column) -> Column:
    cols = [vl.rounded(m, 4).alias(n) for n, m in zip(METRICS, metrics)]
    return F.struct(F.lit(name).alias("label"), *cols, support.alias("support"))


def per_class_metrics(df: DataFrame) -> DataFrame:
    rows = [_report_row(CLASS_NAMES[c], [f(c) for f in METRICS.values()], _support(c)) for c in N]
    return confusion_counts(df).select(F.inline(F.array(*rows)))


def classification_report(df: DataFrame) -> DataFrame:
    """Per-class rows, accuracy, macro average and weighted average."""
    rows = [_report_row(CLASS_NAMES[c], [f(c) for f in METRICS.values()], _support(c)) for c in N]
    macro = [_sum([f(c) for c in N]) / len(CLASS_NAMES) for f in METRICS.values()]
    weighted = [vl.ratio_or_zero(_sum([f(c) * _support(c) for c in N]), F.col("total")) for f in METRICS.values()]
    total = F.col("total")
    rows += [
        _report_row("accuracy", [_accuracy()] * 3, total),
        _report_row("macro avg", macro, total),
        _report_row("weighted avg", weighted, total),
    ]
    return confusion_counts(df).select(F.inline(F.array(*rows)))


def outcome_counts(df: DataFrame) -> DataFrame:
    right = F.col("true_id") == F.col("pred_id")
    return df.agg(
        F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"), F.count("*").alias("total")
    ).withColumn("misclassification_rate", vl.percentage("incorrect", "total", 2))


def _score_groups(df: DataFrame) -> DataFrame:
    """Positives and negatives per (class, score): ties are one row from here on."""
    long = df.select("true_id", F.posexplode_outer("probabilities").alias("class_id", "score"))
    mine = F.col("true_id") == F.col("class_id")
    return long.filter(F.col("score").isNotNull()).groupBy("class_id", "score").agg(
        F.count_if(mine).alias("pos"), F.count_if(~mine).alias("neg")
    )


def _class_totals(groups: DataFrame) -> DataFrame:
    return groups.groupBy("class_id").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))


def roc_auc(df: DataFrame, slices: int = 256) -> DataFrame:
    """One-vs-rest AUC per class by mid-ranks; 0 when a class has no positives or no negatives."""
    ranked = running_totals(_score_groups(df), ["class_id"], "score", ["neg"], slices)
    # Doubles: the product of two counts can exceed 64 bits.
    below = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2)
    area, pairs = F.sum(below), F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return (
        ranked.groupBy("class_id")
        .agg(vl.rounded(F.when(pairs > 0, area / pairs).otherwise(F.lit(0.0)), 6).alias("roc_auc"))
        .select(vl.label_name("class_id").alias("label"), "roc_auc")
    )


def roc_points(df: DataFrame, slices: int = 256) -> DataFrame:
    """(fpr, tpr) after each distinct threshold, highest first, per class."""
    groups = _score_groups(df)
    ranked = running_totals(groups, ["class_id"], "score", ["pos", "neg"], slices, descending=True)
    # One row per class of a three-class model.
    points = ranked.join(F.broadcast(_class_totals(groups)), "class_id")
    return points.select(
        vl.label_name("class_id").alias("label"),
        F.col("score").alias("threshold"),
        vl.ratio_or_zero("cum_neg", "all_neg").alias("fpr"),
        vl.ratio_or_zero("cum_pos", "all_pos").alias("tpr"),
    )


def misclassified(df: DataFrame, text: str = "text", top_n: int = 20) -> DataFrame:
    """Most confident mistakes with a text preview, and the number of all mistakes."""
    wrong = df.filter(F.col("true_id") != F.col("pred_id"))
    confidence = F.array_max("probabilities")
    named = F.map_from_arrays(
        F.array(*[F.lit(n) for n in CLASS_NAMES]), F.transform("probabilities", lambda p: vl.rounded(p, 4))
    )
    top = top_rows(wrong.withColumn("_c", confidence), [F.desc("_c"), "id"], top_n)
    return top.select(
        "id",
        tx.truncate(text, 200).alias("text"),
        vl.label_name("true_id").alias("true_label"),
        vl.label_name("pred_id").alias("predicted_label"),
        vl.rounded("_c", 4).alias("confidence"),
        named.alias("probabilities"),
        wrong.agg(F.count("*")).scalar().alias("total_misclassified"),
    )
