"""A training corpus from raw documents: five stages, each one of the operators of ``opinelake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. A stage works on all rows that the stage before kept, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinelake.llm import decontaminate, near_dedup, packing, quality, secrets
from opinelake.llm.common import stored, table
from opinelake.llm.queries import quality_model, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _digest_key() -> Column:
    """A key for a row that its doc_id does not name, above usual ids: 62 bits of a digest of id and text."""
    return F.shiftrightunsigned(F.xxhash64("_named", "text"), 2).bitwiseOR(F.lit(1 << 62))


def _row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each different row in doc_id, the doc_id in _named, and _shared where the key may repeat.

    The key is the doc_id, or a digest for a row without one and for all but one of the texts of a doc_id.
    """
    digest = F.xxhash64("text")
    texts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n"), F.min(digest).alias("_first"))
    again = stored(texts.filter("_n > 1").select(F.col("doc_id").alias("_named"), "_first"), "repeated-ids")
    own = F.col("_named").isNotNull() & (F.col("_first").isNull() | (F.col("_first") == digest))
    return (
        docs.withColumn("_named", F.col("doc_id")).join(again, "_named", "left")
        .withColumn("_shared", F.col("_named").isNull() | F.col("_first").isNotNull())
        .withColumn("doc_id", F.when(own, F.col("_named").cast("long")).otherwise(_digest_key()))
    )


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut; the others go."""
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), "_score")
    return scored.filter(F.col("_score") >= quality.CUT).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 or more on five-word shingles): that with the smallest doc_id.

    Rows without a doc_id and repeated rows of a doc_id are documents like others, after those that a doc_id names. Rows without
    words stay.
    """
    rows = _row_keys(docs)
    gone = near_dedup.near_duplicates(rows, 80, 100).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept = rows.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    copies = F.col("_shared") & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    out = kept.filter(~copies).unionByName(kept.filter(copies).dropDuplicates(["doc_id"]))
    return out.withColumn("doc_id", F.col("_named")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no stretch with a benchmark item; each row is judged by its own text, whatever its doc_id."""
    clean = decontaminate.without_leaks(_row_keys(docs), table(spark, sf_dir, "benchmark"))
    return clean.withColumn("doc_id", F.col("_named")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs, tokenizer_path(), 1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", packed),
]

#: Language model scores, sketches and token ids have no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
