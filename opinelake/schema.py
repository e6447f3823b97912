"""Table schemas, label values and defaults of the relational model."""

from __future__ import annotations

from pyspark.sql import types as T

# Label names, ids of the three-class and the two-class models.
SENTIMENT_LABELS = ["positive", "negative", "neutral"]
CLASS_NAMES = ["negative", "neutral", "positive"]
LABEL_TO_ID = {"negative": 0, "neutral": 1, "positive": 2}
SERVING_LABEL_TO_ID = {"negative": 0, "positive": 1}
POLARITY_CODES = {0: "negative", 2: "neutral", 4: "positive"}

ASPECT_TYPE = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("score", T.IntegerType()),
            T.StructField("sentiment", T.StringType()),
            T.StructField("keywords", T.ArrayType(T.StringType())),
        ]
    ),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

PRODUCTS = _struct(
    product_id=_S, asin=_S, product_name=_S, brand=_S, category=_S,
    price=T.DecimalType(10, 2), is_competitor=_B, created_at=_TS, updated_at=_TS,
)

REVIEWS = _struct(
    review_id=_L, product_id=_S, reviewer_name=_S, reviewer_id=_S, review_text=_S, cleaned_text=_S,
    summary=_S, raw_rating=T.ShortType(), review_date=_TS, verified_purchase=_B, helpful_votes=_I,
    total_votes=_I, source=_S, ingested_at=_TS,
)

SENTIMENT_RESULTS = _struct(
    result_id=_L, review_id=_L, predicted_sentiment=_S, positive_score=_D, negative_score=_D,
    neutral_score=_D, confidence_score=_D, emotion=_S, aspects=ASPECT_TYPE,
    aspect_scores=T.MapType(_S, _D), model_version=_S, model_name=_S, inference_time_ms=_I, analyzed_at=_TS,
)

MODEL_VERSIONS = _struct(
    version_id=_I, model_name=_S, version=_S, accuracy=_D, f1_score=_D, precision=_D, recall=_D,
    training_date=_TS, parameters=T.MapType(_S, _S), notes=_S, created_at=_TS,
)

REVIEW_CSV = _struct(
    Id=_L, ProductId=_S, UserId=_S, ProfileName=_S, HelpfulnessNumerator=_I, HelpfulnessDenominator=_I,
    Score=_I, Time=_L, Summary=_S, Text=_S,
)

TWEET_CSV = _struct(sentiment=_I, id=_L, date=_S, query=_S, user=_S, text=_S)

MERGED_COLUMNS = ["cleaned_text", "sentiment_label", "review_length", "source", "review_date"]
TABLES = {
    "products": PRODUCTS,
    "reviews": REVIEWS,
    "sentiment_results": SENTIMENT_RESULTS,
    "model_versions": MODEL_VERSIONS,
}
