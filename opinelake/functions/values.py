"""Label, date, number, vector and aspect-map expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinelake.functions.text import as_col
from opinelake.schema import LABEL_TO_ID, POLARITY_CODES

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
TWEET_DATE = "MMM dd HH:mm:ss zzz yyyy"


# --- labels ---------------------------------------------------------------------------

def rating_label(rating: Column | str) -> Column:
    r = as_col(rating)
    return F.when(r >= 4, "positive").when(r <= 2, "negative").when(r.isNotNull(), "neutral")


def lookup(mapping: dict, key: Column, key_type: str) -> Column:
    """Value of a literal map, null when the key is missing."""
    pairs = [F.lit(v) for v in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*pairs), key.cast(key_type))


def polarity_label(code: Column | str) -> Column:
    return lookup(POLARITY_CODES, as_col(code), "int")


def label_id(label: Column | str) -> Column:
    return lookup(LABEL_TO_ID, as_col(label), "string")


def label_name(class_id: Column | str) -> Column:
    return lookup({v: k for k, v in LABEL_TO_ID.items()}, as_col(class_id), "int")


# --- dates ----------------------------------------------------------------------------

def as_of_literal(as_of: str | datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def since(as_of: str | datetime | Column, days: int = 0, hours: int = 0) -> Column:
    """Start of a look-back window that ends at ``as_of``."""
    return as_of_literal(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))


def epoch_timestamp(seconds: Column | str, default: Column | None = None) -> Column:
    ts = F.timestamp_seconds(as_col(seconds))
    return ts if default is None else F.coalesce(ts, default)


def lenient_tweet_date(c: Column | str) -> Column:
    """``Mon Apr 06 22:19:45 PDT 2009`` to timestamp, null when it does not parse."""
    without_weekday = F.regexp_replace(as_col(c), r"^[A-Za-z]{3} ", "")
    return F.try_to_timestamp(without_weekday, F.lit(TWEET_DATE))


def iso_text(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), ISO_FORMAT)


def day_key(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd")


def week_key(ts: Column | str) -> Column:
    """ISO week with the ISO year, e.g. 2020-W53 for 2021-01-01."""
    t = as_col(ts)
    year = F.extract(F.lit("YEAROFWEEK"), t).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def month_key(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM")


def period_key(ts: Column | str, interval: str) -> Column:
    """Day and week keys; any other interval value means month."""
    return {"day": day_key, "week": week_key}.get(interval, month_key)(ts)


# --- numbers --------------------------------------------------------------------------

def rounded(c: Column | str, digits: int) -> Column:
    """Half-up rounding through DECIMAL, so that the order in which a sum of doubles was
    added up (12th digit and beyond) cannot change the reported number."""
    return F.round(as_col(c).cast("decimal(28,12)"), digits).cast("double")


def percentage(part: Column | str, total: Column | str, digits: int | None = 2) -> Column:
    """``part / total * 100``, 0 when the total is 0."""
    value = F.when(as_col(total) > 0, as_col(part) * 100.0 / as_col(total)).otherwise(F.lit(0.0))
    return value if digits is None else rounded(value, digits)


def ratio_or_zero(n: Column | str, d: Column | str) -> Column:
    return F.when(as_col(d) > 0, as_col(n) / as_col(d)).otherwise(F.lit(0.0))


def mean_or_zero(c: Column | str, digits: int = 4) -> Column:
    return rounded(F.coalesce(F.avg(as_col(c)), F.lit(0.0)), digits)


# --- severity and messages ------------------------------------------------------------

def list_severity(confidence: Column | str) -> Column:
    """Rule of the alert list: one cut at 0.5."""
    return F.when(as_col(confidence) >= 0.5, "info").otherwise("warning")


def summary_severity(confidence: Column | str) -> Column:
    """Rule of the alert summary: cuts at 0.3 and 0.7."""
    c = as_col(confidence)
    return F.when(c < 0.3, "critical").when(c < 0.7, "warning").when(c >= 0.7, "info")


# --- vectors --------------------------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row. Written directly into a lambda, an
    expression would be computed again for every array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column | str) -> Column:
    """Softmax over an array column, shifted by the maximum so ``exp`` cannot overflow."""
    x = as_col(logits)

    def normalise(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))

    return let(let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))), normalise)


def argmax(vector: Column | str) -> Column:
    """Zero-based index of the first largest element."""
    v = as_col(vector)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


# --- aspect maps ----------------------------------------------------------------------

def aspect_sentiment(aspects_json: Column | str, aspect: str) -> Column:
    """Sentiment of one aspect from JSON text in the nested or in the flat shape."""
    v = F.try_parse_json(as_col(aspects_json))
    nested = F.try_variant_get(v, f"$.{aspect}.sentiment", "string")
    return F.coalesce(nested, F.try_variant_get(v, f"$.{aspect}", "string"))


def flat_aspects(aspects: Column | str) -> Column:
    """Nested aspect map to ``{aspect: sentiment}``."""
    return F.transform_values(as_col(aspects), lambda _, a: a["sentiment"])


def map_get(m: Column | str, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(as_col(m), F.lit(key)), F.lit(default))
