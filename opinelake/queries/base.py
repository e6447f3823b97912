"""Query registry and the SQL twins of the test views and text expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from opinelake.sources.star import ASPECTS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# --- number helpers ------------------------------------------------------------------------

def r(expr: str, digits: int) -> str:
    """Half-up rounding through DECIMAL, as ``functions.values.rounded``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,12)), {digits}) AS DOUBLE)"


def pct(part: str, total: str, digits: int = 2) -> str:
    return r(f"CASE WHEN {total} > 0 THEN {part} * 100::DOUBLE / {total} ELSE 0 END", digits)


def n_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def isum(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


def sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def labels(prefix: str = "predicted_sentiment", suffix: str = "") -> str:
    return ", ".join(f"{n_if(f'{prefix} = {chr(39)}{s}{chr(39)}')} AS {s}{suffix}" for s in ("positive", "negative", "neutral"))


# --- text helpers --------------------------------------------------------------------------

# Unicode white space, written out because the SQL engine's \s is ASCII only.
UNI_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NON_SPACE = f"[^{UNI_SPACE}]"
UNI_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def sub(expr: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


HTML, URL, EMAIL = "<[^>]+>", rf"(?:http|www\.){NON_SPACE}+", f"{NON_SPACE}+@{NON_SPACE}+"
MENTION, HASHTAG = f"@{UNI_WORD}+", f"#({UNI_WORD}+)"
NON_ASCII, PUNCT, DIGIT = r"[^\x00-\x7F]", r"[^\w\s'']", r"\d+"


def squeeze(expr: str) -> str:
    return f"lower(trim({sub(expr, chr(92) + 's+')}))"


def clean(expr: str) -> str:
    x = f"coalesce({expr}, '')"
    for p in (HTML, URL, EMAIL):
        x = sub(x, p)
    return squeeze(sub(sub(x, NON_ASCII, ""), PUNCT))


def clean_tweet(expr: str) -> str:
    x = f"coalesce({expr}, '')"
    for p in (HTML, URL, MENTION):
        x = sub(x, p)
    x = sub(sub(x, HASHTAG, r"\1"), EMAIL)
    return squeeze(sub(sub(sub(x, NON_ASCII, ""), PUNCT), DIGIT))


def toks(expr: str, longer_than: int = 0) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[{UNI_SPACE}]+'), lambda t: length(t) > {longer_than})"


def hits(text: str, phrases: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {sql_list([p])}) AS INTEGER)" for p in phrases) + ")"


# --- relational views ------------------------------------------------------------------------

_ASPECT_ROWS = " UNION ALL ".join(
    f"SELECT o_orderkey AS review_id, '{a}' AS aspect, "
    f"(['positive','negative','neutral'])[((o_orderkey + {i}) % 7 % 3 + 1)] AS sentiment FROM orders WHERE o_orderkey % {i + 2} = 0"
    for i, a in enumerate(ASPECTS)
)

REL = f"""WITH products AS (
  SELECT CAST(c_custkey AS VARCHAR) AS product_id, 'A' || c_custkey AS asin, c_name AS product_name,
         'Brand#' || c_nationkey AS brand, c_mktsegment AS category, CAST(c_acctbal AS DECIMAL(10,2)) AS price,
         c_nationkey % 2 = 1 AS is_competitor FROM customer),
reviews AS (
  SELECT o_orderkey AS review_id, CAST(o_custkey AS VARCHAR) AS product_id, 'user' || (o_orderkey % 97) AS reviewer_id,
         o_orderstatus || ' ' || o_orderpriority AS review_text, CAST(o_orderpriority[1:1] AS SMALLINT) AS raw_rating,
         o_orderdate AS review_date, CAST(o_orderkey % 7 AS INTEGER) AS helpful_votes,
         CAST(o_orderkey % 11 AS INTEGER) AS total_votes, 'amazon' AS source, o_orderdate AS ingested_at FROM orders),
sentiment_results AS (
  SELECT o_orderkey AS result_id, o_orderkey AS review_id,
         CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS predicted_sentiment,
         (o_orderkey % 100) / 100::DOUBLE AS positive_score, (o_orderkey * 7 % 100) / 100::DOUBLE AS negative_score,
         (o_orderkey * 13 % 100) / 100::DOUBLE AS neutral_score, (o_orderkey * 37 % 100) / 100::DOUBLE AS confidence_score,
         o_orderdate AS analyzed_at FROM orders),
aspect_rows AS ({_ASPECT_ROWS}),
joined AS (SELECT * FROM reviews JOIN sentiment_results USING (review_id)),
full_records AS (SELECT * FROM joined JOIN products USING (product_id))
"""

TXT = f"""WITH text_reviews AS (
  SELECT doc_id AS review_id, source AS product_id, lang, text AS review_text, {clean('text')} AS cleaned_text,
         TIMESTAMP '2001-08-01' - to_days(CAST(doc_id % 40 AS INTEGER)) AS ingested_at FROM documents),
text_sentiment AS (
  SELECT doc_id AS review_id, CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END
         AS predicted_sentiment FROM documents)
"""

RAW = f"""WITH raw_reviews AS (
  SELECT doc_id AS "Id", source AS "ProductId", 'user' || (doc_id % 97) AS "UserId", 'name ' || (doc_id % 97) AS "ProfileName",
         CAST(doc_id % 7 AS INTEGER) AS "HelpfulnessNumerator", CAST(doc_id % 11 AS INTEGER) AS "HelpfulnessDenominator",
         CAST(doc_id % 6 AS INTEGER) AS "Score", 996624000 - doc_id * 3600 AS "Time",
         'Review of ' || source || ' no ' || doc_id AS "Summary", CASE WHEN doc_id % 50 <> 49 THEN text END AS "Text"
  FROM documents),
raw_tweets AS (
  SELECT ([0, 2, 4, 3])[doc_id % 4 + 1] AS sentiment, doc_id AS id,
         make_timestamp((1239056385 + doc_id * 61) * 1000000) AS ts,
         strftime(make_timestamp((1239056385 + doc_id * 61) * 1000000), '%a %b %d %H:%M:%S UTC %Y') AS date,
         'NO_QUERY' AS query, 'user' || (doc_id % 89) AS "user",
         regexp_replace(regexp_replace(text, '[^\\x00-\\x{{FF}}]', '', 'g'), '[\\r\\n]+', ' ', 'g') AS text
  FROM documents),
reviews_first AS (
  SELECT * FROM raw_reviews WHERE "Text" IS NOT NULL AND "Score" BETWEEN 1 AND 5
  QUALIFY row_number() OVER (PARTITION BY "Text" ORDER BY "Id") = 1),
reviews_clean AS (
  SELECT *, length(cleaned_text) AS review_length,
         CASE WHEN "Score" >= 4 THEN 'positive' WHEN "Score" <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
         make_timestamp("Time" * 1000000) AS review_date,
         CASE WHEN "HelpfulnessDenominator" > 0 THEN "HelpfulnessNumerator"::DOUBLE / "HelpfulnessDenominator" ELSE 0 END
           AS helpfulness_ratio, 'amazon' AS source
  FROM (SELECT *, {clean('"Text"')} AS cleaned_text FROM reviews_first) WHERE length(cleaned_text) BETWEEN 10 AND 2000),
tweets_first AS (
  SELECT *, CASE sentiment WHEN 0 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'positive' END AS sentiment_label
  FROM raw_tweets WHERE sentiment IN (0, 2, 4) QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1),
tweets_clean AS (
  SELECT *, length(cleaned_text) AS review_length, ts AS review_date, 'twitter' AS source
  FROM (SELECT *, {clean_tweet('text')} AS cleaned_text FROM tweets_first) WHERE length(cleaned_text) BETWEEN 10 AND 280),
merged AS (
  SELECT cleaned_text, sentiment_label, review_length, source, review_date FROM reviews_clean
  UNION ALL SELECT cleaned_text, sentiment_label, review_length, source, review_date FROM tweets_clean)
"""
