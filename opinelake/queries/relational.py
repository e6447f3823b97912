"""Dashboard queries over the review model."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinelake.functions import values as vl
from opinelake.operators import analytics as an
from opinelake.operators import integrity as ig
from opinelake.operators import joins as jn
from opinelake.operators import ordering as od
from opinelake.operators import projections as pr
from opinelake.operators import windows as wn
from opinelake.plans.dashboard import overview
from opinelake.plans.views import DashboardViews
from opinelake.queries.base import REL, iso, isum, labels, n_if, pct, query, r, sql_list
from opinelake.session import shared_dir
from opinelake.sources import bucketed as bk
from opinelake.sources import star

AS_OF = star.AS_OF
SINCE30 = "ingested_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY"

# Whole tables; for the cases without partner, the reviews of one product are added once more under ids that no result has.
EXTRA = "(SELECT * FROM reviews UNION ALL SELECT * REPLACE (-review_id AS review_id) FROM reviews WHERE product_id = '7')"


def _extra(reviews):
    return reviews.unionByName(pr.for_product(reviews, "7").withColumn("review_id", -F.col("review_id")))


LABELS = ("positive", "negative", "neutral")
IDS = ["7", "3", "99999999", "12", "1"]


def _rs(spark, sf, aspects=False):
    return star.reviews(spark, sf), star.sentiment_results(spark, sf, aspects)


def _prs(spark, sf):
    return star.products(spark, sf), *_rs(spark, sf)


# --- B: projections and filters --------------------------------------------------------------

@query("product_filter_b8", REL + "SELECT review_id, product_id, raw_rating FROM reviews WHERE product_id = '7'")
def _(spark, sf):
    return pr.for_product(star.reviews(spark, sf), "7").select("review_id", "product_id", "raw_rating")


@query(
    "look_back_b9",
    REL + f"""SELECT 'days' AS win, review_id, {iso('ingested_at')} AS ingested_at FROM reviews WHERE {SINCE30}
UNION ALL SELECT 'hours', review_id, {iso('ingested_at')} FROM reviews WHERE ingested_at >= TIMESTAMP '2001-08-01' - INTERVAL 168 HOUR""",
)
def _(spark, sf):
    rv = star.reviews(spark, sf)
    days, hours = pr.look_back(rv, "ingested_at", AS_OF, days=30), pr.look_back(rv, "ingested_at", AS_OF, hours=168)
    cols = ["review_id", vl.iso_text("ingested_at").alias("ingested_at")]
    return days.select(F.lit("days").alias("win"), *cols).unionByName(hours.select(F.lit("hours").alias("win"), *cols))


@query(
    "confidence_filter_b10",
    REL + "SELECT result_id, confidence_score FROM sentiment_results WHERE confidence_score < 0.5 AND confidence_score >= 0",
)
def _(spark, sf):
    return pr.confidence_filter(star.sentiment_results(spark, sf), below=0.5, acknowledged=True).select("result_id", "confidence_score")


@query("label_filter_b11", REL + "SELECT review_id, product_id FROM joined WHERE predicted_sentiment = 'neutral'")
def _(spark, sf):
    return pr.with_label(*_rs(spark, sf), "neutral").select("review_id", "product_id")


@query("point_lookup_b12", REL + "SELECT product_id, product_name, category FROM products WHERE product_id = '12'")
def _(spark, sf):
    return pr.by_key(star.products(spark, sf), "product_id", "12").select("product_id", "product_name", "category")


@query(
    "review_records_b14",
    REL + f"""SELECT review_id, review_text, {iso('review_date')} AS review_date, result_id IS NOT NULL AS has_sentiment,
  predicted_sentiment AS label, confidence_score AS confidence
FROM {EXTRA} LEFT JOIN sentiment_results USING (review_id)""",
)
def _(spark, sf):
    rv, se = _rs(spark, sf)
    out = pr.review_records(_extra(rv), se)
    return out.select(
        "review_id", "review_text", "review_date", F.col("sentiment").isNotNull().alias("has_sentiment"),
        F.col("sentiment.predicted_sentiment").alias("label"), F.col("sentiment.confidence_score").alias("confidence"),
    )


@query(
    "product_records_b15",
    REL + f"""SELECT product_id, asin, CASE WHEN price <> 0 THEN CAST(price AS DOUBLE) END AS price, is_competitor,
  CAST(coalesce(n, 0) AS BIGINT) AS total_reviews
FROM products LEFT JOIN (SELECT product_id, count(*) AS n FROM reviews GROUP BY 1) USING (product_id)""",
)
def _(spark, sf):
    out = pr.product_records(star.products(spark, sf), star.reviews(spark, sf))
    return out.select("product_id", "asin", "price", "is_competitor", "total_reviews")


@query(
    "result_view_b16",
    REL + """SELECT review_id, coalesce(nullif(predicted_sentiment, 'neutral'), 'neutral') AS label, positive_score,
  negative_score, neutral_score, coalesce(CASE WHEN confidence_score > 0.1 THEN confidence_score END, 0.0) AS confidence_score,
  (SELECT count(*) FROM aspect_rows a WHERE a.review_id = s.review_id) AS n_aspects FROM sentiment_results s""",
)
def _(spark, sf):
    se = star.sentiment_results(spark, sf, aspects=True).withColumns(
        {
            "predicted_sentiment": F.nullif("predicted_sentiment", F.lit("neutral")),
            "confidence_score": F.when(F.col("confidence_score") > 0.1, F.col("confidence_score")),
        }
    )
    return pr.result_view(se).withColumn("n_aspects", F.size("aspects").cast("long")).drop("aspects")


@query(
    "finders_b18",
    REL + """SELECT * FROM (SELECT 'category' AS finder, product_id AS id FROM products WHERE category = 'BUILDING'
UNION ALL SELECT 'competitors', product_id FROM products WHERE is_competitor
UNION ALL SELECT 'product', CAST(review_id AS VARCHAR) FROM (SELECT review_id FROM reviews WHERE product_id = '7' ORDER BY review_date DESC, review_id LIMIT 100)
UNION ALL SELECT 'rating', CAST(review_id AS VARCHAR) FROM (SELECT review_id FROM reviews WHERE raw_rating = 5 ORDER BY review_date DESC, review_id LIMIT 100))""",
)
def _(spark, sf):
    p, rv = star.products(spark, sf), star.reviews(spark, sf)
    parts = {
        "category": pr.by_category(p, "BUILDING").select("product_id"),
        "competitors": pr.competitors(p).select("product_id"),
        "product": pr.newest_reviews(rv, product_id="7").select("review_id"),
        "rating": pr.newest_reviews(rv, rating=5).select("review_id"),
    }
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("finder"), F.col(df.columns[0]).cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "score_maps_b19",
    REL + """SELECT result_id, positive_score AS p_positive, negative_score AS p_negative, neutral_score AS p_neutral,
  confidence_score AS confidence FROM sentiment_results""",
)
def _(spark, sf):
    out = pr.score_maps(star.sentiment_results(spark, sf))
    return out.select("result_id", *[F.col("probabilities")[s].alias(f"p_{s}") for s in LABELS], "confidence")


# --- C: joins --------------------------------------------------------------------------------

@query("review_sentiment_join_c1", REL + "SELECT review_id, product_id, predicted_sentiment, confidence_score FROM joined")
def _(spark, sf):
    return jn.reviews_with_sentiment(*_rs(spark, sf)).select("review_id", "product_id", "predicted_sentiment", "confidence_score")


@query("bucketed_records_c1", REL + "SELECT review_id, product_id, predicted_sentiment, confidence_score FROM joined")
def _(spark, sf):
    stored = bk.store_reviews(*_rs(spark, sf), buckets=16)
    return jn.reviews_with_sentiment(*stored).select("review_id", "product_id", "predicted_sentiment", "confidence_score")


@query("full_records_c2", REL + "SELECT review_id, product_id, category, raw_rating, predicted_sentiment FROM full_records")
def _(spark, sf):
    return jn.full_records(*_prs(spark, sf)).select("review_id", "product_id", "category", "raw_rating", "predicted_sentiment")


@query(
    "all_products_records_c3",
    REL + f"""SELECT product_id, review_id, result_id, category FROM products
LEFT JOIN {EXTRA} USING (product_id)
LEFT JOIN sentiment_results USING (review_id)""",
)
def _(spark, sf):
    p, rv, se = _prs(spark, sf)
    out = jn.all_products_records(p, _extra(rv), se)
    return out.select("product_id", "review_id", "result_id", "category")


@query(
    "competitors_c4",
    REL + """SELECT b.product_id, b.product_name, b.category FROM products a JOIN products b ON a.category = b.category
WHERE a.product_id = '7' AND b.product_id <> a.product_id AND b.is_competitor""",
)
def _(spark, sf):
    return jn.competitors_of(star.products(spark, sf), "7").select("product_id", "product_name", "category")


@query(
    "get_or_create_c6",
    REL + f"""SELECT product_id, category, 'Product-' || substr(product_id, 1, 8) AS product_name FROM (
  SELECT DISTINCT 'P' || product_id AS product_id, 'general' AS category FROM reviews)
UNION ALL SELECT product_id, category, product_name FROM products""",
)
def _(spark, sf):
    incoming = star.reviews(spark, sf).select(F.concat(F.lit("P"), "product_id").alias("product_id"))
    name = F.concat(F.lit("Product-"), F.substring("product_id", 1, 8))
    out = jn.get_or_create_products(incoming, star.products(spark, sf), name)
    return out.select("product_id", "category", "product_name")


@query(
    "referential_check_c7",
    REL + """SELECT review_id, product_id IN (SELECT product_id FROM products WHERE is_competitor) AS accepted FROM reviews""",
)
def _(spark, sf):
    p, rv = star.products(spark, sf).filter("is_competitor"), star.reviews(spark, sf)
    good = jn.with_parent(rv, p, "product_id", "review_id").select("review_id", F.lit(True).alias("accepted"))
    bad = jn.orphans(rv, p, "product_id", "review_id").select("review_id", F.lit(False).alias("accepted"))
    return good.unionByName(bad)


@query(
    "cascade_delete_c8",
    REL + """, gone AS (SELECT product_id FROM products WHERE category = 'BUILDING'),
kept AS (SELECT * FROM reviews WHERE product_id NOT IN (SELECT product_id FROM gone))
SELECT 'products' AS table_name, count(*) AS rows FROM products WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'reviews', count(*) FROM kept
UNION ALL SELECT 'sentiment_results', count(*) FROM sentiment_results WHERE review_id IN (SELECT review_id FROM kept)""",
)
def _(spark, sf):
    p, rv, se = _prs(spark, sf)
    parts = jn.cascade_delete(p, rv, se, pr.by_category(p, "BUILDING"))
    return an.row_counts(dict(zip(("products", "reviews", "sentiment_results"), parts)))


@query(
    "id_list_lookup_c9",
    REL + f"""SELECT CAST(i - 1 AS INTEGER) AS pos, product_id, product_name FROM
(SELECT unnest([{sql_list(IDS)}]) AS product_id, generate_subscripts([{sql_list(IDS)}], 1) AS i) JOIN products USING (product_id)""",
)
def _(spark, sf):
    return jn.lookup_in_order(star.products(spark, sf), IDS).select("pos", "product_id", "product_name")


# --- E: aggregates -----------------------------------------------------------------------------

_DIST = f"""SELECT l.sentiment, coalesce(c, 0) AS count, {pct('coalesce(c, 0)', 't')} AS percentage, t AS total
FROM (SELECT unnest(['positive','negative','neutral']) AS sentiment) l
LEFT JOIN (SELECT predicted_sentiment AS sentiment, count(*) AS c FROM {{src}} GROUP BY 1) USING (sentiment), (SELECT count(*) AS t FROM {{src}})"""


@query("sentiment_distribution_e1", REL + _DIST.format(src="joined"))
def _(spark, sf):
    return an.sentiment_distribution(*_rs(spark, sf))


@query("product_sentiment_distribution_e1", REL + _DIST.format(src="(SELECT * FROM joined WHERE product_id = '7')"))
def _(spark, sf):
    return an.sentiment_distribution(*_rs(spark, sf), product_id="7")


@query("average_scores_e2", REL + "SELECT " + ", ".join(f"{r(f'coalesce(avg({s}), 0)', 4)} AS avg_{s}" for s in an.SCORES) + " FROM joined")
def _(spark, sf):
    return an.average_scores(*_rs(spark, sf))


@query(
    "overall_stats_e3",
    REL + f"""SELECT count(*) AS total_reviews, {labels()}, {r('coalesce(avg(nullif(raw_rating, 0)), 0)', 2)} AS avg_rating
FROM {EXTRA} LEFT JOIN sentiment_results USING (review_id)""",
)
def _(spark, sf):
    rv, se = _rs(spark, sf)
    return an.overall_stats(_extra(rv), se)


_RATINGS = "SELECT CAST(i AS INTEGER) AS rating, count(review_id) AS count FROM range(1, 6) t(i) LEFT JOIN {src} ON raw_rating = i GROUP BY 1"


@query("rating_distribution_e4", REL + _RATINGS.format(src="reviews"))
def _(spark, sf):
    return an.rating_distribution(star.reviews(spark, sf))


@query("product_rating_distribution_e4", REL + _RATINGS.format(src="(SELECT * FROM reviews WHERE product_id = '7')"))
def _(spark, sf):
    return an.rating_distribution(pr.for_product(star.reviews(spark, sf), "7"))


ORACLE_E5 = (
    REL + f"""SELECT product_id, product_name, category, count(review_id) AS total_reviews,
  {n_if('raw_rating >= 4')} AS positive_reviews, {n_if('raw_rating = 3')} AS neutral_reviews, {n_if('raw_rating <= 2')} AS negative_reviews,
  {r('avg(raw_rating)', 4)} AS avg_rating, {labels()}, {r('avg(positive_score)', 4)} AS avg_positive_score,
  {r('avg(negative_score)', 4)} AS avg_negative_score, {r('avg(confidence_score)', 4)} AS avg_confidence
FROM products LEFT JOIN reviews USING (product_id)
LEFT JOIN sentiment_results USING (review_id) GROUP BY 1, 2, 3""".replace("AS positive,", "AS predicted_positive,").replace(
        "AS negative,", "AS predicted_negative,").replace("AS neutral,", "AS predicted_neutral,")
)


@query("product_summary_e5", ORACLE_E5)
def _(spark, sf):
    p, rv, se = _prs(spark, sf)
    return an.product_summary(p, rv, se)


ORACLE_E6 = (
    REL + f"""SELECT strftime(review_date, '%Y-%m-%d') AS review_day, category, count(*) AS total_reviews,
  {r('avg(raw_rating)', 4)} AS avg_rating, {labels(suffix='_count')} FROM full_records GROUP BY 1, 2"""
)


@query("daily_category_trend_e6", ORACLE_E6)
def _(spark, sf):
    p, rv, se = _prs(spark, sf)
    undated = pr.for_product(rv, "7").withColumn("review_date", F.lit(None).cast("timestamp"))  # rows that are left out
    return an.daily_category_trend(p, rv.unionByName(undated), se)


def _in_two_loads(spark, sf):
    """The views after one load of the reviews up to a day and another of the later ones."""
    p, rv, se = _prs(spark, sf)
    views = DashboardViews(shared_dir(spark, "views"), buckets=4)
    early = F.col("ingested_at") < F.lit("2000-01-01").cast("timestamp")
    for load_id, part in enumerate((rv.filter(early), rv.filter(~F.coalesce(early, F.lit(False))))):
        views.load(part, se.join(part.select("review_id"), "review_id", "left_semi"), load_id)
    return views, p, rv, se


@query("maintained_summary_e5", ORACLE_E5)
def _(spark, sf):
    views, p, rv, se = _in_two_loads(spark, sf)
    return views.product_summary(p, rv, se, loads=2)


@query("maintained_trend_e6", ORACLE_E6)
def _(spark, sf):
    views, p, rv, se = _in_two_loads(spark, sf)
    return views.daily_category_trend(p, rv, se, loads=2)


@query(
    "daily_trend_e7",
    REL + f"""SELECT strftime(ingested_at, '%Y-%m-%d') AS date, {labels()}, count(*) AS total FROM joined WHERE {SINCE30} GROUP BY 1""",
)
def _(spark, sf):
    return an.daily_trend(*_rs(spark, sf), AS_OF)


_PERIOD = {"day": "%Y-%m-%d", "week": "%G-W%V", "month": "%Y-%m"}


def _period(interval: str) -> None:
    sql = REL + f"""SELECT strftime(ingested_at, '{_PERIOD[interval]}') AS period, {labels()}, count(*) AS total
FROM joined WHERE ingested_at >= TIMESTAMP '2001-08-01' - INTERVAL 2500 DAY GROUP BY 1"""

    @query(f"{interval}_trend_e8", sql)
    def _(spark, sf):
        return an.period_trend(*_rs(spark, sf), AS_OF, interval=interval, days=2500)


for _interval in _PERIOD:
    _period(_interval)


@query(
    "aspect_trend_e9",
    REL + f"""SELECT strftime(ingested_at, '%Y-%m-%d') AS date, {labels()}, count(*) AS total,
  arg_max(a.sentiment, struct_pack(t := ingested_at, i := review_id)) FILTER (WHERE a.sentiment IS NOT NULL) AS aspect_sentiment
FROM joined LEFT JOIN (SELECT * FROM aspect_rows WHERE aspect = 'value') a USING (review_id)
WHERE ingested_at >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAY GROUP BY 1""",
)
def _(spark, sf):
    return an.aspect_trend(*_rs(spark, sf, aspects=True), AS_OF, "value", days=400)


@query(
    "aspect_summary_e10",
    REL + f"""SELECT aspect, count(sentiment) AS mentions, {', '.join(f"{pct(n_if(chr(115) + 'entiment = ' + chr(39) + s + chr(39)), 'count(sentiment)', 1)} AS {s}_pct" for s in LABELS)}
FROM (SELECT unnest([{sql_list(star.ASPECTS)}]) AS aspect) LEFT JOIN aspect_rows USING (aspect) GROUP BY 1""",
)
def _(spark, sf):
    rv, se = _rs(spark, sf, aspects=True)
    return an.aspect_summary(rv, se)


@query(
    "category_comparison_e16",
    REL + f"""SELECT category, count(*) AS total_reviews, {r('avg(raw_rating)', 2)} AS avg_rating,
  {', '.join(f"{r(f'coalesce(avg({s}), 0)', 4)} AS avg_{s}" for s in an.SCORES[:3])} FROM full_records WHERE category <> '' GROUP BY 1""",
)
def category_comparison(spark, sf):
    return an.category_comparison(*_prs(spark, sf))


_PROFILE = f"""{', '.join(f"count(*) FILTER (WHERE predicted_sentiment = '{s}') AS {s}_count" for s in LABELS)},
  {', '.join(f"{pct(n_if('predicted_sentiment = ' + chr(39) + s + chr(39)), 'count(result_id)')} AS {s}_pct" for s in LABELS)},
  count(result_id) AS total, {', '.join(f"{r(f'coalesce(avg({s}), 0)', 4)} AS avg_{s}" for s in an.SCORES)}"""


@query(
    "product_comparison_e17",
    REL + f"""SELECT CAST(list_position([{sql_list(IDS)}], product_id) - 1 AS INTEGER) AS pos, product_id, product_name, category, {_PROFILE}
FROM products LEFT JOIN joined USING (product_id) WHERE product_id IN ({sql_list(IDS)}) GROUP BY ALL""",
)
def _(spark, sf):
    return an.compare_products(*_prs(spark, sf), IDS)


@query(
    "competitor_comparison_e18",
    REL + f""", t AS (SELECT * FROM products WHERE product_id = '7'),
chosen AS (SELECT product_id, product_name, category, 'product' AS role FROM t
  UNION ALL SELECT p.product_id, p.product_name, p.category, 'competitor' FROM products p JOIN t ON p.category = t.category AND p.product_id <> t.product_id AND p.is_competitor)
SELECT product_id, product_name, category, role, {_PROFILE} FROM chosen LEFT JOIN joined USING (product_id) GROUP BY ALL""",
)
def _(spark, sf):
    return an.compare_with_competitors(*_prs(spark, sf), "7")


@query(
    "alert_summary_e21",
    REL + f"""SELECT count(*) AS total_alerts, {n_if('confidence_score < 0.7')} AS unacknowledged, {n_if('confidence_score < 0.3')} AS critical,
  {n_if('confidence_score >= 0.3 AND confidence_score < 0.7')} AS warning, {n_if('confidence_score >= 0.7')} AS info
FROM sentiment_results WHERE analyzed_at >= TIMESTAMP '2001-08-01' - INTERVAL 24 HOUR""",
)
def _(spark, sf):
    return an.alert_summary(*_rs(spark, sf), AS_OF)


_HIST = f"""SELECT review_id, {iso('analyzed_at')} AS date, product_id, 1 AS total, CAST(predicted_sentiment = 'negative' AS INTEGER) AS negative_reviews,
  CAST(predicted_sentiment = 'negative' AS INTEGER)::DOUBLE AS negative_ratio FROM joined WHERE analyzed_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY"""


@query("alert_history_e22", REL + _HIST)
def _(spark, sf):
    return an.alert_history(*_rs(spark, sf), AS_OF)


@query(
    "alert_history_daily_e22",
    REL + f"""SELECT date[1:10] AS day, {isum('total')} AS total, {isum('negative_reviews')} AS negative_reviews, {r('avg(negative_ratio)', 4)} AS negative_ratio
FROM ({_HIST}) GROUP BY 1""",
)
def _(spark, sf):
    return an.alert_history_daily(an.alert_rows(*_rs(spark, sf), AS_OF, days=30))


@query(
    "prediction_distribution_e23",
    REL + """SELECT predicted_sentiment, count(*) AS count, (SELECT count(*) FROM sentiment_results) AS total_predictions FROM sentiment_results GROUP BY 1""",
)
def _(spark, sf):
    return an.prediction_distribution(star.sentiment_results(spark, sf))


_J = "json_object"


@query(
    "dashboard_overview_e36",
    REL + f"""SELECT 'stats' AS block, CAST({_J}('avg_rating', avg_rating, 'negative', negative, 'neutral', neutral, 'positive', positive, 'total_reviews', total_reviews) AS VARCHAR) AS item
FROM (SELECT count(*) AS total_reviews, {labels()}, {r('avg(raw_rating)', 2)} AS avg_rating FROM joined)
UNION ALL SELECT 'trends', CAST({_J}('date', date, 'negative', negative, 'neutral', neutral, 'positive', positive, 'total', total) AS VARCHAR)
FROM (SELECT strftime(ingested_at, '%Y-%m-%d') AS date, {labels()}, count(*) AS total FROM joined WHERE {SINCE30} GROUP BY 1)
UNION ALL SELECT 'aspects', CAST({_J}('aspect', aspect, 'mentions', mentions, 'negative_pct', n1, 'neutral_pct', n2, 'positive_pct', n3) AS VARCHAR)
FROM (SELECT aspect, count(*) AS mentions, {pct(n_if("sentiment = 'negative'"), 'count(*)', 1)} AS n1, {pct(n_if("sentiment = 'neutral'"), 'count(*)', 1)} AS n2,
  {pct(n_if("sentiment = 'positive'"), 'count(*)', 1)} AS n3 FROM aspect_rows GROUP BY 1)
UNION ALL SELECT 'recent_reviews', CAST({_J}('ingested_at', {iso('ingested_at')}, 'product_id', product_id, 'raw_rating', raw_rating, 'review_id', review_id) AS VARCHAR)
FROM (SELECT * FROM reviews ORDER BY ingested_at DESC, review_id LIMIT 10)
UNION ALL SELECT 'alert_summary', CAST({_J}('critical', c, 'info', i, 'total_alerts', t, 'unacknowledged', u, 'warning', w) AS VARCHAR)
FROM (SELECT count(*) AS t, {n_if('confidence_score < 0.7')} AS u, {n_if('confidence_score < 0.3')} AS c, {n_if('confidence_score >= 0.3 AND confidence_score < 0.7')} AS w,
  {n_if('confidence_score >= 0.7')} AS i FROM sentiment_results WHERE analyzed_at >= TIMESTAMP '2001-08-01' - INTERVAL 24 HOUR)""",
)
def _(spark, sf):
    return overview(*_rs(spark, sf, aspects=True), AS_OF)


@query(
    "table_row_counts_e37",
    REL + """SELECT 'products' AS table_name, count(*) AS rows FROM products UNION ALL SELECT 'reviews', count(*) FROM reviews
UNION ALL SELECT 'sentiment_results', count(*) FROM sentiment_results""",
)
def _(spark, sf):
    return an.row_counts(dict(zip(("products", "reviews", "sentiment_results"), _prs(spark, sf))))


@query(
    "sentiment_gauge_e38",
    REL + f"""SELECT product_id, product_name, {', '.join(f"{r(f'{s} * 100::DOUBLE / greatest(n, 1)', 4)} AS {s}_pct" for s in LABELS)}
FROM (SELECT product_id, product_name, {labels()}, count(result_id) AS n FROM products LEFT JOIN joined USING (product_id) GROUP BY 1, 2)""",
)
def _(spark, sf):
    return an.gauge(an.product_profiles(*_prs(spark, sf)))


# --- F: windows and ranking ----------------------------------------------------------------------

@query(
    "negative_spikes_f1",
    """SELECT event_id, user_id, negative_ratio FROM (
SELECT event_id, user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) OVER w AS negative_ratio, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
WHERE n = 10 AND negative_ratio >= 0.3""",
)
def _(spark, sf):
    out = wn.spikes(star.events(spark, sf), "user_id", "ts", "event_id", F.col("event_type") == "error")
    return out.select("event_id", "user_id", "negative_ratio")


@query(
    "latest_spikes_f1",
    """SELECT user_id, avg(neg) AS negative_ratio FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END AS neg,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 10
GROUP BY 1 HAVING count(*) = 10 AND avg(neg) >= 0.3""",
)
def _(spark, sf):
    return wn.latest_spikes(star.events(spark, sf), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query("latest_record_f2", REL + f"SELECT result_id, predicted_sentiment, {iso('analyzed_at')} AS analyzed_at FROM sentiment_results ORDER BY sentiment_results.analyzed_at DESC, result_id DESC LIMIT 1")
def _(spark, sf):
    out = wn.latest_by(star.sentiment_results(spark, sf), "analyzed_at", "result_id")
    return out.select("result_id", "predicted_sentiment", vl.iso_text("analyzed_at").alias("analyzed_at"))


@query(
    "first_n_per_key_f3",
    REL + """SELECT product_id, review_id, CAST(i AS INTEGER) AS position FROM (SELECT product_id, review_id,
row_number() OVER (PARTITION BY product_id ORDER BY review_id) AS i FROM reviews) WHERE i <= 5""",
)
def _(spark, sf):
    return wn.first_n(star.reviews(spark, sf).select("product_id", "review_id"), "product_id", ["review_id"], 5)


@query(
    "mode_by_count_f4",
    REL + """SELECT product_id, arg_max(predicted_sentiment, struct_pack(a := n, b := -f)) AS mode FROM (
SELECT product_id, predicted_sentiment, count(*) AS n, min(review_id) AS f FROM joined GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    df = jn.reviews_with_sentiment(*_rs(spark, sf))
    return wn.mode_by_count(df, "product_id", "predicted_sentiment", "review_id")


@query("share_of_total_f6", REL + f"SELECT category, n, {r('n * 100::DOUBLE / sum(n) OVER ()', 2)} AS percentage FROM (SELECT category, count(*) AS n FROM products GROUP BY 1)")
def _(spark, sf):
    return wn.with_share(star.products(spark, sf).groupBy("category").agg(F.count("*").alias("n")), "n")


@query(
    "latest_in_period_f7",
    REL + """SELECT strftime(analyzed_at, '%Y-%m') AS month, arg_max(predicted_sentiment, struct_pack(a := analyzed_at, b := result_id)) AS last_sentiment
FROM sentiment_results GROUP BY 1""",
)
def _(spark, sf):
    last = F.max_by("predicted_sentiment", F.struct("analyzed_at", "result_id"))
    return star.sentiment_results(spark, sf).groupBy(vl.month_key("analyzed_at").alias("month")).agg(last.alias("last_sentiment"))


# --- G: sort, limit, pages ---------------------------------------------------------------------

@query(
    "review_page_g1",
    REL + f"""SELECT review_id, product_id, {iso('ingested_at')} AS ingested_at, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages FROM (
SELECT *, count(*) OVER () AS total FROM joined WHERE predicted_sentiment = 'negative' ORDER BY ingested_at DESC, review_id LIMIT 20 OFFSET 40)""",
)
def _(spark, sf):
    out = od.review_page(*_rs(spark, sf), label="negative", page=3, per_page=20)
    return out.select("review_id", "product_id", vl.iso_text("ingested_at").alias("ingested_at"), "total", "pages")


@query(
    "deep_review_page_g1",
    REL + f"""SELECT review_id, product_id, {iso('ingested_at')} AS ingested_at, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages FROM (
SELECT *, count(*) OVER () AS total FROM reviews ORDER BY ingested_at DESC, review_id LIMIT 20 OFFSET 1180)""",
)
def _(spark, sf):
    out = od.review_page(*_rs(spark, sf), page=60, near=100)
    return out.select("review_id", "product_id", vl.iso_text("ingested_at").alias("ingested_at"), "total", "pages")


def _alert_cols(prefix: str, conf: str, alert_type: str, severity: str, ack: str = "FALSE") -> str:
    return f"""result_id AS id, product_id, '{alert_type}' AS alert_type, {severity} AS severity,
  printf('{prefix} %s ({conf}%.2f)', predicted_sentiment, confidence_score) AS message, confidence_score AS metric_value,
  0.5::DOUBLE AS threshold, {iso('analyzed_at')} AS triggered_at, {ack} AS acknowledged"""


_SEV = "CASE WHEN confidence_score >= 0.5 THEN 'info' ELSE 'warning' END"


@query(
    "alert_list_g2",
    REL + f"SELECT {_alert_cols('Sentiment prediction:', 'confidence: ', 'sentiment_low_confidence', _SEV)} FROM joined ORDER BY joined.analyzed_at DESC, result_id LIMIT 50 OFFSET 10",
)
def _(spark, sf):
    return od.alert_list(*_rs(spark, sf), offset=10)


@query("recent_reviews_g3", REL + f"SELECT review_id, {iso('ingested_at')} AS ingested_at FROM reviews ORDER BY reviews.ingested_at DESC, review_id LIMIT 10")
def _(spark, sf):
    return od.recent_reviews(star.reviews(spark, sf)).select("review_id", vl.iso_text("ingested_at").alias("ingested_at"))


@query(
    "recent_alerts_g4",
    REL + f"""SELECT result_id AS id, {_SEV} AS severity, printf('Sentiment: %s (conf: %.2f)', predicted_sentiment, confidence_score) AS message,
  {iso('analyzed_at')} AS triggered_at, product_id FROM joined WHERE analyzed_at >= TIMESTAMP '2001-07-31' ORDER BY joined.analyzed_at DESC, result_id LIMIT 10""",
)
def _(spark, sf):
    return od.recent_alerts(*_rs(spark, sf), AS_OF)


@query(
    "alert_check_g5",
    REL + f"""SELECT {_alert_cols('Low confidence prediction:', '', 'low_confidence', "'warning'")} FROM (
SELECT * FROM joined ORDER BY analyzed_at DESC, result_id LIMIT 50) WHERE confidence_score < 0.5""",
)
def _(spark, sf):
    return od.alert_check(*_rs(spark, sf))


_VERSIONS = f"""(SELECT CAST(p_partkey AS INTEGER) AS version_id, 'model-' || p_brand AS model_name, 'v' || p_partkey AS version,
 p_size / 100::DOUBLE AS accuracy, TIMESTAMP '2001-01-01' + to_days(CAST(p_partkey % 300 AS INTEGER)) AS created_at FROM part)"""


def _versions(spark, sf):
    key = F.col("p_partkey")
    return star.table(spark, sf, "part").select(
        key.cast("int").alias("version_id"), F.concat(F.lit("model-"), "p_brand").alias("model_name"),
        F.concat(F.lit("v"), key.cast("string")).alias("version"), (F.col("p_size") / 100.0).alias("accuracy"),
        (F.lit("2001-01-01").cast("timestamp") + F.make_dt_interval((key % 300).cast("int"))).alias("created_at"),
    )


@query("training_history_g6", f"SELECT version_id, model_name, version, accuracy FROM {_VERSIONS} ORDER BY created_at DESC, version_id DESC LIMIT 5")
def _(spark, sf):
    return od.training_history(_versions(spark, sf)).select("version_id", "model_name", "version", "accuracy")


@query(
    "top_and_bottom_k_g7",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT 'top' AS list, * FROM (SELECT * FROM c ORDER BY n DESC, p_brand LIMIT 5) UNION ALL SELECT 'bottom', * FROM (SELECT * FROM c ORDER BY n, p_brand LIMIT 5)""",
)
def _(spark, sf):
    c = star.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    top, low = od.top_k(c, "p_brand", "n", 5), od.bottom_k(c, "p_brand", "n", 5)
    return top.select(F.lit("top").alias("list"), "*").unionByName(low.select(F.lit("bottom").alias("list"), "*"))


@query("newest_first_g8", REL + f"SELECT review_id, {iso('review_date')} AS review_date FROM reviews")
def _(spark, sf):
    out = od.newest_first(star.reviews(spark, sf), "review_date", ["review_id"])
    return out.select("review_id", vl.iso_text("review_date").alias("review_date"))


@query(
    "alert_display_g9",
    REL + f"""SELECT result_id AS id, CASE WHEN review_id % 9 <> 0 THEN {iso('analyzed_at')} END AS triggered_at FROM sentiment_results ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20""",
)
def _(spark, sf):
    ts = F.when(F.col("review_id") % 9 != 0, vl.iso_text("analyzed_at"))
    return od.alert_display(star.sentiment_results(spark, sf).select(F.col("result_id").alias("id"), ts.alias("triggered_at")))


# --- M: constraints and lifecycle (loads are in queries.text) ------------------------------------

@query("check_constraints_m4", REL + "SELECT product_id, CASE WHEN price <= 0 THEN 'price_not_positive' ELSE '' END AS reasons FROM products")
def _(spark, sf):
    out = ig.with_violations(star.products(spark, sf), ig.product_checks())
    return out.select("product_id", F.array_join("violations", ",").alias("reasons"))


@query(
    "unique_constraint_m5",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return ig.unique_violations(star.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "column_defaults_m6",
    REL + f"""SELECT review_id, coalesce(nullif(helpful_votes, 6), 0) AS helpful_votes, FALSE AS verified_purchase, source,
  CASE WHEN review_id % 4 = 0 THEN '2001-08-01T00:00:00' ELSE {iso('ingested_at')} END AS ingested_at FROM reviews""",
)
def _(spark, sf):
    rv = star.reviews(spark, sf).withColumns(
        {
            "helpful_votes": F.nullif("helpful_votes", F.lit(6)),
            "ingested_at": F.when(F.col("review_id") % 4 != 0, F.col("ingested_at")),
        }
    )
    out = ig.with_defaults(rv, ig.review_defaults(vl.as_of_literal(AS_OF)))
    return out.select("review_id", "helpful_votes", "verified_purchase", "source", vl.iso_text("ingested_at").alias("ingested_at"))


@query(
    "upsert_products_m7",
    REL + """SELECT product_id, CASE WHEN is_competitor THEN product_name || ' (new)' ELSE product_name END AS product_name,
  '1990-01-01T00:00:00' AS created_at, CASE WHEN is_competitor THEN '2001-08-01T00:00:00' ELSE '1990-01-01T00:00:00' END AS updated_at FROM products
UNION ALL SELECT 'N' || product_id, product_name, '2001-08-01T00:00:00', '2001-08-01T00:00:00' FROM products WHERE category = 'BUILDING'""",
)
def _(spark, sf):
    old = F.lit("1990-01-01").cast("timestamp")
    p = star.products(spark, sf).select("product_id", "product_name", "category", "is_competitor")
    stored = p.withColumns({"created_at": old, "updated_at": old})
    renamed = p.filter("is_competitor").withColumn("product_name", F.concat("product_name", F.lit(" (new)")))
    added = pr.by_category(p, "BUILDING").withColumn("product_id", F.concat(F.lit("N"), "product_id"))
    changes = renamed.unionByName(added).withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": old})
    out = ig.upsert(stored, changes, "product_id", vl.as_of_literal(AS_OF))
    return out.select(
        "product_id", "product_name", vl.iso_text("created_at").alias("created_at"), vl.iso_text("updated_at").alias("updated_at")
    )


@query(
    "acknowledge_alerts_m8",
    REL + f"SELECT {_alert_cols('Sentiment prediction:', 'confidence: ', 'sentiment_low_confidence', _SEV, 'result_id % 3 = 0')} FROM joined ORDER BY joined.analyzed_at DESC, result_id LIMIT 50",
)
def _(spark, sf):
    rv, se = _rs(spark, sf)
    stored = ig.acknowledge(None, se, se.filter("result_id % 6 = 0"), vl.as_of_literal(AS_OF))
    new = ig.acknowledge(stored, se, se.filter("result_id % 3 = 0"), vl.as_of_literal(AS_OF))
    return od.alert_list(rv, se, acks=stored.unionByName(new))
