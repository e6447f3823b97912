"""Split, encoding, training, evaluation and topic queries."""

from __future__ import annotations

import hashlib

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake import schema as sm
from opinelake.functions import text as tx
from opinelake.functions import values as vl
from opinelake.operators import density as dn
from opinelake.operators import evaluation as ev
from opinelake.operators import learning as ln
from opinelake.operators import ranking as rk
from opinelake.operators import scoring as sc
from opinelake.operators import subwords as sw
from opinelake.operators import topics as tp
from opinelake.operators import training as tr
from opinelake.operators import zero_shot as zs
from opinelake.plans import dataset
from opinelake.queries.base import TXT, clean, n_if, pct, query, r, sql_list
from opinelake.queries.text import LEXICON, PHRASES, STOP
from opinelake.schema import CLASS_NAMES
from opinelake.session import checkpoint_root, shared_dir
from opinelake.sources import readers as rd
from opinelake.sources import star

N = range(3)
_SCORED = TXT + ", labelled AS (SELECT review_id, cleaned_text, predicted_sentiment AS sentiment_label FROM text_reviews JOIN text_sentiment USING (review_id))"


def _labelled(spark, sf) -> DataFrame:
    reviews, sentiment = star.text_reviews(spark, sf), star.text_sentiment(spark, sf)
    return reviews.join(sentiment, "review_id").select(
        "review_id", "cleaned_text", F.col("predicted_sentiment").alias("sentiment_label")
    )


def _split_sql(rel: str, key: str = "review_id", label: str = "sentiment_label") -> str:
    return f"""SELECT {key}, {label}, CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN rn <= floor(n * 0.9 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM (
SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat_ws(':', CAST({key} AS VARCHAR), '42')), {key}) AS rn, count(*) OVER (PARTITION BY {label}) AS n FROM {rel})"""


# --- L1, L4, L5, A7: splits and samples -----------------------------------------------------------

@query("stratified_split_l1", _SCORED + _split_sql("labelled"))
def _(spark, sf):
    out = rk.stratified_split(_labelled(spark, sf), "review_id", "sentiment_label")
    return out.select("review_id", "sentiment_label", "split")


@query("orders_split_l1", _split_sql("orders", "o_orderkey", "o_orderstatus"))
def _(spark, sf):
    orders = star.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return rk.stratified_split(orders, "o_orderkey", "o_orderstatus", classes=["F", "O", "P"])


@query("seeded_shuffle_l4", "SELECT doc_id, md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42')) AS shuffle_key FROM documents")
def _(spark, sf):
    return rk.seeded_shuffle(star.documents(spark, sf).select("doc_id"), "doc_id")


@query("seeded_sample_l5", "SELECT event_id, user_id FROM events ORDER BY md5(concat_ws(':', CAST(event_id AS VARCHAR), '42')), event_id LIMIT 500")
def _(spark, sf):
    return rk.seeded_sample(star.table(spark, sf, "events").select("event_id", "user_id"), "event_id", 500)


@query(
    "split_dataset_sink_a7",
    _SCORED + f"""SELECT review_id, sentiment_label, split, CAST(CASE sentiment_label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS INTEGER) AS label FROM (
{_split_sql("(SELECT * FROM labelled WHERE length(trim(cleaned_text)) >= 3 QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY review_id) = 1)")}) WHERE split = 'test'""",
)
def _(spark, sf):
    path = shared_dir(spark, "dataset")
    dataset.prepare(_labelled(spark, sf), "review_id", path)
    return rd.read_split(spark, f"{path}/splits", "test").select("review_id", "sentiment_label", "split", "label")


# --- L3: encoding ------------------------------------------------------------------------------------

# A tokenizer's vocabulary, given by its path: tokenizers are not trained here.
PIECES = "/opt/tokenizers/word_bpe_49k.json"


def _ids_sql(room: int, start: int, end: int) -> str:
    """Text of the ids and number of used places, from a relation ``ids`` (review_id, ids of the words)."""
    own = f"coalesce(ids, [])[1:{room}]"
    return f"""SELECT review_id, array_to_string(list_concat([{start}], {own}, [{end}], list_transform(range({room} - len({own})), lambda x: 0)), ',') AS input_ids,
  CAST(len({own}) + 2 AS INTEGER) AS used FROM text_reviews LEFT JOIN ids USING (review_id)"""


def _written_ids(encoded: DataFrame) -> DataFrame:
    used = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return encoded.select("review_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), used.alias("used"))


def _pieces_sql() -> str:
    """The pieces of each different word: all that fit at each place, the longest of them, and a walk along these."""
    room = sw.MAX_LENGTH - 2
    return TXT + f""", toks AS (SELECT review_id, list_filter(string_split(cleaned_text, ' '), lambda t: t <> '')[1:{room}] AS w FROM text_reviews),
pos AS (SELECT review_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM toks),
words AS (SELECT DISTINCT word FROM pos),
model AS (SELECT content FROM read_text('{PIECES}')),
entries AS (SELECT unnest(map_entries(CAST(json_extract(content, '$.model.vocab') AS MAP(VARCHAR, INTEGER)))) AS e FROM model),
added AS (SELECT unnest(CAST(json_extract(content, '$.added_tokens[*].content') AS VARCHAR[])) AS special FROM model),
vocab AS (SELECT e.key AS piece, e.value AS id FROM entries WHERE e.key NOT IN (SELECT replace(special, '"', '') FROM added)),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words),
parts AS (SELECT word, p, unnest(range(1, length(word) - p + 2)) AS n FROM places),
fits AS (SELECT word, p, n, id FROM (SELECT *, substr(word, p, n) || CASE WHEN p + n > length(word) THEN '</w>' ELSE '' END AS piece FROM parts) JOIN vocab USING (piece)),
best AS (SELECT word, p, max(n) AS n, arg_max(id, n) AS id FROM fits GROUP BY 1, 2),
walk AS (WITH RECURSIVE walk(word, p, ids) AS (
  SELECT word, CAST(1 AS BIGINT), CAST([] AS INTEGER[]) FROM words
  UNION ALL SELECT walk.word, walk.p + best.n, list_append(walk.ids, best.id) FROM walk JOIN best ON best.word = walk.word AND best.p = walk.p)
  SELECT word, ids FROM walk WHERE p = length(word) + 1),
ids AS (SELECT review_id, flatten(list(ids ORDER BY i)) AS ids FROM pos JOIN walk USING (word) GROUP BY 1)
""" + _ids_sql(room, 49406, 49407)


@query("token_encoding_l3", _pieces_sql())
def _(spark, sf):
    t = star.text_reviews(spark, sf).select("review_id", "cleaned_text")
    return _written_ids(sw.encode_subwords(t, "cleaned_text", sw.Pieces.load(PIECES)))


@query(
    "word_encoding_l3",
    TXT + f""", toks AS (SELECT review_id, list_filter(string_split(cleaned_text, ' '), lambda t: t <> '') AS w FROM text_reviews),
vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 3 AS id FROM (SELECT unnest(w) AS word FROM toks) GROUP BY 1 ORDER BY id LIMIT {ln.VOCABULARY_SIZE - ln.RESERVED}),
pos AS (SELECT review_id, unnest(w[1:{ln.MAX_LENGTH - 2}]) AS word, generate_subscripts(w[1:{ln.MAX_LENGTH - 2}], 1) AS i FROM toks),
ids AS (SELECT review_id, list(coalesce(id, 1) ORDER BY i) AS ids FROM pos LEFT JOIN vocab USING (word) GROUP BY 1)
""" + _ids_sql(ln.MAX_LENGTH - 2, ln.START, ln.END),
)
def _(spark, sf):
    t = rd.materialise(star.text_reviews(spark, sf).select("review_id", "cleaned_text"), shared_dir(spark, "cleaned"))  # read twice, cleaned once
    return _written_ids(ln.encode(t, "cleaned_text", ln.vocabulary(t, "cleaned_text")))


# --- L2, L12, H3, H7, U2: models ---------------------------------------------------------------------

def _cleaned(spark, sf) -> DataFrame:
    """Cleaned documents, stored: fits and scoring read them several times."""
    return rd.materialise(star.documents(spark, sf).select("doc_id", tx.clean_text("text").alias("cleaned_text")), shared_dir(spark, "cleaned"))


def _training(spark, sf, docs: DataFrame | None = None) -> DataFrame:
    docs = _cleaned(spark, sf) if docs is None else docs
    labels = star.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


_CONFIG = ln.TrainConfig()
_SCHEDULE = tr.Schedule()


@query("train_classifier_l2")
def _(spark, sf):
    docs = _cleaned(spark, sf)
    model = ln.train_classifier(_training(spark, sf, docs), _CONFIG)
    return model.transform(docs).select("doc_id", F.col("prediction").cast("int").alias("prediction"))


def _trained(spark, sf, docs: DataFrame | None = None) -> tr.Trained:
    """Epochs over the labelled documents of the training split, stopped by those of the validation split."""
    rows = rk.stratified_split(_training(spark, sf, docs).withColumn("name", F.col("label").cast("string")), "doc_id", "name", classes=["0", "1"])
    return tr.train_validated(rows, "doc_id", "cleaned_text", "label", schedule=_SCHEDULE)


@query("training_history_l2")
def _(spark, sf):
    return _trained(spark, sf).history


def _stored_model(spark, sf, docs: DataFrame | None = None) -> tuple[tr.TextModel, str, str]:
    """The model stored for these tables, its version and root; the first call trains and stores it."""
    root, version = checkpoint_root(spark), "v1-" + hashlib.sha256(sf.encode()).hexdigest()[:12]
    model = tr.load_model(spark, root, "quality", version)
    if model is None:
        tr.save_model(spark, _trained(spark, sf, docs).model, root, "quality", version, _SCHEDULE)
        model = tr.load_model(spark, root, "quality", version)
    return model, version, root


@query("model_inference_h3")
def _(spark, sf):
    docs = _cleaned(spark, sf)
    scored = tr.score_texts(docs, "cleaned_text", _stored_model(spark, sf, docs)[0])
    return sc.score_probabilities(scored, "cleaned_text").select("doc_id", *sc.SCORE_FIELDS)


@query("stored_model_registry_l12")
def _(spark, sf):
    model, version, root = _stored_model(spark, sf)
    rows = rk.stratified_split(_training(spark, sf).withColumn("name", F.col("label").cast("string")), "doc_id", "name", classes=["0", "1"])
    scored = tr.score_texts(rows.filter("split = 'test'"), "cleaned_text", model)
    guess = F.when(F.col("probabilities")[1] > F.col("probabilities")[0], 1).otherwise(0)
    metrics = ev.overall_metrics(scored.select(F.col("label").alias("true_id"), guess.alias("pred_id")))
    none = spark.createDataFrame([], sm.MODEL_VERSIONS)
    return ln.register_model(
        none, "quality", version, metrics, _SCHEDULE, vl.as_of_literal(star.AS_OF), notes=tr.model_path(root, "quality", version)
    ).select("model_name", "accuracy", "f1_score", F.size("parameters").alias("n_parameters"), (F.length("notes") > 0).alias("stored"))


def load_length_predictor():
    """Stand-in for a loaded model: the share of long words; raises for texts without words."""

    def predict(texts):
        out = []
        for t in texts:
            words = t.split()
            share = sum(len(w) > 4 for w in words) / len(words)
            if share > 0.9:
                raise ValueError("no prediction")
            out.append([1 - share, share])
        return out

    return predict


def _predicted_sql() -> str:
    from opinelake.queries.text import _lex_counts, _lex_sql, _two_class

    words = "list_filter(string_split(t, ' '), lambda w: w <> '')"
    two = _two_class("s", "(1 - s)")
    return f"""WITH d AS (SELECT doc_id, {clean('text')} AS t FROM documents),
c AS (SELECT *, {_lex_counts('t')}, len({words}) AS k, len(list_filter({words}, lambda w: length(w) > 4))::DOUBLE / greatest(len({words}), 1) AS s FROM d),
m AS (SELECT doc_id, {two}, TRUE AS model_loaded FROM c WHERE k > 0 AND s <= 0.9),
f AS (SELECT doc_id, {_lex_sql('t')}, FALSE AS model_loaded FROM c WHERE k > 0 AND s > 0.9)
SELECT * FROM m UNION ALL SELECT * FROM f UNION ALL SELECT doc_id, 'neutral', 0, 0, 1, 1, TRUE FROM c WHERE k = 0"""


@query("batched_callable_u2", _predicted_sql())
def _(spark, sf):
    docs = star.documents(spark, sf).select("doc_id", tx.clean_text("text").alias("cleaned_text"))
    out = sc.score_model(docs, "cleaned_text", load_length_predictor, **LEXICON)
    return out.select("doc_id", *sc.SCORE_FIELDS, "model_loaded")


def _zero_shot_sql() -> str:
    from opinelake.queries.base import hits

    rule = ", ".join(
        f"CASE WHEN {hits('t', p)} > {hits('t', n)} THEN '{a}=positive' WHEN {hits('t', n)} > {hits('t', p)} THEN '{a}=negative' WHEN {hits('t', p)} > 0 THEN '{a}=neutral' END"
        for a, (p, n) in PHRASES.items()
    )
    best = "CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END"
    shot = " || ',' || ".join(f"'{a}=' || {best}" for a in ("product_quality", "shipping", "battery"))
    return f"""SELECT doc_id, CASE WHEN greatest(p, n, u) >= 0.3 THEN {shot} WHEN len(m) > 0 THEN array_to_string(m, ',')
  ELSE 'product_quality=neutral,shipping=neutral,packaging=neutral' END AS aspects,
  CAST(CASE WHEN greatest(p, n, u) >= 0.3 THEN 3 ELSE 0 END AS INTEGER) AS num_aspects_detected, 8 AS total_aspects FROM (
SELECT doc_id, length(t) % 7 / 7::DOUBLE * 0.5 AS p, length(t) % 11 / 11::DOUBLE * 0.5 AS n, length(t) % 13 / 13::DOUBLE * 0.5 AS u,
  list_filter([{rule}], lambda z: z IS NOT NULL) AS m FROM (SELECT doc_id, lower(text) AS t FROM documents))"""


@query("zero_shot_aspects_h7", _zero_shot_sql())
def _(spark, sf):
    docs = star.documents(spark, sf).select("doc_id", "text")
    n = F.length("text")
    vector = F.array(*[(n % m) / float(m) * 0.5 for m in (7, 11, 13)])
    names = ["Product Quality", "Shipping", "Battery"]
    scored = docs.withColumn("scores", F.create_map(*[c for a in names for c in (F.lit(a), vector)]))
    out = sc.zero_shot_aspects(scored, "text", "scores", phrases=PHRASES)
    pairs = F.transform(F.map_entries("aspects"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("doc_id", F.array_join(pairs, ",").alias("aspects"), "num_aspects_detected", "total_aspects")


@query("trained_zero_shot_h7")
def _(spark, sf):
    docs = star.documents(spark, sf).select("doc_id", "text")
    scored = zs.aspect_scores(docs, "doc_id", "text", zs.fit_word_vectors(docs, "doc_id", "text"))
    out = sc.zero_shot_aspects(scored, "text", "scores")
    pairs = F.transform(F.map_entries("aspects"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("doc_id", F.array_join(pairs, ",").alias("aspects"), "num_aspects_detected", "total_aspects")


@query(
    "model_registry_l12",
    f"""SELECT 'm' AS model_name, 'v2' AS version, CAST((SELECT max(p_partkey) FROM part) + 1 AS INTEGER) AS version_id,
  {r('avg(CASE WHEN (quality + toxic) = doc_id % 3 THEN 1.0 ELSE 0 END)', 4)} AS accuracy FROM labels""",
)
def _(spark, sf):
    labels = star.table(spark, sf, "labels")
    pred = labels.select((F.col("quality") + F.col("toxic")).alias("true_id"), (F.col("doc_id") % 3).alias("pred_id"))
    metrics = ev.overall_metrics(pred)
    at = vl.as_of_literal(star.AS_OF)
    versions = star.table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("version_id"), F.lit("m").alias("model_name"), F.lit("v1").alias("version"),
        *[F.lit(0.5).alias(c) for c in ("accuracy", "f1_score", "precision", "recall")], at.alias("training_date"),
        F.create_map(F.lit("a"), F.lit("b")).alias("parameters"), F.lit("").alias("notes"), at.alias("created_at"),
    )
    new = ln.register_model(versions, "m", "v2", metrics, _CONFIG, at)
    again = ln.register_model(versions, "m", "v1", metrics, _CONFIG, at)
    return new.unionByName(again).select("model_name", "version", "version_id", "accuracy")


# --- L6-L11, F5: evaluation ------------------------------------------------------------------------

def _evaluated(spark, sf) -> DataFrame:
    return ev.predictions(star.evaluation(spark, sf))


_LOGIT = {i: f"(doc_id * {m} % 23) / 10::DOUBLE" for i, m in enumerate((7, 11, 13))}
_EVAL = f"""WITH l AS (SELECT doc_id AS id, quality + toxic AS true_id, text, {', '.join(f'{e} AS l{i}' for i, e in _LOGIT.items())} FROM labels JOIN documents USING (doc_id)),
s AS (SELECT *, {', '.join(f'exp(l{i} - greatest(l0, l1, l2)) AS e{i}' for i in N)} FROM l),
ev AS (SELECT id, true_id, text, {', '.join(f'e{i} / (e0 + e1 + e2) AS p{i}' for i in N)}, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS pred_id FROM s),
cm AS (SELECT {', '.join(f'{n_if(f"true_id = {t} AND pred_id = {p}")} AS m{t}{p}' for t in N for p in N)}, count(*) AS total FROM ev),
pc AS ({' UNION ALL '.join(f"SELECT {c} AS c, m{c}{c} AS tp, m0{c} + m1{c} + m2{c} AS pp, m{c}0 + m{c}1 + m{c}2 AS sup, total FROM cm" for c in N)}),
pr AS (SELECT *, CASE WHEN pp > 0 THEN tp::DOUBLE / pp ELSE 0 END AS precision, CASE WHEN sup > 0 THEN tp::DOUBLE / sup ELSE 0 END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM pr)
"""
_NAME = f"([{sql_list(CLASS_NAMES)}])[{{c}} + 1]"
_M3 = ("precision", "recall", "f1_score")


@query(
    "confusion_matrix_l6",
    _EVAL + " UNION ALL ".join(
        f"SELECT '{CLASS_NAMES[t]}' AS true_label, {', '.join(f'm{t}{p} AS pred_{CLASS_NAMES[p]}' for p in N)}, "
        f"{', '.join(pct(f'm{t}{p}', f'(m{t}0 + m{t}1 + m{t}2)', 1) + f' AS pct_{CLASS_NAMES[p]}' for p in N)} FROM cm"
        for t in N
    ),
)
def _(spark, sf):
    return ev.confusion_matrix(_evaluated(spark, sf))


_PER_CLASS = f"SELECT {_NAME.format(c='c')} AS label, {', '.join(f'{r(m, 4)} AS {m}' for m in _M3)}, sup AS support FROM f"
_OVERALL = ", ".join(f"{r(f'sum({m} * sup) / max(total)', 4)} AS {m}" for m in _M3)


@query("per_class_metrics_l7", _EVAL + _PER_CLASS)
def _(spark, sf):
    return ev.per_class_metrics(_evaluated(spark, sf))


@query(
    "overall_metrics_l7",
    _EVAL + f"""SELECT {r('sum(tp)::DOUBLE / max(total)', 4)} AS accuracy, {_OVERALL}, max(total) AS total_samples, CAST(sum(tp) AS BIGINT) AS correct_predictions,
  CAST(max(total) - sum(tp) AS BIGINT) AS incorrect_predictions FROM f""",
)
def _(spark, sf):
    return ev.overall_metrics(_evaluated(spark, sf))


@query(
    "classification_report_l8",
    _EVAL + _PER_CLASS
    + f" UNION ALL SELECT 'accuracy', {', '.join([r('sum(tp)::DOUBLE / max(total)', 4)] * 3)}, max(total) FROM f"
    + f" UNION ALL SELECT 'macro avg', {', '.join(r(f'avg({m})', 4) for m in _M3)}, max(total) FROM f"
    + f" UNION ALL SELECT 'weighted avg', {', '.join(r(f'sum({m} * sup) / max(total)', 4) for m in _M3)}, max(total) FROM f",
)
def _(spark, sf):
    return ev.classification_report(_evaluated(spark, sf))


_LONG = " UNION ALL ".join(f"SELECT {c} AS c, round(p{c}, 9) AS score, true_id = {c} AS pos FROM ev" for c in N)


def _rounded_scores(df: DataFrame) -> DataFrame:
    """Probabilities at 9 digits: ``exp`` may differ in the last bit between engines, which would split ties."""
    return df.withColumn("probabilities", F.transform("probabilities", lambda p: F.round(p, 9)))


@query(
    "roc_auc_l9",
    _EVAL + f""", long AS ({_LONG}), pairs AS (SELECT a.c, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u, count(*) AS n
FROM long a JOIN long b ON a.c = b.c AND a.pos AND NOT b.pos GROUP BY 1) SELECT {_NAME.format(c='c')} AS label, {r('u / n', 6)} AS roc_auc FROM pairs""",
)
def _(spark, sf):
    return ev.roc_auc(_rounded_scores(_evaluated(spark, sf)))


@query(
    "roc_points_l10",
    _EVAL + f""", g AS (SELECT c, score, {n_if('pos')} AS p, {n_if('NOT pos')} AS n FROM ({_LONG}) GROUP BY 1, 2)
SELECT {_NAME.format(c='c')} AS label, {r('fpr', 9)} AS fpr, {r('tpr', 9)} AS tpr, {r('score', 8)} AS threshold FROM (SELECT c, score, sum(n) OVER w / sum(n) OVER (PARTITION BY c) AS fpr,
  sum(p) OVER w / sum(p) OVER (PARTITION BY c) AS tpr FROM g WINDOW w AS (PARTITION BY c ORDER BY score DESC))""",
)
def _(spark, sf):
    out = ev.roc_points(_rounded_scores(_evaluated(spark, sf)))
    return out.select("label", *[vl.rounded(c, 9).alias(c) for c in ("fpr", "tpr")], vl.rounded("threshold", 8).alias("threshold"))


@query(
    "outcome_counts_l11",
    _EVAL + f"""SELECT {n_if('true_id = pred_id')} AS correct, {n_if('true_id <> pred_id')} AS incorrect, count(*) AS total,
  {pct(n_if('true_id <> pred_id'), 'count(*)', 2)} AS misclassification_rate FROM ev""",
)
def _(spark, sf):
    return ev.outcome_counts(_evaluated(spark, sf))


@query(
    "misclassified_f5",
    _EVAL + f""", w AS (SELECT * FROM ev WHERE true_id <> pred_id)
SELECT id, text[1:200] AS text, {_NAME.format(c='true_id')} AS true_label, {_NAME.format(c='pred_id')} AS predicted_label, {r('greatest(p0, p1, p2)', 4)} AS confidence,
  {', '.join(f'{r(f"p{i}", 4)} AS p_{CLASS_NAMES[i]}' for i in N)}, (SELECT count(*) FROM w) AS total_misclassified FROM w ORDER BY round(greatest(p0, p1, p2), 9) DESC, id LIMIT 20""",
)
def _(spark, sf):
    out = ev.misclassified(_rounded_scores(_evaluated(spark, sf)))
    return out.select(
        "id", "text", "true_label", "predicted_label", "confidence", *[F.col("probabilities")[n].alias(f"p_{n}") for n in CLASS_NAMES],
        "total_misclassified",
    )


# --- L13-L16: topics ---------------------------------------------------------------------------------

@query("topic_model_fit_l13")
def _(spark, sf):
    # Cleaned texts and assignments are read several times each: stored once in the shared folder.
    t = rd.materialise(star.text_reviews(spark, sf).select("review_id", "cleaned_text"), shared_dir(spark, "cleaned"))
    model = tp.fit_topics(t, "cleaned_text", k=5, features=1 << 10)
    assigned = rd.materialise(tp.assign_topics(t, model, min_topic_size=15), shared_dir(spark, "assigned"))
    out = tp.topic_report(assigned, "cleaned_text", "review_id", STOP)
    return out.select("topic_id", "count", "percentage", "name", F.size("keywords").alias("n_keywords"), F.size("representative_docs").alias("n_docs"))


@query("topic_assignment_l14")
def _(spark, sf):
    vectors = star.table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("vector"))
    fitted = tp.assign_topics(vectors, tp.fit_vector_topics(vectors, "vector", k=10)).select("vec_id", "topic_id")
    unfitted = tp.assign_topics(vectors, None).select("vec_id", F.col("topic_id").alias("unfitted"))
    return fitted.join(unfitted, "vec_id")


@query("density_topics_l13")
def _(spark, sf):
    t = rd.materialise(star.text_reviews(spark, sf).select("review_id", "cleaned_text"), shared_dir(spark, "cleaned"))
    vectors = rd.materialise(tp.text_vectors(t, tp.fit_text_vectors(t, "cleaned_text")), shared_dir(spark, "vectors"))
    model = dn.fit_density(vectors, "review_id", "vector")
    assigned = rd.materialise(dn.fitted_topics(vectors, "vector", model).drop("vector"), shared_dir(spark, "assigned"))
    out = tp.topic_report(assigned, "cleaned_text", "review_id", STOP)
    return out.select("topic_id", "count", "percentage", "outlier_count", "name", F.size("keywords").alias("n_keywords"), F.size("representative_docs").alias("n_docs"))


@query("density_assignment_l14")
def _(spark, sf):
    vectors = star.table(spark, sf, "embeddings").select("vec_id", "embedding")
    model = dn.fit_density(vectors, "vec_id", "embedding")
    both = dn.assign_density(dn.fitted_topics(vectors, "embedding", model).withColumnRenamed("topic_id", "fitted"), "vec_id", "embedding", model)
    return both.select("vec_id", "fitted", F.col("topic_id").alias("assigned"))


def _ngram_sql() -> str:
    words = f"list_filter(regexp_extract_all(cleaned_text, '\\b(\\w\\w+)\\b', 1), lambda w: w NOT IN ({sql_list(STOP)}))"
    return TXT + f""", w AS (SELECT review_id, lang, {words} AS w FROM text_reviews),
terms AS (SELECT review_id, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
vocab AS (SELECT term, count(DISTINCT review_id) AS doc_freq FROM terms GROUP BY 1 HAVING count(DISTINCT review_id) BETWEEN 5 AND (SELECT count(*) FROM w) * 0.8)
"""


@query("ngram_vocabulary_l16", _ngram_sql() + "SELECT term, doc_freq FROM vocab")
def _(spark, sf):
    return tp.ngram_vocabulary(star.text_reviews(spark, sf), "cleaned_text", STOP)


@query(
    "topic_keywords_l15",
    _ngram_sql() + f""", tf AS (SELECT lang, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2),
a AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM tf GROUP BY lang)),
s AS (SELECT lang, term, {r('tf * ln(1 + (SELECT a FROM a) / sum(tf) OVER (PARTITION BY term))', 4)} AS score FROM tf)
SELECT lang, term, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS INTEGER) AS position FROM s
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) <= 10""",
)
def _(spark, sf):
    weights = tp.class_tf_idf(star.text_reviews(spark, sf), "cleaned_text", "lang", STOP)
    return tp.topic_keywords(weights, "lang", 10)
