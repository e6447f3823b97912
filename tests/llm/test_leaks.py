"""Decontamination of short items against brute force, and the pipeline's stage on rows that share an id; vectors of two lengths."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from opinelake.llm import ann, decontaminate

WORDS = [f"w{i}" for i in range(14)]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def matched(doc, item):
    """Whether an item leaks into a document, by trying every shift."""
    if not doc or not item:
        return False
    if len(item) < decontaminate.SHORT_WORDS:
        return doc == item
    if len(item) < decontaminate.LEAST_WORDS:
        return any(doc[i : i + len(item)] == item for i in range(len(doc) - len(item) + 1))
    n = len(item)
    for shift in range(-n, len(doc)):
        flags = [0 <= shift + j < len(doc) and doc[shift + j] == item[j] for j in range(n)]
        if any(all(flags[i : i + 8]) for i in range(n - 7)):
            return True
    return False


def test_short_items_against_brute_force(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    items = [text(n) for n in (1, 2, 3, 4, 4, 5, 6, 7, 8, 12)] + [None, "", "?!"]
    docs = [text(int(rng.integers(0, 60))) for _ in range(150)] + [None, ""]
    for it in items[:10]:
        docs += [it, f"{text(9)} {it.upper()}, {text(9)}", f"{text(2)} {it}"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, words string")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, seed int").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if matched(words(d), words(t))}
    # Longer items also match by 80 % of a stretch.
    assert {x for x in got if len(words(items[x[1]])) < 8} == {x for x in want if len(words(items[x[1]])) < 8}
    assert want <= got and len(want) >= 20


def test_stage_judges_each_row_by_its_text(spark, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog and runs far away from here into the deep dark wood"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"intro {passage} outro", "en"), (1, "a clean text of its own that says nothing", "en"), (2, "other words stand here", "en"), (None, passage, None), (None, "clean without an id", None), (2, "other words stand here", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:11]) for r in got) == [(0, "clean witho"), (1, "a clean tex"), (2, "other words"), (2, "other words")]
    assert docs.columns == got[0].__fields__


def test_nearest_of_two_lengths(spark):
    """The longest vector is a pivot; each query meets the vectors of its own length."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3 if i % 4 else 5).tolist()) for i in range(200)] + [(500, [1.0] * 9), (7, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0 OR vec_id = 7"), 4, pivots=300).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    one = {}
    for i, v in rows:
        one[i] = min(one.get(i, v), v)
    for q in [*range(0, 200, 20), 7, 500]:
        near = sorted((-float(np.dot(one[q], v)), i) for i, v in one.items() if i != q and len(v) == len(one[q]))
        assert got.get(q, []) == [i for _, i in near[:4]]
