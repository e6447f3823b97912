"""Aspect scores from learned word vectors."""

import random

from opinelake.operators import scoring as sc
from opinelake.operators import zero_shot as zs

THINGS = {"battery": ["battery", "charge", "runtime"], "shipping": ["shipping", "delivery", "courier"]}
# Only the first words of each list occur in the phrases; the others are learned.
SIDES = {"positive": ["great", "good", "superb", "stellar", "long", "fast"], "negative": ["poor", "slow", "dreadful", "late", "short", "dismal"]}


def corpus(spark, n=3000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(3):
            thing, side = rng.sample(THINGS[rng.choice(list(THINGS))], 2), rng.sample(SIDES[rng.choice(list(SIDES))], 3)
            parts.append(f"the {side[0]} {thing[0]} is {side[1]} and the {thing[1]} was {side[2]}")
        rows.append((i, ". ".join(parts) + "."))
    return spark.createDataFrame(rows, "id long, text string")


def test_planted_sentences_by_unlisted_words(spark):
    vectors = zs.fit_word_vectors(corpus(spark), "id", "text")
    planted, truth = [], []
    for thing, names in THINGS.items():
        for side, words in (("positive", ["superb", "stellar"]), ("negative", ["dreadful", "dismal"])):
            for name in names:
                for a, b in (words, words[::-1]):
                    planted.append((len(planted), f"The {a} {name}, {b}"))
                    truth.append((thing, side))
    df = spark.createDataFrame(planted, "id long, text string")
    scored = sc.zero_shot_aspects(zs.aspect_scores(df, "id", "text", vectors), "text", "scores")
    rows = scored.orderBy("id").collect()
    right = sum(r["aspects"].get(thing) == side for r, (thing, side) in zip(rows, truth))
    assert right >= 0.8 * len(truth)
    assert all(set(r["aspects"]) <= {"battery", "shipping"} for r in rows if r["num_aspects_detected"])
    again = zs.fit_word_vectors(corpus(spark).repartition(3), "id", "text")
    assert sorted(map(tuple, again.table.collect())) == sorted(map(tuple, vectors.table.collect()))


def test_odd_texts_have_no_scores(spark):
    vectors = zs.fit_word_vectors(corpus(spark, 200), "id", "text")
    rows = [(1, None, 0), (2, "", 1), (3, "???", 2), (4, "qqq zzz", 3), (None, "superb battery", 4)]
    df = spark.createDataFrame(rows, "id long, text string, word int")
    out = {r["word"]: r["scores"] for r in zs.aspect_scores(df, "id", "text", vectors).collect()}
    assert out == {i: {} for i in range(5)}
    none = zs.fit_word_vectors(df.limit(0), "id", "text")
    assert none.table.count() == 0
    assert {len(r["scores"]) for r in zs.aspect_scores(df, "id", "text", none).collect()} == {0}


def test_long_text_speaks_by_its_closest_sentence(spark):
    vectors = zs.fit_word_vectors(corpus(spark), "id", "text")
    text = "nothing to see here. " * 5000 + "the dismal battery was dreadful. " + "more of nothing! " * 5000
    df = spark.createDataFrame([(1, text)], "id long, text string")
    scores = zs.aspect_scores(df, "id", "text", vectors).first()["scores"]["Battery"]
    assert scores[1] == max(scores) and scores[1] > 0.3
