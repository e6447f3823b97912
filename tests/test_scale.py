"""Operators that split hot groups, against brute force on skewed data."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opinelake.operators import evaluation as ev
from opinelake.operators import joins as jn
from opinelake.operators import ranking as rk
from opinelake.operators import windows as wn
from opinelake.operators.dedupe import duplicate_counts, keep_first
from opinelake.operators.integrity import unique_violations


def skewed_events(n, seed):
    """One key holds half of the rows; time has gaps, ties and crowded days."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 600, 3600, 40 * 3600])
        rows.append(("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", t, i, rng.random() < 0.4))
    return rows


def brute_force_spikes(rows, window, threshold):
    history, out = defaultdict(list), set()
    for key, _, i, neg in sorted(rows, key=lambda r: (r[1], r[2])):
        history[key].append(neg)
        last = history[key][-window:]
        if len(last) == window and sum(last) / window >= threshold:
            out.add((key, i, round(sum(last) / window, 6)))
    return out


@pytest.mark.parametrize(
    "seed,window,slice_rows", [(1, 10, 75), (2, 10, 10), (3, 4, 3), (4, 25, 4), (5, 10, 10**6), (6, 10, 600)]
)
def test_sliced_spikes_equal_brute_force(spark, seed, window, slice_rows):
    rows = skewed_events(600, seed)
    df = spark.createDataFrame(rows, "k string, t long, i long, neg boolean").withColumn("ts", F.timestamp_seconds("t"))
    out = wn.spikes(df, "k", "ts", "i", F.col("neg"), window, 0.3, slice_rows=slice_rows).collect()
    assert {(r["k"], r["i"], round(r["negative_ratio"], 6)) for r in out} == brute_force_spikes(rows, window, 0.3)
    assert len(out) == len({(r["k"], r["i"]) for r in out})


@pytest.mark.parametrize("slice_rows", [10, 50, 10**6])
def test_spike_windows_with_null_times_and_keys(spark, slice_rows):
    rows = [(None if i % 3 == 0 else "a", None if i in (5, 60, 90, 91) else i * 7 % 200, i, i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, i long, neg boolean").withColumn("ts", F.timestamp_seconds("t"))
    history, expected = defaultdict(list), set()
    for k, _, i, neg in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        history[k].append(neg)
        if len(history[k]) >= 10:
            expected.add((k, i, sum(history[k][-10:]) / 10))
    out = wn.negative_windows(df, "k", "ts", "i", F.col("neg"), slice_rows=slice_rows).collect()
    assert {(r["k"], r["i"], r["negative_ratio"]) for r in out} == expected and len(out) == len(expected)


def test_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(10)], "i long, g string")
    got = [(r["g"], r["rank"]) for r in rk.hash_rank(df, "i", 1, ["g"]).collect()]
    assert sorted(got, key=str) == sorted([(g, n) for g in ("a", None) for n in range(1, 6)], key=str)


def test_latest_spikes(spark):
    rows = skewed_events(600, 5)
    df = spark.createDataFrame(rows, "k string, t long, i long, neg boolean").withColumn("ts", F.timestamp_seconds("t"))
    last = {r[0]: r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))}
    expected = {(k, ratio) for k, i, ratio in brute_force_spikes(rows, 10, 0.3) if last[k] == i}
    got = {(r["k"], round(r["negative_ratio"], 6)) for r in wn.latest_spikes(df, "k", "ts", "i", F.col("neg")).collect()}
    assert got == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"))
    small = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = big.join(small, "k", how).orderBy("id").collect()
    assert jn.salted_join(big, small, "k", "id", how, salts=5).orderBy("id").collect() == plain


def test_salted_join_rejects_outer_on_the_replicated_side(spark):
    with pytest.raises(ValueError):
        jn.salted_join(spark.range(1), spark.range(1), "id", "id", "full")


@pytest.mark.parametrize("how", ["left_anti", "left"])
def test_salted_copies_are_broadcast_by_their_real_number(spark, how):
    small = spark.range(200_000).select(F.col("id").alias("k"))  # 1.6 MB once, beyond the broadcast limit in 16 copies
    plan = jn.salted_join(spark.range(10).select("id", F.col("id").alias("k")), small, "k", "id", how)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_all_products_are_kept_once(spark):
    products = spark.createDataFrame([("a",), ("b",)], "product_id string")
    reviews = spark.createDataFrame([(1, "a"), (2, "a")], "review_id long, product_id string")
    sentiment = spark.createDataFrame([(1, "positive")], "review_id long, predicted_sentiment string")
    rows = {(r["product_id"], r["review_id"], r["predicted_sentiment"]) for r in jn.all_products_records(products, reviews, sentiment).collect()}
    assert rows == {("a", 1, "positive"), ("a", 2, None), ("b", None, None)}


def split_frame(spark, n=1000):
    label = F.when(F.col("id") % 10 < 5, "positive").when(F.col("id") % 10 < 8, "negative").otherwise("neutral")
    return spark.range(n).select(F.col("id"), label.alias("sentiment_label"))


def test_stratified_split_is_an_exact_partition(spark):
    df = split_frame(spark)
    out = rk.stratified_split(df, "id", "sentiment_label").collect()
    assert sorted(r["id"] for r in out) == list(range(1000))
    counts = defaultdict(int)
    for r in out:
        counts[(r["sentiment_label"], r["split"])] += 1
    for label, n in (("positive", 500), ("negative", 300), ("neutral", 200)):
        assert [counts[(label, s)] for s in ("train", "validation", "test")] == [n * 8 // 10, n // 10, n // 10]


@pytest.mark.parametrize("hex_digits", [1, 2, 4])
def test_split_does_not_depend_on_the_bucket_count(spark, hex_digits):
    df = split_frame(spark, 300)
    base = {r["id"]: r["split"] for r in rk.stratified_split(df, "id", "sentiment_label").collect()}
    assert {r["id"]: r["split"] for r in rk.stratified_split(df, "id", "sentiment_label", hex_digits=hex_digits).collect()} == base


def test_split_keeps_rows_of_tiny_and_unknown_classes(spark):
    df = spark.createDataFrame([(1, "positive"), (2, "odd"), (3, "odd2"), (4, None)], "id long, sentiment_label string")
    assert rk.stratified_split(df, "id", "sentiment_label").count() == 4


def test_split_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        rk.stratified_split(split_frame(spark), "id", "sentiment_label", train=0.9)


@pytest.mark.parametrize("n", [1, 17, 300, 999])
def test_seeded_sample_has_exact_size_and_repeats(spark, n):
    df = spark.range(300)
    first = {r["id"] for r in rk.seeded_sample(df, "id", n).collect()}
    assert len(first) == min(n, 300) and first == {r["id"] for r in rk.seeded_sample(df.repartition(3), "id", n).collect()}


def test_hash_rank_is_dense_per_group(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("x"))
    rows = rk.hash_rank(df, "id", 1, ["g"], hex_digits=1).collect()
    for g in ("hot", "x"):
        ranks = sorted(r["rank"] for r in rows if r["g"] == g)
        assert ranks == list(range(1, len(ranks) + 1))


def test_seeded_shuffle_is_a_total_order_for_any_partition_count(spark):
    df = spark.range(200)
    orders = [[r["id"] for r in rk.seeded_shuffle(df, "id", partitions=p).collect()] for p in (1, 3, 8)]
    assert orders[0] == orders[1] == orders[2] and orders[0] != sorted(orders[0])


def test_copies_of_a_text_are_spread_by_further_columns(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = rk.seeded_shuffle(df, ["text", "id"], partitions=8).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 200


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_running_totals(spark, slices, descending):
    rng = random.Random(slices)
    rows = [(g, rng.random(), rng.randrange(9)) for g in ("a", "b") for _ in range(100)]
    df = spark.createDataFrame(rows, "g string, x double, v long")
    got = {(r["g"], r["x"]): r["cum_v"] for r in rk.running_totals(df, ["g"], "x", ["v"], slices, descending).collect()}
    for g, x, _ in rows:
        assert got[(g, x)] == sum(v for h, y, v in rows if h == g and (y >= x if descending else y <= x))


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_auc_with_ties_equals_pair_counting(spark, slices):
    rng = random.Random(7)
    rows = []
    for _ in range(150):
        p = [rng.randrange(1, 6) / 10 for _ in range(3)]
        rows.append((rng.randrange(3), p))
    df = spark.createDataFrame(rows, "true_id int, probabilities array<double>")
    got = {r["label"]: r["roc_auc"] for r in ev.roc_auc(df, slices).collect()}
    for c, name in enumerate(("negative", "neutral", "positive")):
        pos = [p[c] for t, p in rows if t == c]
        neg = [p[c] for t, p in rows if t != c]
        pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[name] == pytest.approx(pairs / len(pos) / len(neg), abs=1e-6)


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = keep_first(df, "text", ["id"])
    assert out.filter("text = 'hot'").first()["id"] == 0 and out.count() == 201
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_duplicates_count_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "text string")
    assert tuple(duplicate_counts(df).first()) == (5, 2, 2)
    assert unique_violations(df, ["text"]).collect()[0]["copies"] == 2
