"""Exact ranks, seeded splits and running totals without a one-task window.

A window over a whole group puts the group into one task. Here the group is cut into buckets first;
only per-bucket counts (a few thousand rows) are accumulated in one place, and a full row order is
only built inside single buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinelake.schema import SENTIMENT_LABELS


def seeded_hash(key: str | Sequence[str], seed: int) -> Column:
    """Repeatable pseudo-random order key of one or more columns."""
    keys = [key] if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def _bucket_offsets(df: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Rows per (group, bucket) and rows of the group in earlier buckets."""
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*group, bucket)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns of the same names that takes nulls as equal; the left ones are kept."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(named, same).drop(*[f"_r_{c}" for c in on])


def hash_rank(
    df: DataFrame, key: str, seed: int, group: Sequence[str] = (), hex_digits: int = 3, out: str = "rank"
) -> DataFrame:
    """Exact 1..n rank per group in seeded hash order.

    ``16 ** hex_digits`` evenly filled buckets per group: 3 digits give 4096 sorting tasks.
    """
    group = list(group)
    tagged = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substring("_h", 1, hex_digits))
    offsets = _bucket_offsets(tagged, group, "_b").select(*group, "_b", "_before")
    inside = Window.partitionBy(*group, "_b").orderBy("_h", key)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .transform(lambda ranked: _join_null_safe(ranked, offsets, [*group, "_b"]))
        .withColumn(out, F.col("_rn") + F.col("_before"))
        .drop("_h", "_b", "_rn", "_before")
    )


def _cuts(df: DataFrame, key: str, seed: int, group: list[str], targets: Column, hex_digits: int) -> DataFrame:
    """For each target rank of each group the (hash, key) pair that stands at that rank.

    ``targets`` is an array expression over ``_total``. Only the buckets that hold a target
    are sorted: one bucket in ``16 ** hex_digits`` per target. Callers keep the number of groups
    bounded, so the wanted buckets are a handful of rows and safe to broadcast.
    """
    slim = df.select(*group, key).withColumn("_h", seeded_hash(key, seed))
    slim = slim.withColumn("_b", F.substring("_h", 1, hex_digits))
    totals = Window.partitionBy(*(group or [F.lit(0)]))
    wanted = (
        _bucket_offsets(slim, group, "_b")
        .withColumn("_total", F.sum("_n").over(totals))
        .select("*", F.posexplode(targets).alias("_i", "_t"))
        .filter((F.col("_t") > F.col("_before")) & (F.col("_t") <= F.col("_before") + F.col("_n")))
        .select(*group, "_b", "_i", (F.col("_t") - F.col("_before")).alias("_within"))
    )
    buckets = wanted.select(*group, "_b").distinct()
    ranked = slim.join(F.broadcast(buckets), [*group, "_b"], "left_semi").withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    )
    return (
        ranked.join(F.broadcast(wanted), [*group, "_b"])
        .filter(F.col("_rn") == F.col("_within"))
        .select(*group, "_i", F.struct("_h", F.col(key).alias("_k")).alias("_cut"))
    )


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    classes: Sequence[str] = tuple(SENTIMENT_LABELS),
    train: float = 0.8,
    validation: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    hex_digits: int = 3,
) -> DataFrame:
    """Adds ``split`` (train / validation / test), exact per label, every row exactly once.

    Per label the rows in seeded hash order up to rank floor(n * train) are the training part, and
    so on. The rows themselves are never shuffled: two cut points per label are found from bucket
    counts, and the split is a projection that compares each row with them. ``classes`` bounds the
    cut table that is broadcast; labels outside the list form one further stratum.
    """
    if abs(train + validation + test - 1.0) >= 1e-6:
        raise ValueError("Ratios must sum to 1")
    targets = F.array(
        *[F.floor(F.col("_total") * F.lit(share) + F.lit(1e-9)).cast("long") for share in (train, train + validation)]
    )
    df = df.withColumn("_stratum", F.when(F.col(label).isin(*classes), F.col(label)).otherwise(F.lit("")))
    cuts = _cuts(df, key, seed, ["_stratum"], targets, hex_digits)
    wide = cuts.groupBy("_stratum").agg(
        F.max(F.when(F.col("_i") == 0, F.col("_cut"))).alias("_c0"),
        F.max(F.when(F.col("_i") == 1, F.col("_cut"))).alias("_c1"),
    )
    here = F.struct(seeded_hash(key, seed).alias("_h"), F.col(key).alias("_k"))
    split = F.when(here <= F.col("_c0"), "train").when(here <= F.col("_c1"), "validation").otherwise("test")
    return df.join(F.broadcast(wide), "_stratum", "left").withColumn("split", split).drop("_stratum", "_c0", "_c1")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42, hex_digits: int = 3) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer): the first n in seeded hash order.

    A filter against one cut point, so the sample is not gathered in one task.
    """
    cut = _cuts(df, key, seed, [], F.array(F.least(F.lit(n), F.col("_total")).cast("long")), hex_digits)
    here = F.struct(seeded_hash(key, seed).alias("_h"), F.col(key).alias("_k"))
    return df.withColumn("_cut", cut.select("_cut").scalar()).filter(here <= F.col("_cut")).drop("_cut")


def seeded_shuffle(df: DataFrame, key: str | Sequence[str], seed: int = 42, partitions: int | None = None) -> DataFrame:
    """All rows in a repeatable random total order, independent of the number of partitions.

    The order key is uniform, so equal ranges of it are balanced partitions. They are assigned
    directly: a global sort would compute the input twice, once only to sample its range bounds.
    Rows with equal ``key`` columns stay together, so give columns that tell copies of a text apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)
    return (
        df.withColumn("shuffle_key", seeded_hash(keys, seed))
        .repartitionById(n, F.floor(share).cast("int"))
        .sortWithinPartitions("shuffle_key", *keys)
    )


def quantile_slices(df: DataFrame, order: str, slices: int, out: str) -> DataFrame:
    """Adds a slice number: about equal numbers of rows per slice, ascending with the numeric ``order``.

    The bounds are approximate quantiles from one pass over the column, an array of ``slices - 1`` numbers.
    """
    probabilities = [i / slices for i in range(1, slices)]
    bounds = sorted(set(df.approxQuantile(order, probabilities, 0.5 / slices))) if probabilities else []
    if not bounds:  # one slice asked for, or no rows
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=order, outputCol=out).transform(df)


def running_totals(
    df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], slices: int = 256, descending: bool = False
) -> DataFrame:
    """Adds ``cum_<value>``: the sum of all rows up to and including this one, by a numeric ``order``.

    ``order`` must be unique within the group (aggregate ties first). It is cut into slices at
    approximate quantiles (a bounded array); totals of earlier slices are added to the sums inside a slice.
    """
    group = list(group)
    sliced = quantile_slices(df, order, slices, "_s")
    if descending:
        sliced = sliced.withColumn("_s", -F.col("_s"))
    by = F.desc(order) if descending else F.asc(order)
    inside = Window.partitionBy(*group, "_s").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*group, "_s").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    totals = totals.select(
        *group, "_s", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    out = _join_null_safe(sliced, totals, [*group, "_s"])
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(inside) + F.col(f"_b_{v}"))
    return out.drop("_s", *[f"_b_{v}" for v in values])
