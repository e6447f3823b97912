"""Density clustering of vectors: topics of any shape, with outliers that belong to none.

1. Equal vectors become one weighted point.
2. A forest of median cuts deals the points into leaves; tasks cut these on to at most ``leaf`` points and find the nearest
   neighbours there. Up to ``leaf`` points the neighbours are exact; beyond, the trees are merged by the smallest distances.
3. A point's core distance is the radius that holds ``min_samples`` rows, itself included. An edge to a neighbour weighs the largest
   of the distance and the two core distances.
4. Parts of the graph are joined at a ladder of radii (quantiles of the edge weights). A part of ``min_size`` rows is a cluster; it
   lives on until two clusters meet. Its mass is the sum of rows * (1 / radius - 1 / next radius) over the ladder.
5. From the top, a cluster is taken when its mass is at least that of the best clusters inside it. Other rows are outliers.

This is the hierarchy of density clustering (Campello, Moulavi and Sander 2013) on the neighbour graph, read at ``levels`` radii.
A part of the graph without an edge to the others may be a cluster as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinelake.operators.ranking import hash_rank, seeded_sample
from opinelake.operators.topics import OUTLIER
from opinelake.session import shared_dir
from opinelake.sources.readers import materialise

BINS = 512  # radii are told apart to 1 / BINS of an octave
TIE = 1 + 1e-9
_NEAR = "array<struct<d: double, other: long, weight: long>>"


@dataclass(frozen=True)
class Settings:
    """``task_rows`` points are searched per task while the sample has 16 rows per leaf (200 million points by default);
    beyond, leaves grow with the points unless ``sample_rows`` does."""

    min_size: int = 15
    min_samples: int = 15
    levels: int = 12
    leaf: int = 2048
    trees: int = 4
    task_rows: int = 50_000
    sample_rows: int = 65_536
    seed: int = 42


@dataclass(frozen=True)
class Forest:
    """Median cuts fitted on a bounded sample: per tree one (direction, cut) per inner node, in heap order."""

    directions: np.ndarray  # trees x nodes x width
    cuts: np.ndarray  # trees x nodes
    depth: int
    width: int


@dataclass(frozen=True)
class DensityModel:
    """``points`` (stored): point, vector, weight, core, cluster (null for outliers), radius at which the cluster begins, topic_id."""

    points: DataFrame
    forest: Forest
    settings: Settings


# --- forest --------------------------------------------------------------------------------------

def _direction(seed: int, *place: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, *place]).standard_normal(width)


def _sample(points: DataFrame, s: Settings, width: int) -> np.ndarray:
    """The vectors of at most ``sample_rows`` points, the first ones in hash order: found by a cut point, so no task and no driver
    sorts candidates, and fetched as bytes, one partition after the other."""

    @F.pandas_udf(T.BinaryType())
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float64).tobytes() for v in vectors], dtype=object)

    rows = _store(seeded_sample(points, "point", s.sample_rows, s.seed).select(packed("vector").alias("vector")), "sample")
    out = np.empty((min(s.sample_rows, rows.count()), width))  # keys that repeat may pass the cut point together
    for i, r in enumerate(islice(rows.toLocalIterator(), len(out))):
        out[i] = np.frombuffer(r[0], np.float64)
    return out


def _fit_forest(points: DataFrame, s: Settings, width: int, total: int) -> Forest:
    """Cuts at the medians of at most ``sample_rows`` points, the first ones in hash order."""
    depth = 0
    while total >> depth > s.task_rows and (s.sample_rows >> depth) >= 32:
        depth += 1
    nodes, trees = (1 << depth) - 1, s.trees if total > s.leaf else 1
    directions, cuts = np.zeros((trees, nodes, width)), np.zeros((trees, nodes))
    if depth:
        sample = _sample(points, s, width)
        for tree in range(trees):
            place = np.zeros(len(sample), dtype=np.int64)
            for node in range(nodes):
                directions[tree, node] = _direction(s.seed, tree, node, width=width)
                here = place == node
                side = sample[here] @ directions[tree, node]
                cuts[tree, node] = np.median(side) if len(side) else 0.0
                place[here] = 2 * node + 1 + (side > cuts[tree, node])
    return Forest(directions, cuts, depth, width)


def _leaves(vector: str, forest: Forest) -> Column:
    """The leaf of a vector in each tree."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def route(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy())
        found = np.zeros((len(x), len(forest.cuts)), dtype=np.int32)
        for tree in range(len(forest.cuts)):
            place = np.zeros(len(x), dtype=np.int64)
            for _ in range(forest.depth):
                side = np.einsum("ij,ij->i", x, forest.directions[tree][place])
                place = 2 * place + 1 + (side > forest.cuts[tree][place])
            found[:, tree] = place
        return pd.Series(list(found))

    return route(F.col(vector))


def _blocks(x: np.ndarray, ids: np.ndarray, leaf: int, seed: tuple[int, ...]):
    """Row numbers in blocks of at most ``leaf``: halves along random directions."""
    stack = [(np.arange(len(x)), 0)]
    while stack:
        rows, node = stack.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        side = x[rows] @ _direction(*seed, node, width=x.shape[1])
        order = rows[np.lexsort((ids[rows], side))]
        half = len(order) // 2
        stack += [(order[:half], 2 * node + 1), (order[half:], 2 * node + 2)]


def _closest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, base: np.ndarray, k: int):
    """The ``k`` nearest other base rows of each query row, by (distance, id): a shortlist by inner products, measured again
    coordinate by coordinate, so that a pair has the same distance in every tree and in both directions. Yields query rows, how many
    each has found, and their base rows and distances, one after the other."""
    centre = x[base].mean(axis=0)
    b = x[base] - centre
    norms = np.einsum("ij,ij->i", b, b)
    wide = min(len(base), k + 16)
    step = max(1, min(512, (1 << 20) // (wide * x.shape[1])))  # rows whose shortlists are held as vectors: 8 MB
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        q = x[part] - centre
        rough = norms[None, :] - 2 * (q @ b.T)
        rough[part[:, None] == base[None, :]] = np.inf
        short = np.argpartition(rough, wide - 1, axis=1)[:, :wide] if wide < len(base) else np.tile(np.arange(len(base)), (len(part), 1))
        near = base[short]
        d = np.sqrt(((x[near] - x[part][:, None, :]) ** 2).sum(axis=2))
        own = near == part[:, None]  # comes last, and is left out
        order = np.lexsort((ids[near], d, own), axis=-1)[:, :k]
        counts = np.minimum(k, wide - own.sum(axis=1))
        kept = np.arange(order.shape[1]) < counts[:, None]
        yield part, counts, np.take_along_axis(near, order, 1)[kept], np.take_along_axis(d, order, 1)[kept]


def _listed(counts: np.ndarray, d: np.ndarray, other: np.ndarray, weight: np.ndarray) -> pa.Array:
    """Neighbours that stand one after the other, as lists of so many each."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d), pa.array(other), pa.array(weight)], ["d", "other", "weight"]))


def _first(near: pa.ListArray, k: int) -> pa.Array:
    """The ``k`` nearest of each list by (distance, id), each once; a pair has the same distance wherever it was found."""
    counts = near.value_lengths().to_numpy(zero_copy_only=False)
    fields = near.flatten()
    d, other, weight = (fields.field(i).to_numpy() for i in range(3))
    lists = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((other, d, lists))
    lists, d, other, weight = lists[order], d[order], other[order], weight[order]
    new = np.ones(len(lists), bool)
    new[1:] = (lists[1:] != lists[:-1]) | (d[1:] != d[:-1]) | (other[1:] != other[:-1])
    lists, d, other, weight = lists[new], d[new], other[new], weight[new]
    sizes = np.bincount(lists, minlength=len(counts))
    kept = np.arange(len(lists)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
    return _listed(np.minimum(sizes, k), d[kept], other[kept], weight[kept])


def _nearest(points: DataFrame, forest: Forest, s: Settings) -> DataFrame:
    """(point, near): nearest other points with ``fitted`` true, of those with ``wanted`` true. One row per point and tree is
    shuffled; a task returns at most ``min_samples`` neighbours a point, never the pairs of a leaf."""

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.concatenate([c.flatten().to_numpy() for c in rows["vector"].chunks]).reshape(len(rows), -1)
        ids, weights, fitted, wanted = (rows[c].to_numpy() for c in ("point", "weight", "fitted", "wanted"))
        found = []
        for block in _blocks(x, ids, s.leaf, (s.seed, key[0].as_py(), key[1].as_py() + 1)):
            queries, base = block[wanted[block]], block[fitted[block]]
            if len(queries) and len(base):
                for part, counts, near, d in _closest(x, ids, queries, base, s.min_samples):
                    found.append(pa.table([pa.array(ids[part]), _listed(counts, d, ids[near], weights[near])], ["point", "near"]))
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.int64()), _listed(*(np.empty(0, t) for t in (int, float, int, int)))], ["point", "near"])

    @F.arrow_udf(_NEAR)
    def merged(near: pa.Array) -> pa.Array:
        return _first(near, s.min_samples)

    placed = points.withColumn("_leaves", _leaves("vector", forest)).select("*", F.posexplode("_leaves").alias("tree", "place"))
    found = placed.drop("_leaves").groupBy("tree", "place").applyInArrow(search, f"point long, near {_NEAR}")
    return found.groupBy("point").agg(F.flatten(F.collect_list("near")).alias("near")).withColumn("near", merged("near"))


def _core(s: Settings) -> Column:
    """Smallest radius around a point that holds ``min_samples`` rows; null where its neighbours are fewer."""
    start = F.struct(
        F.col("weight").alias("n"), F.when(F.col("weight") >= s.min_samples, F.lit(0.0)).otherwise(F.lit(None).cast("double")).alias("r")
    )

    def add(acc, e):
        n = acc["n"] + e["weight"]
        return F.struct(n.alias("n"), F.coalesce(acc["r"], F.when(n >= s.min_samples, e["d"])).alias("r"))

    return F.aggregate("near", start, add)["r"]


# --- graph ---------------------------------------------------------------------------------------

def _store(df: DataFrame, purpose: str) -> DataFrame:
    return materialise(df, shared_dir(df.sparkSession, purpose))


def _points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct usable vectors: point (the smallest key), weight (rows). Nulls and non-finite numbers take no part."""
    bad = F.exists(F.col("vector"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = df.select(F.col(key).cast("long").alias("_k"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad & F.col("_k").isNotNull()
    )
    # 0.0 and -0.0 are one number.
    return usable.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0))).groupBy("vector").agg(
        F.min("_k").alias("point"), F.count("*").alias("weight")
    )


def _edges(points: DataFrame) -> DataFrame:
    """(a, b, w), a < b: each neighbour pair once, with its mutual reachability."""
    listed = points.select(F.col("point").alias("_p"), F.col("core").alias("_c"), F.inline("near")).drop("weight")
    other = points.select(F.col("point").alias("other"), F.col("core").alias("_o"))
    return (
        listed.filter(F.col("_c").isNotNull())
        .join(other.filter(F.col("_o").isNotNull()), "other")
        .groupBy(F.least("_p", "other").alias("a"), F.greatest("_p", "other").alias("b"))
        .agg(F.min(F.greatest("d", "_c", "_o")).alias("w"))
    )


def _ladder(edges: DataFrame, levels: int) -> list[float]:
    """Ascending radii that hold equal shares of the edges, read from counts per weight bin (an exact count at any size); the
    last one holds all edges."""
    counts = edges.groupBy(F.floor(F.log2("w") * BINS).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    if not counts:
        return []
    ends = np.cumsum([c["n"] for c in counts])
    picks = sorted({int(np.searchsorted(ends, ends[-1] * (i + 1) / levels - 1e-9)) for i in range(levels)})
    return [float(2.0 ** ((counts[min(p, len(counts) - 1)]["bin"] + 1) / BINS)) for p in picks]


def _merge(edges: DataFrame, parts: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Joins parts along edges below the radius: each part hooks to its smallest neighbour, hooks are followed two steps, and the
    edges are contracted. The smallest of its neighbours' numbers falls in every round, so at last only roots remain."""
    while not edges.filter(F.col("w") < radius).isEmpty():
        short = edges.filter(F.col("w") < radius)
        hooks = short.groupBy(F.col("b").alias("part")).agg(F.min("a").alias("to"))  # a < b: hooks always point down
        for _ in range(2):
            step = hooks.select(F.col("part").alias("to"), F.col("to").alias("_next"))
            hooks = hooks.join(step, "to", "left").select("part", F.coalesce("_next", "to").alias("to"))
        hooks = _store(hooks, "hooks")
        ends = [hooks.select(F.col("part").alias(c), F.col("to").alias(f"_{c}")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w"
        )
        edges = _store(
            moved.filter(F.col("a") != F.col("b"))
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.min("w").alias("w")),
            "edges",
        )
        parts = parts.join(hooks, "part", "left").select("point", "weight", F.coalesce("to", "part").alias("part"))
    return edges, _store(parts, "parts")


def _weigh(parts: DataFrame, below: DataFrame | None, gain: float, min_size: int) -> DataFrame:
    """Clusters of a level: rows, children, ``own`` mass since the last meeting of two clusters and mass of the best ones inside."""
    sizes = parts.groupBy("part").agg(F.sum("weight").alias("rows")).filter(F.col("rows") >= min_size)
    if below is None:
        return sizes.select("part", "rows", (F.col("rows") * gain).alias("own"), F.lit(0.0).alias("inside"))
    # A part is named by one of its points, so its part on this level is that of the point.
    up = parts.select(F.col("point").alias("_child"), F.col("part"))
    kids = (
        below.withColumnRenamed("part", "_child").join(up, "_child").groupBy("part")
        .agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_{c}") for c in ("own", "inside")],
             F.sum(F.greatest("own", "inside")).alias("_best"))
    )
    alone = F.col("n") == 1
    return sizes.join(kids, "part", "left").select(
        "part", "rows", (F.col("rows") * gain + F.when(alone, F.col("_own")).otherwise(0.0)).alias("own"),
        F.when(alone, F.col("_inside")).when(F.col("n") > 1, F.col("_best")).otherwise(0.0).alias("inside"),
    )


def _choose(levels: list[tuple[DataFrame, DataFrame, float]]) -> DataFrame:
    """(point, cluster, radius) of the points inside chosen clusters; from the largest radius down."""
    chosen, above = [], None
    for parts, clusters, radius in reversed(levels):
        good = F.col("own") * TIE >= F.col("inside")
        if above is None:
            state = clusters.select("part", good.alias("taken"), good.alias("closed"))
        else:
            up = above[0].select(F.col("point").alias("part"), F.col("part").alias("_up"))
            closed = above[1].select(F.col("part").alias("_up"), F.col("closed").alias("_closed"))
            state = clusters.join(up, "part").join(closed, "_up").select(
                "part", (good & ~F.col("_closed")).alias("taken"), (good | F.col("_closed")).alias("closed")
            )
        state = _store(state, "chosen")
        chosen.append(
            parts.join(state.filter("taken").select("part"), "part").select(
                "point", F.col("part").alias("cluster"), F.lit(radius).alias("radius")
            )
        )
        above = parts, state
    return reduce(DataFrame.unionByName, chosen)


def _numbered(clusters: DataFrame, seed: int) -> DataFrame:
    """cluster -> topic_id: 0 is the largest; equal sizes in hash order. The window has one row per distinct size."""
    ranked = hash_rank(clusters, "cluster", seed, ["rows"], out="_rank")
    bigger = Window.partitionBy(F.lit(0)).orderBy(F.desc("rows")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = clusters.groupBy("rows").agg(F.count("*").alias("_n")).select(
        "rows", F.coalesce(F.sum("_n").over(bigger), F.lit(0)).alias("_before")
    )
    return ranked.join(offsets, "rows").select("cluster", (F.col("_rank") + F.col("_before") - 1).cast("int").alias("topic_id"))


# --- interface -------------------------------------------------------------------------------------

def fit_density(df: DataFrame, key: str, vector: str, settings: Settings = Settings()) -> DensityModel:
    """Clusters the vectors of ``df``; ``key`` is an integer id.

    Rows without a key, without a vector or with null or non-finite numbers are outliers, as are vectors of another length than the
    commonest (ties: the shorter), which have no distance to the rest. Repeated rows count as often as they occur.
    """
    s = settings
    distinct = _store(_points(df, key, vector), "points")
    lengths = distinct.groupBy(F.size("vector").alias("width")).agg(F.sum("weight").alias("rows"), F.count("*").alias("n"))
    widest = lengths.orderBy(F.desc("rows"), "width").first()
    width, total = (widest["width"], widest["n"]) if widest else (0, 0)
    points = distinct.filter(F.size("vector") == width)
    forest = _fit_forest(points, s, width, total)
    flagged = points.withColumns({"fitted": F.lit(True), "wanted": F.lit(True)})
    near = F.coalesce("near", F.array().cast(_NEAR))
    cored = _store(
        points.join(_nearest(flagged, forest, s), "point", "left").withColumn("near", near).withColumn("core", _core(s)), "cores"
    )
    edges = _store(_edges(cored), "edges")
    parts = cored.select("point", "weight", F.col("point").alias("part"))
    radii = _ladder(edges, s.levels)
    levels, below = [], None
    # Without any edge the points stand alone at radius zero.
    for radius, larger in zip(radii or [0.0], (radii[1:] + [None]) if radii else [None]):
        edges, parts = _merge(edges, parts, radius)
        gain = 1 / radius - 1 / larger if larger else 0.0
        below = _store(_weigh(parts, below, gain, s.min_size), "clusters")
        levels.append((parts, below, radius))
    member = _choose(levels)
    sizes = member.join(points.select("point", "weight"), "point").groupBy("cluster").agg(F.sum("weight").alias("rows"))
    labelled = member.join(_numbered(_store(sizes, "sizes"), s.seed), "cluster")
    done = cored.select("point", "vector", "weight", "core").join(labelled, "point", "left")
    return DensityModel(_store(done.withColumn("topic_id", F.coalesce("topic_id", F.lit(OUTLIER))), "density"), forest, s)


def fitted_topics(df: DataFrame, vector: str, model: DensityModel) -> DataFrame:
    """The rows the model was fitted on with their ``topic_id``; -1 for outliers and unusable vectors."""
    known = model.points.filter(F.col("topic_id") != OUTLIER)
    return _with_topic(df, vector, known.select(F.col("vector").alias("_v"), F.col("topic_id").alias("_t")))


def _with_topic(df: DataFrame, vector: str, placed: DataFrame) -> DataFrame:
    same = F.transform(F.col(vector).cast("array<double>"), lambda v: v + F.lit(0.0))
    return (
        df.withColumn("_same", same).join(placed, F.col("_same") == F.col("_v"), "left")
        .withColumn("topic_id", F.coalesce("_t", F.lit(OUTLIER))).drop("_same", "_v", "_t")
    )


def assign_density(df: DataFrame, key: str, vector: str, model: DensityModel | None) -> DataFrame:
    """Adds ``topic_id`` to new rows with an integer ``key`` of their own.

    A new vector takes the topic of the fitted point it reaches at the smallest radius (the largest of their distance and both core
    distances; ties: the smaller point), if that lies below the radius at which the topic begins. Otherwise, without a model, and
    for vectors the fit would leave out, it is -1.
    """
    if model is None:
        return df.withColumn("topic_id", F.lit(OUTLIER))
    s, known = model.settings, model.points
    # Equal new vectors are placed once.
    new = _points(df, key, vector).filter(F.size("vector") == model.forest.width).withColumn("weight", F.lit(1).cast("long"))
    both = known.select("point", "vector", "weight", F.lit(True).alias("fitted"), F.lit(False).alias("wanted")).unionByName(
        new.select("point", "vector", "weight", F.lit(False).alias("fitted"), F.lit(True).alias("wanted"))
    )
    found = _nearest(both, model.forest, s).withColumn("weight", F.lit(1).cast("long")).withColumn("_core", _core(s))
    reach = (
        found.filter(F.col("_core").isNotNull())
        .select(F.col("point").alias("_new"), "_core", F.inline(F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["other"].alias("point")))))
        .join(known.filter(F.col("core").isNotNull()).select("point", "core", "radius", "topic_id"), "point")
        .groupBy("_new")
        .agg(F.min(F.struct(F.greatest("d", "_core", "core").alias("w"), "point", "radius", "topic_id")).alias("_to"))
        .filter(F.col("_to.w") < F.col("_to.radius"))
    )
    placed = new.join(reach, F.col("point") == F.col("_new")).select(F.col("vector").alias("_v"), F.col("_to.topic_id").alias("_t"))
    return _with_topic(df, vector, placed)
