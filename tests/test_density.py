"""Density clustering against a plain version on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinelake.operators import density as dn
from opinelake.operators import ranking as rk

S = dn.Settings(min_size=12, min_samples=5, levels=6)


def blobs(seed, sizes, width=6, noise=60):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((len(sizes), width)) * 6
    parts = [c + rng.standard_normal((n, width)) * (0.3 + 0.25 * i) for i, (c, n) in enumerate(zip(centres, sizes))]
    return np.vstack([*parts, rng.uniform(-14, 14, (noise, width))]), centres


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


def brute(x, s):
    """The same definition with full distance matrices and union by loops."""
    points, first, weight = np.unique(x, axis=0, return_index=True, return_counts=True)
    order = np.argsort(first)
    points, first, weight = points[order], first[order], weight[order]
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    near, core = [], np.full(n, np.nan)
    for i in range(n):
        ranked = sorted((d[i, j], first[j], j) for j in range(n) if j != i)[: s.min_samples]
        near.append([j for _, _, j in ranked])
        count = weight[i]
        core[i] = 0.0 if count >= s.min_samples else np.nan
        for dist, _, j in ranked:
            count += weight[j]
            if np.isnan(core[i]) and count >= s.min_samples:
                core[i] = dist
    edges = {}
    for i in range(n):
        for j in near[i]:
            if not np.isnan(core[i]) and not np.isnan(core[j]):
                edges[min(i, j), max(i, j)] = max(d[i, j], core[i], core[j])
    bins = np.sort(np.floor(np.log2(np.array(list(edges.values()))) * dn.BINS))
    radii = []
    for level in range(s.levels):
        at = int(np.ceil(len(bins) * (level + 1) / s.levels - 1e-9)) - 1
        radius = 2.0 ** ((bins[at] + 1) / dn.BINS)
        if radius not in radii:
            radii.append(radius)
    levels = []
    for radius in radii:
        part = list(range(n))
        for (a, b), w in edges.items():
            if w < radius and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
        levels.append(part)

    def members(level, p):
        return [i for i in range(n) if levels[level][i] == p]

    def mass(level, p):
        inside = members(level, p)
        rows = sum(weight[i] for i in inside)
        gain = 1 / radii[level] - 1 / radii[level + 1] if level + 1 < len(radii) else 0.0
        kids = []
        if level:
            for q in sorted({levels[level - 1][i] for i in inside}):
                if sum(weight[i] for i in members(level - 1, q)) >= s.min_size:
                    kids.append(mass(level - 1, q))
        own, best, chosen = rows * gain, 0.0, []
        if len(kids) == 1:
            own, best, chosen = own + kids[0][0], kids[0][1], kids[0][2]
        elif kids:
            best, chosen = sum(max(k[0], k[1]) for k in kids), [c for k in kids for c in k[2]]
        return own, best, [inside] if own * dn.TIE >= best else chosen

    out = set()
    for p in sorted(set(levels[-1])):
        if sum(weight[i] for i in members(len(radii) - 1, p)) >= s.min_size:
            out |= {frozenset(c) for c in mass(len(radii) - 1, p)[2]}
    return {frozenset(int(first[i]) for i in c) for c in out}


def clusters(model):
    rows = model.points.filter("topic_id >= 0").groupBy("cluster").agg(F.collect_list("point").alias("p")).collect()
    return {frozenset(r["p"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    x, _ = blobs(seed, [60, 40, 30])
    x = np.vstack([x, np.repeat(x[:2], 20, axis=0)])  # copies of two rows
    found = dn.fit_density(frame(spark, x), "id", "v", S)
    expected = brute(x, S)
    assert len(expected) >= 2 and clusters(found) == expected


def test_finds_groups_and_outliers_and_places_new_rows(spark):
    x, centres = blobs(3, [80, 60, 40])
    df = frame(spark, x)
    model = dn.fit_density(df, "id", "v", dn.Settings(min_samples=5))
    topics = {r["id"]: r["topic_id"] for r in dn.fitted_topics(df, "v", model).collect()}
    truth = [range(80), range(80, 140), range(140, 180)]
    tops = []
    for group in truth:
        values = [topics[i] for i in group if topics[i] >= 0]
        assert len(values) >= 0.8 * len(group) and len(set(values)) == 1
        tops.append(values[0])
    assert len(set(tops)) == 3
    assert np.mean([topics[i] == -1 for i in range(180, 240)]) > 0.8
    new = frame(spark, np.vstack([centres, centres + 100]), start=0)  # ids may be those of fitted rows
    placed = [r["topic_id"] for r in dn.assign_density(new, "id", "v", model).orderBy("id").collect()]
    assert placed == [*tops, -1, -1, -1]
    assert {r["topic_id"] for r in dn.assign_density(new, "id", "v", None).collect()} == {-1}


def test_forest_keeps_the_groups(spark):
    """Small leaves and tasks: neighbours are approximate, the groups are the same."""
    x, _ = blobs(4, [500, 400, 300], noise=0)
    s = dn.Settings(min_size=40, min_samples=5, levels=4, leaf=128, task_rows=400, trees=6)
    model = dn.fit_density(frame(spark, x), "id", "v", s)
    assert model.forest.depth == 2
    found = sorted(clusters(model), key=min)
    whole = [range(500), range(500, 900), range(900, 1200)]
    for group in whole:
        inside = [c for c in found if len(c & set(group)) > len(c) / 2]
        assert inside and all(c <= set(group) for c in inside)
        assert sum(map(len, inside)) > 0.6 * len(group)


def test_forest_sample_is_the_first_in_hash_order_and_sorts_nothing_on_the_driver(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((300, 3))
    points = frame(spark, x).select(F.col("id").alias("point"), F.col("v").alias("vector"))
    s = dn.Settings(sample_rows=64, leaf=16, task_rows=200)
    order = rk.seeded_hash("point", s.seed)
    first = sorted(tuple(r["vector"]) for r in points.orderBy(order, "point").limit(64).collect())
    monkeypatch.setattr(type(points), "orderBy", lambda *a: pytest.fail("sorted for the driver"))
    forest = dn._fit_forest(points, s, 3, 300)
    assert sorted(map(tuple, dn._sample(points, s, 3).tolist())) == first and forest.depth == 1
    side = [np.dot(v, forest.directions[0, 0]) for v in first]
    assert forest.cuts[0, 0] == pytest.approx(np.median(side))


def test_odd_input(spark):
    schema = "id long, v array<double>, topic string"
    odd = [(1, None, "a"), (2, [], "b"), (3, [1.0, None], "c"), (4, [1.0, float("nan")], "d"), (None, [1.0, 2.0], "e"), (5, [1.0], "f")]
    rows = [(10 + i, [0.0 if i % 2 else -0.0, 3.0], "g") for i in range(20)] + odd
    df = spark.createDataFrame(rows, schema)
    model = dn.fit_density(df, "id", "v", S)
    got = {(r["id"], r["topic"]): r["topic_id"] for r in dn.fitted_topics(df, "v", model).collect()}
    assert all(got[10 + i, "g"] == 0 for i in range(20))  # one point of twenty rows
    assert all(got[i, t] == -1 for i, _, t in odd)
    empty = spark.createDataFrame([], schema)
    none = dn.fit_density(empty, "id", "v", S)
    assert dn.fitted_topics(empty, "v", none).count() == 0
    assert {r["topic_id"] for r in dn.assign_density(df, "id", "v", none).collect()} == {-1}


@pytest.mark.parametrize("k", [4, 300])
def test_neighbours_are_sorted_by_blocks_not_by_rows(k, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (200, 3)).astype(float)  # many equal distances
    ids = rng.permutation(1000)[:200]
    sort, calls = np.lexsort, []
    monkeypatch.setattr(np, "lexsort", lambda *a, **kw: calls.append(1) or sort(*a, **kw))
    base = np.arange(0, 200, 2)
    found = {}
    for part, counts, near, d in dn._closest(x, ids, np.arange(200), base, k):
        at = 0
        for row, n in zip(part, counts):
            found[row] = [(float(d[i]), int(ids[near[i]])) for i in range(at, at + n)]
            at += n
        assert at == len(near) == len(d)
    assert len(found) == 200 and len(calls) < 10
    for row in range(200):
        own = sorted((float(np.sqrt(((x[b] - x[row]) ** 2).sum())), int(ids[b])) for b in base if b != row)
        got = found[row]
        assert got == sorted(got) and len(got) == min(k, len(own))
        assert [d for d, _ in got] == [d for d, _ in own[:k]]  # of equal distances the shortlist may hold others


def test_lists_of_trees_are_merged_by_distance_then_id():
    rng = np.random.default_rng(7)
    rows = [[{"d": o % 5 / 2, "other": int(o), "weight": 1 + int(o) % 3} for o in rng.integers(0, 40, n)] for n in (0, 1, 60, 7, 0)]
    near = dn.pa.array(rows, dn.pa.list_(dn.pa.struct([("d", dn.pa.float64()), ("other", dn.pa.int64()), ("weight", dn.pa.int64())])))
    plain = [sorted({(e["d"], e["other"], e["weight"]) for e in r})[:6] for r in rows]
    for part in (near, near.slice(1, 3), near.slice(0, 0)):
        want = plain if len(part) == 5 else plain[1:4] if len(part) else []
        assert [[(e["d"], e["other"], e["weight"]) for e in r] for r in dn._first(part, 6).to_pylist()] == want


def test_trees_are_merged_without_comparing_all_pairs(spark):
    points = frame(spark, np.eye(4)).selectExpr("id AS point", "v AS vector", "1L AS weight", "true AS fitted", "true AS wanted")
    plan = dn._nearest(points, dn._fit_forest(points, S, 4, 4), S)._jdf.queryExecution().toString()
    assert "array_distinct" not in plan
