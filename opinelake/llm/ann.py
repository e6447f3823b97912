"""Nearest neighbours by a permutation index.

``PIVOTS`` sampled vectors are the pivots. A vector is represented by the order of its ``PREFIX`` nearest pivots and posted in the
inverted file of each of them, with its rank there. A query walks the inverted files of its own nearest pivots: every posting
adds PREFIX - |difference of ranks|, so that the sum orders the vectors by the footrule distance of the two prefixes, pivots
missing from one counting as rank PREFIX. The best ``KEEP`` of a block are reranked by their exact inner products.

The index is partitioned by vectors: blocks of ``BLOCK`` rows hold inverted files of their own, and queries, in blocks too, meet
every block. Tasks therefore have bounded memory, every row is indexed, and a block returns k rows per query. For inner products
of vectors of different lengths, data vectors get one more component that brings all to the same length (queries get a zero), so
that order by angle is order by inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX = 256, 64
KEEP_SHARE, KEEP_LEAST = 0.4, 400  # a group of alike vectors of a third of all rows is kept whole
BLOCK, QUERY_BLOCK = 8192, 16384


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: no null or non-finite component, not all zero."""
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return clean.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(
        ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    )


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector, nearest first; ties to the earlier pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """Per pivot the places of a block's vectors that have it in their prefix, and its rank there."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.prefix = orders.shape
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.place, self.rank = (by // self.prefix).astype(np.int64), (by % self.prefix).astype(np.int16)
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.size = n

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """For every vector: prefix squared less the footrule distance, up to a constant."""
        spans = [slice(self.start[p], self.start[p + 1]) for p in order]
        place = np.concatenate([self.place[s] for s in spans])
        gain = np.concatenate([self.prefix - np.abs(self.rank[s] - i) for i, s in enumerate(spans)])
        return np.bincount(place, gain, self.size)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))])


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, longest: float, k: int
) -> Iterator[pd.DataFrame]:
    """The k nearest of a block for each query, ids ascending among equals; a query's own row is left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    prefix = min(PREFIX, len(pivots))
    files = InvertedFiles(permutations(_lifted(vectors, longest), pivots, prefix), len(pivots))
    keep = min(len(ids), max(KEEP_LEAST, k + 1, int(KEEP_SHARE * len(ids))))
    lifted = np.column_stack([queries, np.zeros(len(queries))])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, (query_id, query, path) in enumerate(zip(query_ids, queries, permutations(lifted, pivots, prefix), strict=True)):
        # Stable sorts: of equal vectors the smaller ids come first, so ties are never cut at the wrong end.
        near = np.argsort(-files.closeness(path).astype(np.int16), kind="stable")[:keep]
        near = np.sort(near[ids[near] != query_id])
        score = np.einsum("ij,j->i", vectors[near], query)  # row by row alike: equal vectors have equal scores
        best = np.argsort(-score, kind="stable")[:k]
        out.append((np.full(len(best), query_id), ids[near[best]], score[best]))
        if len(out) == 4096 or q == len(queries) - 1:
            a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"query_id": a, "vec_id": b, "score": c})
            out = []


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each query, by inner product, ties to smaller ids.

    rows and queries: vec_id, embedding; more columns are ignored. Rows that are null, all zero or hold null or non-finite
    components take no part, nor do rows with a null vec_id. Vectors of different lengths have no inner product: a query meets the
    vectors of its own length, each length having an index of its own. Repeated rows are one; of different vectors of one vec_id
    that with the least components, in order, stands for it. A query's own vec_id is no candidate of it. No rows or no queries give
    no result.
    """
    data, asked = usable(rows), usable(queries)
    # The lengths of the queries' vectors: a few, the widths of the models that made them.
    widths = sorted(r["n"] for r in asked.select(F.size("embedding").alias("n")).distinct().collect())
    parts = [_nearest(*(x.filter(F.size("embedding") == n) for x in (data, asked)), k, pivots, block) for n in widths]
    found = [p for p in parts if p is not None]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _one_each(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per vec_id: the least of its vectors."""
    if not frame["vec_id"].duplicated().any():
        return frame
    order = sorted(range(len(frame)), key=lambda i: (frame["vec_id"].iat[i], tuple(frame["embedding"].iat[i])))
    return frame.iloc[order].drop_duplicates("vec_id")


def _nearest(data: DataFrame, asked: DataFrame, k: int, pivots: int, block: int) -> DataFrame | None:
    """The result for vectors of one length; None where there is nothing to search."""
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pivots).collect()  # a bounded sample
    n_queries = asked.count()
    if not picked or not n_queries:
        return None
    sums = data.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("far")).first()
    longest = float(np.sqrt(sums["far"]))
    points = _lifted(np.array([r["embedding"] for r in picked]), longest)
    blocks, query_blocks = -(-sums["n"] // block), -(-n_queries // QUERY_BLOCK)
    spread = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored_side = data.withColumn("block", spread(blocks)).withColumn("query_block", every(query_blocks))
    asking_side = asked.withColumn("query_block", spread(query_blocks)).withColumn("block", every(blocks))

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        one = [_one_each(f) for f in (left, right)]
        x, q = (np.stack(f["embedding"].to_numpy()) for f in one)
        return pd.concat(search_block(one[0]["vec_id"].to_numpy(), x, one[1]["vec_id"].to_numpy(), q, points, longest, k))

    keys = ["block", "query_block"]
    hits = stored_side.groupBy(*keys).cogroup(asking_side.groupBy(*keys)).applyInPandas(found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
