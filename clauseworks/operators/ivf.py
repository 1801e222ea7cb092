"""Vectors by lists: centroids are trained by k-means, each vector is filed under the nearest, and a search reads the
lists near its query. Lists are folders of a partitioned table, so that the others are not even opened.

With ``exact`` a search goes on to all lists that may hold a better vector: a list knows the greatest angle between its
centroid and a vector of its own, and by the triangle inequality on angles no vector is nearer to the query than the
centroid's angle less that. Vectors that are null or have no length are in list -1, which no search reads.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.operators import dense

#: Vectors that centroids are trained from, at most.
SAMPLE = 200_000


def _unit(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / dense.norm(vector))


def train(vectors: DataFrame, lists: int, rounds: int = 10, seed: int = 7, sample: int = SAMPLE) -> list[list[float]]:
    """Centroids of length 1, ``lists`` at most, of (id, vector); those of a bounded sample, taken by hash of the id."""
    good = vectors.where(F.col("vector").isNotNull() & (dense.norm(F.col("vector")) > 0))
    n = good.count()
    if not n:
        return []
    share = max(1, math.ceil(n / sample))
    some = good.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else good
    model = KMeans(k=lists, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(some.select(array_to_vector(_unit(F.col("vector"))).alias("features")))
    centers = [np.asarray(c) for c in model.clusterCenters()]
    return [(c / np.linalg.norm(c)).tolist() for c in centers if np.linalg.norm(c) > 0]


def filed(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """``vectors`` with ``list``, the nearest centroid, and ``near``, the cosine to it."""
    size = dense.norm(F.col("vector"))
    book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    near = F.transform(book, lambda c, i: F.struct((dense.dot(F.col("vector"), c) / size).alias("near"), (-i).alias("list")))
    at = F.when(size > 0, F.array_max(near))
    out = vectors.withColumn("_at", at)
    return out.withColumn("list", F.coalesce(-F.col("_at.list"), F.lit(-1))).withColumn("near", F.col("_at.near")).drop("_at")


def list_stats(filed_vectors: DataFrame) -> DataFrame:
    """(list, n, least): how many vectors each list has, and the least cosine to its centroid."""
    return filed_vectors.where("list >= 0").groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("least"))


def order_of_lists(centroids: list[list[float]], query: list[float]) -> list[tuple[int, float]]:
    """(list, cosine) of all centroids, nearest first."""
    size = math.sqrt(sum(x * x for x in query))
    cos = [sum(a * b for a, b in zip(c, query, strict=True)) / size for c in centroids]
    return sorted(enumerate(cos), key=lambda x: (-x[1], x[0]))


def bound(cosine: float, least: float) -> float:
    """The greatest cosine between a query and a vector of a list: of the query to the centroid, and the list's least."""
    apart, wide = math.acos(max(-1.0, min(1.0, cosine))), math.acos(max(-1.0, min(1.0, least)))
    return math.cos(max(0.0, apart - wide))


def search(vectors: DataFrame, centroids: list[list[float]], stats: DataFrame, query: list[float], k: int, probes: int, exact: bool = False, met: dict | None = None) -> DataFrame:
    """(id, score) of at least the ``k`` best of ``probes`` lists, or, if ``exact``, of all. ``met`` gets the lists read."""
    if not centroids or not any(query):
        return dense.cosine_scores(vectors, query)
    order = order_of_lists(centroids, query)
    read = [i for i, _ in order[:probes]]
    if exact:
        least = {r["list"]: r["least"] for r in stats.collect()}  # one row a list
        begun = dense.cosine_scores(vectors.where(F.col("list").isin(read)), query).orderBy(F.desc("score")).limit(k).collect()
        worst = begun[-1]["score"] if len(begun) == k else -1.0
        read += [i for i, c in order[probes:] if i in least and bound(c, least[i]) >= worst - 1e-9]
    if met is not None:
        met |= {"lists": len(centroids), "read": sorted(read)}
    return dense.cosine_scores(vectors.where(F.col("list").isin(read)), query)
