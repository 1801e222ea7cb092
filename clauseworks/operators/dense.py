"""Search by cosine similarity, in the JVM: exact, or by eight-bit codes first and then exact."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the codes choose, for each that is wanted.
OVERSAMPLING = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _size(query: list[float]) -> float:
    return math.sqrt(sum(float(x) * float(x) for x in query))


def _fits(vector: Column, query: list[float]) -> Column:
    return F.assert_true(F.size(vector) == len(query), F.lit("the vectors have another dimension than the query"))


def cosine_scores(vectors: DataFrame, query: list[float], id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(id, score): vectors without length, or null, are left out; one of another length is an error."""
    size = _size(query)
    if not size:
        return vectors.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    q = F.lit([float(x) for x in query])
    v = F.col(vector)
    found = vectors.where(v.isNotNull()).select(F.col(id_col).alias("id"), dot(v, q).alias("_dot"), norm(v).alias("_norm"), _fits(v, query).alias("_fits"))
    return found.where((F.col("_norm") > 0) & F.col("_fits").isNull()).select("id", (F.col("_dot") / (F.col("_norm") * F.lit(size))).alias("score"))


#: Vectors, and queries, that meet in one task.
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 1_024


def search_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (qid, rank, id, score) of vectors (id, vector) for each of queries (qid, vector), in one job.

    Blocks of vectors meet blocks of queries as matrix products, and give the ``k`` best of each query and block; of
    these Spark keeps the ``k`` best in each task before a query's rows are shuffled. Queries or vectors that are null
    or have no length take no part; equal scores go to the smaller id.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    sound = lambda d: d.where(F.col("vector").isNotNull() & (norm(F.col("vector")) > 0))
    vectors, queries = sound(vectors), sound(queries)
    n, q = (max(1, math.ceil(d.count() / size)) for d, size in ((vectors, BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    left = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("part"))
    right = queries.select("qid", F.col("vector").alias("q"), F.pmod(F.xxhash64("qid"), F.lit(q)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))

    def product(rows: pa.Table, asked: pa.Table) -> pa.Table:
        x, y = (np.stack([np.array(v, np.float64) for v in t[c].to_pylist()]) if t.num_rows else np.empty((0, 0)) for t, c in ((rows, "vector"), (asked, "q")))
        if not (len(x) and len(y)):
            return pa.table({"qid": asked["qid"].slice(0, 0), "id": rows["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        order = pc.sort_indices(rows["id"])
        scores = np.round(y @ x[order.to_numpy()].T, 9)
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # of equal scores the smaller ids
        who = np.repeat(np.arange(len(y)), at.shape[1])
        best = at.ravel()
        return pa.table({"qid": asked["qid"].take(pa.array(who)), "id": rows["id"].take(order.take(pa.array(best))), "score": pa.array(scores[who, best])})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(product, f"qid {queries.schema['qid'].dataType.simpleString()}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


#: Bins of a pass over values, and how many values are left when they are sorted.
BINS = 65_536
FEW = 10_000


def exact_quantile(values: DataFrame, quantile: float) -> float | None:
    """The least of the values (x: double, null ones aside) that so large a share of them does not exceed; NaN is greatest.

    Each pass counts values by bin between the bounds that are left, and goes on with the bin that holds the rank: a bin
    is a row, and no more than ``FEW`` values are ever sorted.
    """
    values = values.where(F.col("x").isNotNull())
    whole = values.agg(F.count("*").alias("n"), F.count_if(F.isnan("x")).alias("nan"), F.min("x").alias("lo"), F.max(F.when(~F.isnan("x"), F.col("x"))).alias("hi")).first()
    n, lo, hi = whole["n"], whole["lo"], whole["hi"]
    if not n:
        return None
    rank = max(1, math.ceil(Fraction(str(quantile)) * n))  # from 1
    if rank > n - whole["nan"]:
        return math.nan
    some = values.where(~F.isnan("x"))
    left = n - whole["nan"]
    while lo < hi:
        inside = some.where(F.col("x").between(lo, hi))
        if left <= FEW:
            return inside.orderBy("x").limit(rank).agg(F.max("x").alias("x")).first()["x"]
        # halves, as the difference of the two may be no double
        place = F.floor(F.coalesce(F.try_divide(F.col("x") / 2 - lo / 2, F.lit(hi / 2 - lo / 2)), F.lit(0.0)) * BINS)
        bins = inside.groupBy(F.when(F.col("x") == hi, BINS).otherwise(F.least(place, F.lit(BINS - 1))).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for row in sorted(bins.collect(), key=lambda r: r["bin"]):  # ``BINS`` rows
            if rank <= row["n"]:
                lo, hi, left = row["lo"], row["hi"], row["n"]
                break
            rank -= row["n"]
    return lo


def quantise(vectors: DataFrame, vector: str = "vector", quantile: float = 0.99) -> DataFrame:
    """``vectors`` with ``code`` (array of tinyint): components scaled by the quantile of their size, exactly, and clipped."""
    q = exact_quantile(vectors.select(F.explode(vector).alias("x")).select(F.abs(F.col("x").cast("double")).alias("x")), quantile)
    scale = 127.0 / (q or 1.0)

    def near(x: Column) -> Column:
        """Halves go away from zero."""
        x = x.cast("double")
        return F.when(x >= 0, F.floor(x * scale + 0.5).cast("double")).otherwise(-F.floor(-x * scale + 0.5).cast("double"))

    code = F.transform(vector, lambda x: F.least(F.greatest(near(x), F.lit(-127.0)), F.lit(127.0)).cast("tinyint"))
    return vectors.withColumn("code", code)


def rescored(vectors: DataFrame, codes: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score) of the vectors (id, vector) that ``codes`` (id, code) put among the first ``OVERSAMPLING * k``.

    Only the codes, a quarter of the vectors' bytes, are read in full; the scores are exact. A vector so short that its
    code is all zeros scores 0 among the codes.
    """
    if not _size(query):
        return vectors.select("id", F.lit(0.0).alias("score")).limit(0)
    near = dot(F.col("code"), F.lit([float(x) for x in query])) / F.greatest(norm(F.col("code")), F.lit(1.0))
    found = codes.where(F.col("code").isNotNull()).select("id", near.alias("near"), _fits(F.col("code"), query).alias("_fits")).where(F.col("_fits").isNull())
    best = found.orderBy(F.desc("near"), "id").limit(OVERSAMPLING * k).select("id")
    return cosine_scores(vectors.join(F.broadcast(best), "id", "left_semi"), query)  # so many rows
