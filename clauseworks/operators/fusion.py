"""Reciprocal rank fusion (Cormack et al. 2009)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame) -> DataFrame:
    """(id, rank) of the few best of a branch, by score, then id."""
    return hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def fuse(branches: list[DataFrame], k: int, constant: int = 60, digits: int | None = 6) -> DataFrame:
    """The best ``k`` (id, score) of branches (id, score), each already cut to its own best."""
    every = reduce(DataFrame.unionByName, [ranked(b) for b in branches])
    score = F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("rank")))
    score = F.round(score, digits) if digits is not None else score
    return every.groupBy("id").agg(score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
