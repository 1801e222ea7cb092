"""Ordered look-ups: provisions of a document of record, and its whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.functions.text import natural_key

CAP = 1000


def reading_order(kind: Column, eid: Column, *tie: str) -> list[Column]:
    """Sections first, then by the numbers in the id, then by place in the corpus."""
    return [F.when(kind == "section", 0).otherwise(1).asc(), natural_key(eid).asc(), *[F.col(t).asc() for t in tie]]


def capped(rows: DataFrame, cap: int | None, *tie: str) -> DataFrame:
    """The first ``cap`` rows by ``tie``, before any sorting for display."""
    return rows if cap is None else rows.orderBy(*tie).limit(cap)


def joined_text(rows: DataFrame, by: list[str], order: list[str], text: str = "text", gap: str = "\n\n") -> DataFrame:
    """The texts of each group, in order, with ``gap`` between."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), gap).alias(text))


def equals(column: str, value: str | None) -> Column:
    """An equality filter; none, or an empty string, filters nothing."""
    return F.col(column) == value if value else F.lit(True)
