"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.llm.common import drop_written, written

#: Edges, of 16 bytes and some hundred in a dictionary, that one task joins.
SMALL = 250_000


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b) with a above b: every neighbour is moved to the least one of a's neighbours and itself.

    The large star moves the neighbours above a node, the small star those below it, and the node itself.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    near = both.join(least, F.col("a") == F.col("c"))
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) by union and find; of at most SMALL edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the root is the least node reachable.

    So few edges as one task surely holds are joined there. More go through rounds of two stars, each of which at
    least halves the depth, until the edges no longer change; the edges of each round, and the result, are tables in
    the shared folder, so that a lost executor costs one round at most.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = _print(now)
    if seen[0] <= small:
        roots = written(_in_one_task(now), "roots")
        drop_written(now)
        return roots
    while True:
        new = written(_star(_star(now, True), False), "edges")
        drop_written(now)
        now, before, seen = new, seen, _print(new)
        if seen == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = written(roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    drop_written(now)
    return roots
