"""Approximate nearest neighbours by multi-index hashing.

Vectors are made unit vectors on which the largest inner product is the smallest angle: divided by the largest norm,
with one more component for what is missing to length 1. Learned rotations (PCA, then iterative quantisation, from
several starts) turn them to binary codes, which are split into substrings of about log2 of the number of vectors.

1. The index is one shuffled table of postings: which vectors have which value of which substring. A cell of it is a
   substring's number and the first bits of its value; cells of more than ``LIST`` postings are dealt out.
2. A query asks in each substring for all values within r bits of its own, and goes only to the cells that have such
   values. By the pigeonhole principle this meets every code within a Hamming radius of substrings * (r + 1) - 1 of
   the query's, and of the others those that are as near in some substring. The sample that the rotations are learned
   from gives r: the least at which its vectors meet 95 of 100 of what is nearest to them there. Where not even
   ``Sizes.radius`` does (three), no index can help: the queries are compared with all vectors, and a warning says so.
3. What a query has met is joined to a set by blocks of vectors, and ranked by exact inner products.
4. A query that met fewer than it needs is compared with all vectors, in blocks.

Equal vectors are searched once, as one class that carries its smallest ids.

Measured on some 50,000 vectors of 64 components: in clusters of 200 a query meets 5 % of them (r = 1, recall 1.00).
Vectors that are spread evenly can't be pruned well: 17 % on the unit sphere (r = 2, recall 0.96), 54 % where lengths
differ, too (r = 3, recall 0.99).

Defined cases: rows whose id or vector is null, zero or holds a null or non-finite component take no part; vectors
are searched among those of their own length; rows of one id and equal vectors count once; a query of which there
are fewer candidates gets all; an empty table gives an empty result; ties go to the smaller id.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.llm.common import drop_written, written

#: Vectors that the rotations are learned from, at most; a query is a row whose id EVERY divides.
SAMPLE = 8_192
EVERY = 20
#: Pairs that a task makes at once.
PAIRS = 2_000_000


@dataclass(frozen=True)
class Sizes:
    """Substrings of a code and bits by which a query's may differ, at most; postings and queries of a cell in one
    task; bits of a vector's place in its block, and queries that meet a block in one task; and the share of the
    nearest that the sample must meet."""

    substrings: int = 96
    radius: int = 3
    postings: int = 32_768
    queries: int = 4_096
    block_bits: int = 12
    block_queries: int = 8_192
    recall: float = 0.95


@lru_cache(64)
def ball(bits: int, radius: int) -> list[np.ndarray]:
    """The masks of so many bits with 0, 1 .. ``radius`` ones."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), d)], dtype=np.uint32) for d in range(min(radius, bits) + 1)]


@dataclass(frozen=True)
class Codes:
    """``rotation``: (length + 1, bits of the whole code); ``norm``: the largest norm of a vector; bits of a
    substring, and how many of them, the first, name its cell; ``parts`` of the queries that meet a block; ``radius``:
    bits by which a substring of what is met may differ; ``exact``: no radius up to the greatest meets enough."""

    rotation: np.ndarray
    norm: float
    bits: int
    cell_bits: int
    parts: int
    radius: int = 0
    exact: bool = False

    def _values(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, substrings) values."""
        out = np.empty((len(unit), self.rotation.shape[1] // self.bits), dtype=np.uint32)
        for a in range(0, len(unit), 1000):
            ones = (unit[a : a + 1000] @ self.rotation > 0).reshape(-1, out.shape[1], self.bits)
            now = np.zeros(ones.shape[:2], dtype=np.uint32)
            for b in range(self.bits):
                now = now << np.uint32(1) | ones[:, :, b]
            out[a : a + 1000] = now
        return out

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return self._values(np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self._values(np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])


def learn(sample: np.ndarray, norm: float, n: int, queries: int, k: int, sizes: Sizes = Sizes(), rounds: int = 10, seed: int = 7) -> Codes:
    """Rotations that lose little when signs are taken, by iterative quantisation of the principal axes; for ``n`` vectors."""
    x = sample / norm
    x = np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]
    _, axes = np.linalg.eigh(x.T @ x)
    x = x @ axes
    bits = min(32, max(8, round(math.log2(max(2, n)))))
    random, found, whole = np.random.default_rng(seed), [], bits * sizes.substrings
    for _ in range(-(-whole // x.shape[1])):
        r, _ = np.linalg.qr(random.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        found.append(axes @ r)
    cell_bits = min(bits, max(0, math.ceil(math.log2(max(1, n) / sizes.postings))))
    codes = Codes(np.ascontiguousarray(np.concatenate(found, axis=1)[:, :whole]), norm, bits, cell_bits, max(1, -(-queries // sizes.block_queries)))
    radius = _radius(codes, sample, max(1, round(k * len(sample) / n)), sizes)
    return replace(codes, exact=True) if radius is None else replace(codes, radius=radius)


def _radius(codes: Codes, sample: np.ndarray, k: int, sizes: Sizes, tried: int = 512) -> int | None:
    """The least radius at which vectors of the sample meet enough of their ``k`` nearest in it; none if ``sizes.radius`` is too small.

    So many in the sample are as near as those that a query wants are in the whole table.
    """
    k = min(k, len(sample) - 1)
    if not k:
        return sizes.radius
    scores = sample[:tried] @ sample.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    asked, held = codes.of_queries(sample[:tried]), codes.of_candidates(sample)
    apart = np.array([np.bitwise_count(held[b] ^ q).min(axis=1) for b, q in zip(best, asked, strict=True)])
    return next((r for r in range(sizes.radius + 1) if (apart <= r).mean() >= sizes.recall), None)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, width)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, v, ids, asks): each distinct vector, its k + 1 smallest ids, and whether a query is among all of them."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", _as_numbers(vectors).alias("v"))
    sound = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    rows = rows.where(F.forall("v", sound) & F.exists("v", lambda e: e != 0))
    least = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    asks = rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0).groupBy("v").agg(F.lit(True).alias("asks"))
    both = ids.join(asks, "v", "left")
    return both.select(F.size("v").alias("dim"), "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))


def _as_numbers(vectors: DataFrame) -> Column:
    """The vectors, as floats where they are floats: doubles otherwise."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    return F.col("embedding") if kind in ("float", "double") else F.transform("embedding", lambda e: e.cast("double"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, a written table with the column ``spot`` of monotonically_increasing_id(), and ``id``: 0, 1 and so on."""
    task = F.shiftright("spot", 33)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task that wrote
    begins = rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    begins = written(begins, "begins")
    place = F.col("spot") - F.shiftleft(F.col("task"), 33)
    return rows.withColumn("task", task).join(begins, "task").withColumn("id", F.col("begin") + place).drop("task", "begin", "spot")


_POSTING = "dim int, sub int, cell long, n long, ids binary, low binary"


def _postings(rows: DataFrame, book, sizes: Sizes, asking: bool) -> DataFrame:
    """(dim, sub, cell, n, ids, low) of (dim, id, v); of queries in every cell they ask, with ``left``: the bits still free."""

    def of_one(codes: Codes, ids: np.ndarray, x: np.ndarray) -> list[tuple]:
        values = codes.of_queries(x) if asking else codes.of_candidates(x)
        low_bits = codes.bits - codes.cell_bits
        low, cells = values & np.uint32((1 << low_bits) - 1), values.astype(np.int64) >> low_bits
        masks = ball(codes.cell_bits, codes.radius if asking else 0)
        out = []
        for sub in range(values.shape[1]):
            to = [(cells[:, sub] ^ int(m), codes.radius - d) for d, some in enumerate(masks) for m in some]
            cell = np.concatenate([c for c, _ in to])
            who = np.tile(np.arange(len(ids)), len(to))
            left = np.repeat(np.array([f for _, f in to], dtype="u1"), len(ids))
            order = np.argsort(cell, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(cell[order])) + 1, len(order)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                at = who[order[a:b]]
                row = (sub, int(cell[order[a]]), b - a, ids[at].astype("<i8").tobytes(), low[at, sub].astype("<u4").tobytes())
                out.append((*row, left[order[a:b]].tobytes()) if asking else row)
        return out

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                made = of_one(book.value[dim], some.column("id").to_numpy(), _matrix(some.column("v"), dim))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=False)]
                names = ["dim", "sub", "cell", "n", "ids", "low", "left"]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(made), pa.int32()), *columns], names=names[: 1 + len(columns)])

    return rows.select("dim", "id", "v").mapInArrow(run, _POSTING + (", left binary" if asking else ""))


def _dealt(rows: DataFrame, mine: DataFrame, other: DataFrame, name: str, other_name: str) -> DataFrame:
    """``rows`` of cells, each row in one of its cell's own parts, and once for each part of the other side."""
    cell = ["dim", "sub", "cell"]
    both = rows.join(mine, cell).join(other, cell)
    both = both.withColumn(name, F.pmod(F.xxhash64("ids"), F.col(f"{name}s")).cast("int"))
    return both.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(f"{other_name}s") - 1))).drop(f"{name}s", f"{other_name}s")


_MET = "dim int, block long, part int, qids binary, counts binary, places binary"


def _met(postings: DataFrame, queries: DataFrame, book, sizes: Sizes) -> DataFrame:
    """(dim, block, part, qid, places): which places of a block a query has met, each once."""

    def pairs(codes: Codes, ids, low, qids, asked, left):
        """Pairs of a query and a vector, some at a time."""
        low_bits = codes.bits - codes.cell_bits
        order = np.argsort(low, kind="stable")
        ids = ids[order]
        counts = np.bincount(low, minlength=1 << low_bits)
        begins = np.cumsum(counts) - counts
        for free in np.unique(left).tolist():
            masks = np.concatenate(ball(low_bits, free))
            mine = np.flatnonzero(left == free)
            step = max(1, PAIRS // len(masks))
            for a in range(0, len(mine), step):
                values = asked[mine[a : a + step], None] ^ masks
                many = counts[values]
                each = many.sum(axis=1)
                upto = np.cumsum(each)
                b = 0
                while b < len(each):  # as many queries as make PAIRS pairs, or one
                    c = max(b + 1, int(np.searchsorted(upto, upto[b] - each[b] + PAIRS)))
                    n, begin = many[b:c].ravel(), begins[values[b:c]].ravel()
                    total = int(n.sum())
                    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)
                    yield np.repeat(qids[mine[a + b : a + c]], each[b:c]), ids[at]
                    b = c

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            codes = book.value[dim]
            sides = _joined(left, "ids", "<i8"), _joined(left, "low", "<u4"), _joined(right, "ids", "<i8"), _joined(right, "low", "<u4"), _joined(right, "left", "u1")
            for q, c in pairs(codes, *sides):
                block, part = c >> sizes.block_bits, q % codes.parts
                order = np.lexsort((q, part, block))
                q, c, block, part = q[order], c[order], block[order], part[order]
                edges = np.r_[0, np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1, len(q)] if len(q) else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    who, counts = np.unique(q[a:b], return_counts=True)
                    places = (c[a:b] & ((1 << sizes.block_bits) - 1)).astype("<u2")
                    rows.append((dim, int(block[a]), int(part[a]), who.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), places.tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["dim", "block", "part", "qids", "counts", "places"])

    def unite(rows: pa.Table) -> pa.Table:
        qids, counts = _joined(rows, "qids", "<i8"), _joined(rows, "counts", "<u4")
        who, at = np.unique(qids, return_inverse=True)
        met = np.zeros((len(who), 1 << sizes.block_bits), dtype=bool)
        met[np.repeat(at, counts), _joined(rows, "places", "<u2")] = True
        places = [np.flatnonzero(m).astype("<u2").tobytes() for m in met]
        same = {c: pa.array([rows.column(c)[0].as_py()] * len(who), t) for c, t in (("dim", pa.int32()), ("block", pa.int64()), ("part", pa.int32()))}
        return pa.Table.from_pydict({**same, "qid": pa.array(who, pa.int64()), "places": pa.array(places, pa.binary())})

    cell = ["dim", "sub", "cell"]
    parts = [
        written(rows.groupBy(*cell).agg(F.ceil(F.sum("n") / most).cast("int").alias(name)), name)
        for rows, most, name in ((postings, sizes.postings, "lists"), (queries, sizes.queries, "asks"))
    ]
    keys = [*cell, "list", "ask"]
    left = _dealt(postings, *parts, "list", "ask").groupBy(*keys)
    right = _dealt(queries, *reversed(parts), "ask", "list").groupBy(*keys)
    found = left.cogroup(right).applyInArrow(probe, _MET)
    return found.groupBy("dim", "block", "part").applyInArrow(unite, "dim int, block long, part int, qid long, places binary")


def _ranked(classes: DataFrame, asking: DataFrame, met: DataFrame, parts: Column, k: int, sizes: Sizes) -> DataFrame:
    """(qid, near): the k + 1 nearest ids of each query among what it has ``met``; null places are all of the block."""

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["qid", "id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            x, y, ids = _matrix(left.column("v"), dim), _matrix(right.column("q"), dim), left.column("id").to_numpy()
            at = np.full(1 << sizes.block_bits, -1)
            at[ids & ((1 << sizes.block_bits) - 1)] = np.arange(len(ids))
            for q, qid, raw in zip(y, right.column("qid").to_pylist(), right.column("places").to_pylist(), strict=True):
                places = np.arange(len(ids)) if raw is None else at[np.frombuffer(raw, "<u2")]
                scores = (x[places] * q).sum(axis=1)
                if len(places) > k + 1:
                    # all that tie with the last go on, as ids decide
                    kept = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    places, scores = places[kept], scores[kept]
                for to, what in zip(out, (np.full(len(places), qid), ids[places], scores), strict=True):
                    to.append(what)
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds, strict=True)], names=names)

    keys = ["dim", "block", "part"]
    candidates = classes.select("dim", "id", "v", F.shiftright("id", sizes.block_bits).alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    asked = met.join(asking.select(F.col("id").alias("qid"), F.col("v").alias("q")), "qid")
    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(near, "qid long, id long, score double")
    found = found.join(classes.select("id", "ids"), "id").select("qid", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    return found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # k + 1 at most


def met_counts(vectors: DataFrame, k: int = 20, sizes: Sizes = Sizes()) -> DataFrame:
    """(qid, met): how many vectors each query has met, for measuring."""
    *_, met, _ = _prepared(vectors, k, sizes)
    return met.groupBy("qid").agg(F.sum(F.octet_length("places") / 2).cast("long").alias("met"))


def _prepared(vectors: DataFrame, k: int, sizes: Sizes):
    spark = vectors.sparkSession
    classes = written(_classes(vectors, k).withColumn("spot", F.monotonically_increasing_id()), "vectors")
    classes = _numbered(classes)
    asking = written(classes.where("asks").select("dim", "id", "v"), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    dims = classes.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.sqrt(F.max(square)).alias("norm"), F.sum(F.size("ids")).alias("ids")).collect()
    codes = {}
    for d in dims:
        sample = classes.where(F.col("dim") == d["dim"]).select("id", "v").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
        codes[d["dim"]] = learn(np.array([r["v"] for r in sample], dtype=np.float64), d["norm"], d["n"], d["q"], k, sizes)
    book = spark.sparkContext.broadcast(codes)  # (length + 1) by the bits of a code doubles a length
    spread = sorted(d for d, c in codes.items() if c.exact)
    if spread:
        warnings.warn(f"vectors of {spread} components: no radius up to {sizes.radius} meets {sizes.recall:.0%} of the nearest of a sample, so queries are compared with all vectors", stacklevel=3)
    indexed = ~F.col("dim").isin(spread) if spread else F.lit(True)
    met = _met(_postings(classes.where(indexed), book, sizes, False), _postings(asking.where(indexed), book, sizes, True), book, sizes)
    return classes, asking, dims, codes, met, book


def search(vectors: DataFrame, k: int = 20, sizes: Sizes = Sizes()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every row whose vec_id is divisible by EVERY."""
    classes, asking, dims, codes, met, _ = _prepared(vectors, k, sizes)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def of_dim(values: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for d in dims for x in (d["dim"], values[d["dim"]])]), F.col("dim"))

    parts = of_dim({d: c.parts for d, c in codes.items()})
    lists = written(_ranked(classes, asking, met, parts, k, sizes), "nearest")
    # queries that have met fewer than they need meet all, block by block
    needed = of_dim({d["dim"]: min(k + 1, d["ids"]) for d in dims})
    size = F.coalesce(F.size("near"), F.lit(0))
    short = asking.join(lists, asking["id"] == lists["qid"], "left").where(size < needed).select("dim", "id", "v")
    if not short.isEmpty():
        short = written(short, "short")
        blocks = classes.select("dim", F.shiftright("id", sizes.block_bits).alias("block")).distinct()
        every = short.join(blocks, "dim").select("dim", "block", F.pmod("id", parts).cast("int").alias("part"), F.col("id").alias("qid"), F.lit(None).cast("binary").alias("places"))
        more = _ranked(classes, short, every, parts, k, sizes)
        lists = written(lists.join(short.select(F.col("id").alias("qid")), "qid", "left_anti").unionByName(more), "nearest")
        drop_written(short)
    query = vectors.where(F.col("vec_id").isNotNull() & (F.pmod("vec_id", F.lit(EVERY)) == 0)).select(F.col("vec_id").alias("query_id"), _as_numbers(vectors).alias("v")).distinct()
    query = query.join(classes.where("asks").select("id", "v"), "v").join(lists, F.col("id") == F.col("qid"))
    others = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    return query.select("query_id", F.posexplode(others).alias("i", "s")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score")
    )
