"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in shuffled order, gets a virtual finish time: the source's words up to and with it,
divided by the source's target. All documents are then ranged by that time and cut where the budget is full, so
that at the cut each source has been served in proportion to its target, within about one document.

Defined cases: a null or empty text has size 0 and is never repeated beyond its one zero-word row; a null source
is a source of its own, last in order; repeated rows are rows of their own; a table without words gets targets 0
and takes nothing; rows of one id are told apart by their text and then by their source, and what is still equal is
interchangeable, so that reruns agree in whatever order and files the rows come; an empty table gives no rows;
a very long text is one document, taken whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.llm.common import bucket_count, column, numbered, running_total, word_count, written

WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
SHARE = 1.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from (source, size): weights go round the sources in code-point order.

    No target is above ``max_times`` the source's size; what a capped source can't take is shared by weight among
    the others until none is above. That level is found at once: with sources in the order of cap by weight, the
    first for which an even share of the rest stays under its cap ends the capped ones.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(n)) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_times)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.select(
        "source", "source_size", "weight", "cap",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.sum("weight").over(here_on).alias("weight_on"),
    )
    level = (F.col("budget") - F.col("cap_before")) / F.col("weight_on")
    fits = level * F.col("weight") <= F.col("cap")
    # the first source that fits sets the level for itself and all after it
    first = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("rest", F.first(F.when(fits, F.struct((F.col("budget") - F.col("cap_before")).alias("left"), F.col("weight_on").alias("w"))), ignorenulls=True).over(first))
    target = F.when(F.col("rest").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("rest.left") * F.col("weight") / F.col("rest.w"), F.col("cap").cast("double"))
    )
    return per.select("source", "source_size", target.alias("target"), F.col("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES, share: float = SHARE, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) and the columns in ``keep``: one row a row of ``docs``.

    ``seed`` sets the order within a source: that of md5 of id, text and seed, the same in every run. The columns
    in ``keep`` come back numbered, as ``keep_0`` and so on.
    """
    kept = numbered(keep)
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    base = docs.select(
        "doc_id", F.col("source"), word_count(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text, F.lit(seed)).cast("binary")).alias("key"),
        *[column(c).alias(k) for c, k in zip(keep, kept, strict=True)],
    ).withColumn("row_id", F.monotonically_increasing_id())
    base = written(base, "mix-sizes")
    narrow = base.select("row_id", "doc_id", "source", "size", "key")
    goal = written(targets(narrow, weights, max_times, share), "mix-targets")  # so that its size is known when joins are planned
    rows, words = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = float(words) * float(share)
    n = bucket_count(rows)

    # the place in the source's order: words up to and with each document
    hex_bits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = running_total(
        narrow.where("size > 0").withColumn("bucket", (hex_bits * n / F.lit(2**32)).cast("long")),
        ["source"], "bucket", ["key", "row_id"], "size", "upto",
    )
    placed = placed.alias("p").join(
        goal.withColumnRenamed("source", "g_source").alias("g"), F.col("p.source").eqNullSafe(F.col("g_source"))
    ).where("target > 0")
    # as many rounds of the source as its target can reach, each with its own finish time
    rounds = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_times - 1)).cast("int")
    items = placed.select(
        "row_id", "doc_id", "source", "size", "key", F.explode(F.sequence(F.lit(0), rounds)).alias("round"), "upto", "source_size", "target"
    ).withColumn("finish", (F.col("upto") + F.col("round") * F.col("source_size")).cast("double") / F.col("target"))
    # ranged by finish time over equal spans of it, then cut where the budget is full
    items = items.withColumn("bucket", F.floor(F.col("finish") * n).cast("long"))
    served = running_total(
        items, [], "bucket", ["finish", F.col("source").asc_nulls_last(), "round", "key", "row_id"], "size", "served"
    ).where(F.col("served") <= F.lit(budget))
    taken = served.groupBy("row_id").agg(F.count("*").cast("int").alias("copies"))
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    out = base.drop("key").join(taken, "row_id", "left").alias("b").join(goal, F.col("b.source").eqNullSafe(F.col("g_source")), "left")
    copies = F.coalesce(F.col("copies"), F.lit(0))
    return out.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"),
        *kept,
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: a row for each time that the mix takes a document; documents without words go."""
    keep = tuple(docs.columns)
    out = mix(docs, keep=keep, **options)
    out = out.where("copies > 0").withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(k).alias(c) for k, c in zip(numbered(keep), keep, strict=True)])


SQL = r"""
WITH s AS (SELECT row_number() OVER () AS row_id, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') || ':mix') AS key FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap FROM p),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM w),
f AS (SELECT *, (budget - cap_before) / weight_on * weight <= cap AS fits FROM l),
r AS (SELECT arg_min(budget - cap_before, cap / weight) AS left_over, arg_min(weight_on, cap / weight) AS w, min(cap / weight) AS turn FROM f WHERE fits),
t AS (SELECT source, source_size, budget, CASE WHEN turn IS NULL OR cap / weight < turn THEN CAST(cap AS DOUBLE)
             ELSE least(left_over * weight / w, CAST(cap AS DOUBLE)) END AS target FROM f, r),
u AS (SELECT s.*, t.source_size, t.target, t.budget,
             sum(size) OVER (PARTITION BY s.source ORDER BY key, row_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source WHERE size > 0),
i AS (SELECT *, CAST(upto + e * source_size AS DOUBLE) / target AS finish FROM u, range(3) AS x(e) WHERE target > 0 AND e <= floor(target / source_size)),
c AS (SELECT row_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, e, key, row_id ROWS UNBOUNDED PRECEDING) AS served, budget FROM i),
k AS (SELECT row_id, count(*) AS copies FROM c WHERE served <= budget GROUP BY row_id)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(coalesce(k.copies, 0) * s.size AS BIGINT) AS taken, CAST(coalesce(k.copies, 0) AS INT) AS copies
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON s.row_id = k.row_id
"""
