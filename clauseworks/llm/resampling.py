"""Importance resampling towards a target distribution, scored without exploding a document.

Each text becomes the array of its features' buckets, by higher-order functions, and is written so once. A first pass
adds up how often each bucket occurs in the corpus and in the target texts: partial sums of at most ``buckets`` rows a
task are all that is shuffled. The gains of the buckets are then a literal array, and a second pass adds up the gains
of a document by ``aggregate`` over ``element_at``. Noise that depends on ``doc_id`` alone turns the choice of the
highest scores into a draw without replacement. The ranks of those drawn need no sort in one task: quantiles cut the
scores into ranges, the ranges are counted, and only ranges with a drawn document are sorted, each by itself.

Defined cases: a null, an empty text and one without words have no feature and the weight 0, and are never drawn;
repeated rows count and are drawn each, ties go to the smaller ``doc_id`` (null first, and with the noise of the empty
id); no documents give no rows; no target texts make frequent buckets the less likely ones; texts of any length are
scored whole, in memory of a few bytes a word; only the columns named are read, others may have any name.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.llm.common import ascii_lower, drop_written, written

#: A word, after A-Z became a-z: everything but ASCII characters that are no digit or small letter ends one.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Ranges into which the scores of drawn documents are cut, and the accuracy of the quantiles that cut them: these
#: decide how the work is dealt out, never the result.
RANGES = 256
ACCURACY = 10_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({FEATURE_WORD})"), F.lit(1))


def bucket_array(words: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to ``longest`` consecutive words, repeats included."""

    def bucket(s: Column) -> Column:
        return F.pmod(F.crc32(s), F.lit(buckets)).cast("int")

    def of_length(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    one = F.transform(words, bucket)
    return one if longest == 1 else F.concat(one, *[of_length(n) for n in range(2, longest + 1)])


def bucket_totals(features: DataFrame) -> DataFrame:
    """(bucket, n) of the arrays in column ``buckets``."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Of each bucket, a thousand times the log of how much likelier it is in the target, rounded down."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (float(target.get(b, 0) + 1) * float(s_all + buckets)) / (float(corpus.get(b, 0) + 1) * float(t_all + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def _literal(values: list[int]) -> Column:
    """An array as one constant of the plan: folded from its text once, not built of thousands of expressions."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a draw from the Gumbel distribution, by a hash of seed and id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of (doc_id, text), by the texts of ``target``."""
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    made = words.select("doc_id", F.size("words").cast("long").alias("n_words"), bucket_array(F.col("words"), longest, buckets).alias("buckets"))
    features = written(made, "features")
    aimed = target.select(bucket_array(words_of(F.col("text")), longest, buckets).alias("buckets"))
    both = bucket_totals(features).withColumn("aim", F.lit(False)).unionByName(bucket_totals(aimed).withColumn("aim", F.lit(True)))
    counts: dict[bool, dict[int, int]] = {False: {}, True: {}}
    for r in both.collect():  # at most 2 x buckets rows
        counts[r["aim"]][r["bucket"]] = r["n"]
    gain = _literal(gains(counts[False], counts[True], buckets))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b + 1))
    out = features.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    out = written(out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    drop_written(features)
    return out


def ranked(rows: DataFrame, share: float, percent: int, ranges: int = RANGES) -> DataFrame:
    """Adds ``rank`` to rows with ``score``, ``doc_id`` and ``may``: 1 and so on for the best ``percent`` of those that may."""
    may = rows.where("may")
    at = [max(0.0, 1 - share * i / ranges - (2 / ACCURACY if i == ranges else 0)) for i in range(1, ranges + 1)]
    seen = may.agg(F.count("*").alias("n"), F.percentile_approx("score", at, ACCURACY).alias("cuts")).first()
    drawn = seen["n"] * percent // 100
    cuts = sorted(set(seen["cuts"] or []), reverse=True)
    part = F.size(F.filter(_literal_longs(cuts), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    # range 0 has the scores that no cut is above; those that are below all cuts are the last
    dealt = may.withColumn("_part", part)
    sizes = dict(dealt.groupBy("_part").count().collect())  # at most one row a range
    before = dict(zip(range(len(cuts) + 1), accumulate([0, *[sizes.get(p, 0) for p in range(len(cuts))]]), strict=True))
    last = max([p for p, n in before.items() if n < drawn], default=-1)
    chosen = Window.partitionBy("_part").orderBy(F.desc("score"), F.asc("doc_id"))
    start = F.element_at(_literal_longs(list(before.values())), F.col("_part") + 1)
    best = dealt.where(F.col("_part") <= last).withColumn("rank", (start + F.row_number().over(chosen)).cast("long"))
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_part")
    rest = dealt.where(F.col("_part") > last).drop("_part").unionByName(rows.where(~F.col("may")))
    return best.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def _literal_longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank is null where a document is not drawn."""
    rows = scored(docs, target, longest, buckets, seed).withColumn("may", F.col("n_words") >= least_words)
    return ranked(rows, percent / 100, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 10, **options) -> DataFrame:
    """The ids of the drawn documents, with their ranks."""
    return resample(docs, target, percent, **options).where(F.col("rank").isNotNull()).select("doc_id", "rank")


# The checksum, bit by bit over a table of 256 entries, for each distinct word.
SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
src AS (SELECT 0 AS aim, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT aim, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
e AS (SELECT aim, r, unnest(ws) AS word FROM w),
v AS (SELECT DISTINCT word FROM e),
x AS (SELECT word, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT)) AS bs FROM v),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bs), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, tab),
f AS (SELECT aim, r, bucket FROM e JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (aim = 0) AS s, count(*) FILTER (aim = 1) AS t FROM f GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n, tot),
wt AS (SELECT r, sum(gain) AS weight FROM f JOIN g USING (bucket) WHERE aim = 0 GROUP BY r),
d AS (SELECT w.r, doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN wt USING (r) WHERE aim = 0),
sc AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS i, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM sc)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND i <= 10 * n // 100 THEN i END AS rank FROM k
"""
