"""Quality rules by host: DataFrame functions only.

Each document is measured and tested alone (``base_failed``). The failures are counted by host, each host's rate
of failure is shrunk towards the mean of all by a beta prior fitted to the hosts, and a host whose shrunk rate is
above ``MAX_RATE`` takes its other documents with it. In ``documents`` the host is ``source``.

Defined cases: a null or empty text has no words, and so fails; a null host is a host of its own; repeated rows
count each; with no host, or hosts that differ no more than chance, the prior holds ``MAX_PRIOR`` documents; an empty
table gives no rows; a text of any length is measured whole, in memory that grows with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.llm.common import GAP, GAP_CHARS, WORD, column, numbered, written

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_RATE = 0.5
MAX_PRIOR = 1e6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return _let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def _covered(hashes: Column) -> Column:
    """Words that lie in windows whose hash another window has too: sort, mark equal neighbours, add up spans."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        def marked(x: Column, k: Column) -> Column:
            before = F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            after = F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.when(before | after, x["i"])

        return F.array_sort(F.filter(F.transform(s, marked), lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(_let(pairs, starts), start, add, lambda a: a["n"])


def n_repeat_words(words: Column) -> Column:
    hashes = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda wh: F.when(
            F.size(wh) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(wh) - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(wh, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    dup_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return _let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            n_repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def prior(hosts: DataFrame) -> tuple[float, float]:
    """The beta prior's (failures, passes), by moments: of (host, n, failed)."""
    row = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts")).first()
    if not row["n"]:
        return 0.0, MAX_PRIOR
    mean = row["failed"] / row["n"]
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), F.lit(2)))).first()[0] / row["n"]
    between = spread - mean * (1 - mean) * (row["hosts"] - 1) / row["n"]
    size = min(max(mean * (1 - mean) / between - 1, 1.0), MAX_PRIOR) if between > 0 else MAX_PRIOR
    return mean * size, (1 - mean) * size


def rules(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = (), max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, the measures, base_failed, host_rate, kept) and the columns in ``keep``, numbered: one row a row of ``docs``."""
    held = numbered(keep)
    base = docs.select("doc_id", column(host).alias("host"), measures(F.col("text")).alias("m"), *[column(c).alias(k) for c, k in zip(keep, held, strict=True)])
    base = base.select("doc_id", "host", *[F.col(f"m.{m}").alias(m) for m in MEASURES], *held)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = written(base.withColumn("base_failed", failed), "quality")
    hosts = base.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    a, b = prior(hosts)
    rates = hosts.select(F.col("host").alias("of_host"), ((F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias("rate"))
    rates = written(rates, "host-rates")  # so that its size is known when the join is planned
    judged = base.join(rates, F.col("host").eqNullSafe(F.col("of_host")))
    return judged.select(
        "doc_id", *MEASURES, "base_failed", F.round("rate", 6).alias("host_rate"),
        (~F.col("base_failed") & (F.col("rate") <= max_rate)).alias("kept"), *held,
    )


def kept(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    columns = tuple(docs.columns)
    return rules(docs, host, columns).where("kept").select(*[F.col(k).alias(c) for k, c in zip(numbered(columns), columns, strict=True)])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
p AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
x AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM p) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM x, range(8) AS y(k) GROUP BY r),
m AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN dl USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b GROUP BY source),
g AS (SELECT sum(n) AS total, sum(failed) / sum(n) AS mean, count(*) AS hosts FROM h),
v AS (SELECT any_value(mean) AS mean, sum(n * pow(failed / n - mean, 2)) / any_value(total) - any_value(mean * (1 - mean) * (hosts - 1) / total) AS between_hosts FROM h, g),
k AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e6) ELSE 1e6 END AS size FROM v),
q AS (SELECT source, (failed + mean * size) / (n + size) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
       NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source
"""
