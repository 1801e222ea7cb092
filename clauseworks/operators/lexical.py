"""BM25 (Robertson and Zaragoza 2009) over an inverted index or straight over texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clauseworks.functions.text import tokens

Tokenizer = Callable[[Column], Column]


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def idf(self, n: Column, df: Column) -> Column:
        return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))

    def part(self, idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))


@dataclass(frozen=True)
class LexicalIndex:
    """postings (id, term, tf, dl: the document's length), doc_stats (id, dl), term_stats (term, df), coll_stats (n, avgdl)."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    coll_stats: DataFrame


def _term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _coll_stats(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _postings(cut: DataFrame, ts: Column) -> DataFrame:
    words = cut.select("id", F.size("ts").cast("long").alias("dl"), F.explode(ts).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def build(rows: DataFrame, id_col: str = "id", text: str = "text", tokenizer: Tokenizer = tokens) -> LexicalIndex:
    cut = rows.select(F.col(id_col).alias("id"), tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    postings = _postings(cut, F.col("ts"))
    doc_stats = cut.select("id", F.size("ts").cast("long").alias("dl"))
    return LexicalIndex(postings, doc_stats, _term_stats(postings), _coll_stats(doc_stats))


def build_for(rows: DataFrame, terms: list[str], path: str, id_col: str = "id", text: str = "text", tokenizer: Tokenizer = tokens) -> LexicalIndex:
    """An index of some terms alone, written to ``path`` in one pass: only their postings are shuffled, and the
    collection is counted as it is read. Its doc_stats are those of documents with a term."""
    cut = rows.select(F.col(id_col).alias("id"), tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    seen = Observation()
    cut = cut.observe(seen, F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    _postings(cut, F.filter("ts", lambda t: t.isin(terms))).write.parquet(path)
    postings = rows.sparkSession.read.parquet(path)
    whole = rows.sparkSession.createDataFrame([(seen.get["n"], seen.get["avgdl"])], "n long, avgdl double")
    return LexicalIndex(postings, postings.select("id", "dl").distinct(), _term_stats(postings), whole)


def query_terms(spark, query: str, tokenizer: Tokenizer = tokens) -> list[str]:
    """The query's distinct terms, cut as the documents are."""
    row = spark.createDataFrame([(query,)], "q string").select(F.array_distinct(tokenizer(F.col("q"))).alias("t")).first()
    return list(row["t"])


def search_index(index: LexicalIndex, terms: list[str], model: Bm25 = Bm25(), among: DataFrame | None = None) -> DataFrame:
    """(id, score) of documents with a term; ``among`` (id) limits which are scored, and no statistic."""
    hit = index.postings.where(F.col("term").isin(terms))
    if among is not None:
        hit = hit.join(among.select("id"), "id", "left_semi")
    df = index.term_stats.where(F.col("term").isin(terms))
    whole = index.coll_stats.first()  # one row
    n, avgdl = F.lit(float(whole["n"])), F.lit(float(whole["avgdl"] or 0))
    scored = hit.join(F.broadcast(df), "term")  # a row for each term of the query
    part = model.part(model.idf(n, F.col("df")), F.col("tf"), F.col("dl"), avgdl)
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def _is(term: str) -> Callable[[Column], Column]:
    return lambda t: t == term


def search_texts(rows: DataFrame, terms: list[str], keep: Column | None = None, model: Bm25 = Bm25(), id_col: str = "id", text: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """(id, score) without an index: one pass for the statistics of the terms, one to score; no shuffle of texts.

    In each pass a text is cut once: no filter moves below the generator of its one row of counts.
    """

    def counts(ts: Column) -> Column:
        return F.struct(F.size(ts).alias("dl"), F.array(*[F.size(F.filter(ts, _is(q))) for q in terms]).alias("tf"))

    cut = F.transform(F.array(tokenizer(F.coalesce(F.col(text), F.lit("")))), counts)
    narrow = rows.select(F.col(id_col).alias("id"), (F.lit(True) if keep is None else keep).alias("_keep"), F.explode_outer(cut).alias("_c")).select("id", "_keep", "_c.dl", "_c.tf")
    stats = narrow.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avgdl = F.lit(float(stats["n"])), F.lit(float(stats["avgdl"] or 0))
    parts = [model.part(model.idf(n, F.lit(float(stats[f"df{i}"]))), F.get("tf", F.lit(i)).cast("double"), F.col("dl"), avgdl) for i in range(len(terms))]
    score = sum(parts[1:], parts[0])
    return narrow.where(F.col("_keep") & F.exists("tf", lambda x: x > 0)).select("id", score.alias("score"))


def top(scored: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """The best ``k``: equal (rounded) scores go to the smaller id."""
    s = F.round("score", digits) if digits is not None else F.col("score")
    return scored.select("id", s.alias("score")).orderBy(F.desc("score"), "id").limit(k)
