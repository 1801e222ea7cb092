"""BM25 over postings in blocks with bounds: a search reads the blocks that may matter, and gives what a full one would.

A block has the postings of one term in one *range* of documents (512 successive numbers of one value of the
grouping column), with their number, the greatest term frequency and the least length. From these follows the most
that the term can give to a document of the range. Ranges are those of all terms alike, so the sum over a query's
terms bounds every score in a range. A search scores the most promising ranges, takes the k-th best score from them,
and then only ranges whose bound reaches it. Postings are made and written where their documents are: a file has all terms
of the documents of one task, in runs that are in order of terms. So no posting is shuffled or sorted by Spark, and no
term is in one task or file. A document's length stands in its postings, so no other table is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import tokens
from clauseworks.operators.batches import small_batches
from clauseworks.operators.lexical import Bm25, Tokenizer

#: Documents of a range, by the power of two; ranges that a search scores first.
BLOCK_BITS = 9
FIRST = 64
#: Bytes of a row group of postings; bytes of words whose postings make a run; blocks of a batch that goes back to Spark.
ROW_GROUP = 16 << 20
RUN_BYTES = 32 << 20
OUT_BLOCKS = 32_768
#: Documents that meet all of many queries in one task; terms of many queries that are broadcast at most.
MANY_DOCS = 4096
MAX_TERMS = 200_000


@dataclass(frozen=True)
class Stats:
    """Of a collection: documents, their average length, and how many have each of the query's terms."""

    n: float
    avgdl: float
    df: dict[str, float] = field(default_factory=dict)


def build(
    rows: DataFrame, by: str | None = None, carry: tuple[str, ...] = (), text: str = "text", tokenizer: Tokenizer = tokens, seen: Observation | None = None
) -> DataFrame:
    """Blocks of (doc, tie, text): (term, range, n, max_tf, min_dl, posts), and ``by``, of which a block has one value.

    ``doc`` numbers the rows, each its own; ``tie`` decides between equal scores; ``carry`` are columns that filters may
    ask for. Rows stay in their tasks and are shuffled nowhere: a range that is in two tasks, or in two runs of one,
    has a block of a term in each, which costs bytes and changes no result. So blocks are full where rows of near
    numbers are near each other, as those of ``monotonically_increasing_id`` are. A run has ``RUN_BYTES`` of words, and
    its blocks are in order of terms, ``by`` and ranges. ``seen`` gets ``n`` and ``avgdl`` of the rows when the blocks
    are written, so that texts need not be cut again to count them.
    """
    group = [by] if by else []
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in group]  # equal values only join where they are not null
    cut = rows.select("doc", "tie", *named, *carry, tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    if seen is not None:
        cut = cut.observe(seen, F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    kept = ["tie", *carry]
    kind = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    own = [f"`{c}` {kind[c]}" for c in group]
    posts = f"at: smallint, tie: {kind['tie']}, tf: int, dl: int" + "".join(f", `{c}`: {kind[c]}" for c in carry)
    schema = ", ".join(["term string", *own, "range long", "n long", "max_tf int", "min_dl int", f"posts array<struct<{posts}>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs(batches):
            yield from _inverted(pa.Table.from_batches(some), by, kept)

    small_batches(rows.sparkSession)
    return cut.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of ``RUN_BYTES`` together, or one more batch's."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= RUN_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _inverted(rows: pa.Table, by: str | None, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of a run's rows, by numpy: terms, in their order, and rows as numbers, sorted once."""
    order = [("doc", "ascending")]
    rows = rows.sort_by([(by, "ascending"), *order] if by else order).combine_chunks()
    ts = rows["ts"].combine_chunks()
    dl = np.diff(ts.offsets.to_numpy()).astype(np.int32)
    words = ts.flatten().dictionary_encode()
    if not len(words):
        return
    by_term = pc.array_sort_indices(words.dictionary)
    number = np.empty(len(by_term), np.int64)
    number[by_term.to_numpy()] = np.arange(len(by_term))
    doc = rows["doc"].to_numpy()
    ranges = doc >> BLOCK_BITS
    new = np.r_[False, np.diff(ranges) != 0]
    if by:
        new |= np.r_[False, np.diff(rows[by].combine_chunks().dictionary_encode().indices.to_numpy()) != 0]
    group = np.cumsum(new)
    # (term, row) as one number; rows are in order of their groups
    posts, tf = np.unique(number[words.indices.to_numpy()] * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, row = np.divmod(posts, len(dl))
    tf = tf.astype(np.int32)
    starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(group[row]) != 0)])
    ends = np.r_[starts[1:], len(posts)]
    at, first = pa.array(row), pa.array(row[starts])
    columns = {c: rows[c].combine_chunks().take(at) for c in kept}
    fields = {"at": pa.array((doc - (ranges << BLOCK_BITS))[row].astype(np.int16)), "tie": columns.pop("tie"), "tf": pa.array(tf), "dl": pa.array(dl[row]), **columns}
    out = {"term": words.dictionary.take(by_term.take(pa.array(term[starts]))), **({by: rows[by].combine_chunks().take(first)} if by else {}), "range": pa.array(ranges[row[starts]])}
    out |= {"n": pa.array(ends - starts), "max_tf": pa.array(np.maximum.reduceat(tf, starts)), "min_dl": pa.array(np.minimum.reduceat(dl[row], starts))}
    out["posts"] = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(posts)].astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    batch = pa.RecordBatch.from_pydict(out)
    for i in range(0, batch.num_rows, OUT_BLOCKS):
        yield batch.slice(i, OUT_BLOCKS)


def term_counts(rows: DataFrame, text: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """(term, df, cf): how many rows have a term, and how often it comes in all. Those of a run are counted by numpy, so
    that Spark meets a term once a run."""
    cut = rows.select(tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _runs(batches):
            ts = pa.Table.from_batches(some)["ts"].combine_chunks()
            dl = np.diff(ts.offsets.to_numpy())
            words = ts.flatten().dictionary_encode()
            term, most = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            posts = np.unique(term * len(dl) + np.repeat(np.arange(len(dl)), dl))
            n, all_n = (pa.array(np.bincount(x, minlength=most)) for x in (posts // max(1, len(dl)), term))
            yield pa.RecordBatch.from_pydict({"term": words.dictionary, "n": n, "all_n": all_n})

    small_batches(rows.sparkSession)
    return cut.mapInArrow(run, "term string, n long, all_n long").groupBy("term").agg(F.sum("n").alias("df"), F.sum("all_n").alias("cf"))


def write(blocks: DataFrame, path: str, by: str | None = None) -> None:
    """Blocks as ``build`` gives them, in runs that are in order of terms (and of ``by``): a run is about a row group, and
    of each a search reads the pages of its own terms. A frequent term is in many files, and no posting is shuffled."""
    blocks.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)


def _of_terms(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("term"))


def _weighed(stats: Stats, model: Bm25, tf: Column, dl: Column) -> Column:
    n = F.lit(float(stats.n))
    return model.part(model.idf(n, _of_terms({t: float(d) for t, d in stats.df.items()})), tf, dl, F.lit(float(stats.avgdl)))


def bounds(blocks: DataFrame, stats: Stats, ranges: list[str], model: Bm25 = Bm25()) -> DataFrame:
    """(ranges, bound): the most that a document of each range can score; reads no posting."""
    heads = blocks.select(*ranges, "term", "max_tf", "min_dl")
    return heads.groupBy(*ranges).agg(F.sum(_weighed(stats, model, F.col("max_tf"), F.col("min_dl"))).alias("bound"))


def _doc(at: Column) -> Column:
    """The document's number, of which a posting has the place in its range."""
    return F.col("range") * (1 << BLOCK_BITS) + at


def scored(blocks: DataFrame, stats: Stats, segment: list[str], keep: Column | None = None, model: Bm25 = Bm25()) -> DataFrame:
    """(segment, doc, tie, score) of all documents in the blocks; ``keep`` is a condition on what the postings carry."""
    posts = blocks.select(*segment, "term", "range", F.explode("posts").alias("p")).select(*segment, "term", _doc(F.col("p.at")).alias("doc"), "p.*")
    posts = posts if keep is None else posts.where(keep)
    return posts.groupBy(*segment, "doc").agg(F.first("tie").alias("tie"), F.sum(_weighed(stats, model, F.col("tf"), F.col("dl"))).alias("score"))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best by score, then ``tie``; sums of the same parts in another order count as equal."""
    return hits.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "tie").limit(k)


def search(
    blocks: DataFrame, stats: Stats, k: int, by: str | None = None, segment: str | None = None, keep: Column | None = None,
    dead: DataFrame | None = None, model: Bm25 = Bm25(), first: int = FIRST, met: dict | None = None,
) -> DataFrame:
    """The ``k`` best (segment, doc, tie, score) of blocks of the query's terms: those that a full search gives.

    ``dead`` (segment, doc) are documents that do not count. ``met`` gets how many blocks there were and were read.
    """
    own = [segment] if segment else []
    ranges = [*own, *([by] if by else []), "range"]
    hits = blocks.where(F.col("term").isin(list(stats.df)))

    def scores(some: DataFrame) -> DataFrame:
        found = scored(some, stats, own, keep, model)
        return found if dead is None else found.join(dead.select(*own, "doc"), [*own, "doc"], "left_anti")

    limits = bounds(hits, stats, ranges, model)
    top = limits.orderBy(F.desc("bound"), *ranges).limit(first).collect()  # ``first`` rows
    if not top:
        return scores(hits).select(*own, "doc", "tie", "score").limit(0)
    some = blocks.sparkSession.createDataFrame(top, limits.schema).drop("bound")
    begun = best(scores(hits.join(F.broadcast(some), ranges, "left_semi")), k).collect()  # ``k`` rows
    least = begun[-1]["score"] - 1e-8 if len(begun) == k else float("-inf")
    may = limits.where(F.col("bound") >= least)
    chosen = hits.join(may.select(*ranges), ranges, "left_semi")
    if met is not None:
        met |= {"blocks": hits.count(), "read": chosen.count()}
    return best(scores(chosen), k)


def search_many(blocks: DataFrame, queries: DataFrame, stats: Stats, df: DataFrame, k: int, segment: str | None = None, model: Bm25 = Bm25()) -> DataFrame:
    """The ``k`` best (qid, rank, doc, tie, score) of each row of ``queries`` (qid, term), in one job.

    Ranges of documents, with their postings of the terms that are asked for, meet the queries in parts of about
    ``MANY_DOCS`` documents, and each part gives the ``k`` best of a query: no pair of a query and a document is shuffled.
    Up to ``MAX_TERMS`` terms are broadcast, so that other terms' postings, and their counts, are shuffled nowhere; more
    are joined.
    """
    own = [segment] if segment else []
    idf = model.idf(F.lit(float(stats.n)), F.col("df"))
    terms = queries.select("term").distinct()
    terms = F.broadcast(terms) if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS else terms
    asked = queries.select("qid", "term").distinct().join(df.join(terms, "term", "left_semi"), "term").select("qid", "term", idf.alias("idf"))
    n = max(1, math.ceil(stats.n / MANY_DOCS))
    posts = blocks.join(terms, "term", "left_semi")
    left = posts.select(*own, "term", F.transform("posts.at", _doc).alias("doc"), F.col("posts.tie").alias("tie"), F.col("posts.tf").alias("tf"), F.col("posts.dl").alias("dl"), F.pmod(F.xxhash64(*own, "range"), F.lit(n)).alias("part"))
    right = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))
    kinds = {"qid": asked.schema["qid"].dataType, **{c: left.schema[c].dataType for c in own}, **{c: left.schema[c].dataType.elementType for c in ("doc", "tie")}}
    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds.items()), "score double"])
    avgdl = float(stats.avgdl)

    def scores(rows: pa.Table, words: pa.Table) -> pa.Table:
        size = pc.list_value_length(rows["doc"]).to_numpy().astype(np.int64)
        doc, tie, tf, dl = (pc.list_flatten(rows[c]).combine_chunks() for c in ("doc", "tie", "tf", "dl"))
        home = [rows[c].combine_chunks().take(pa.array(np.repeat(np.arange(len(size)), size))) for c in own]
        who: list[np.ndarray] = [np.empty(0, np.int64)]
        which, what = [np.empty(0, np.int64)], [np.empty(0)]
        if len(doc) and words.num_rows:
            number = np.unique(doc.to_numpy(), return_inverse=True)[1]
            for h in home:
                code = h.dictionary_encode().indices.to_numpy()
                number = number * (int(code.max()) + 1) + code
            _, first, number = np.unique(number, return_index=True, return_inverse=True)
            place = np.empty(len(first), np.int64)  # by ``tie``
            place[pc.array_sort_indices(tie.take(pa.array(first)), null_placement="at_start").to_numpy()] = np.arange(len(first))
            weight = model.part(1.0, tf.to_numpy().astype(float), dl.to_numpy().astype(float), avgdl)
            known = rows["term"].combine_chunks().dictionary_encode()
            term = np.repeat(known.indices.to_numpy(), size)
            order = np.argsort(term, kind="stable")
            ends = np.searchsorted(term[order], np.arange(len(known.dictionary) + 1))
            asked_term = pc.fill_null(pc.index_in(words["term"].combine_chunks(), known.dictionary), -1).to_numpy()
            qid, value = words["qid"].combine_chunks().dictionary_encode().indices.to_numpy(), words["idf"].to_numpy()
            by_query = np.argsort(qid, kind="stable")
            for mine in np.split(by_query, np.flatnonzero(np.diff(qid[by_query])) + 1):
                score, hit = np.zeros(len(first)), np.zeros(len(first), bool)
                for w in mine[asked_term[mine] >= 0]:
                    at = order[ends[asked_term[w]] : ends[asked_term[w] + 1]]
                    score += np.bincount(number[at], value[w] * weight[at], len(first))
                    hit[number[at]] = True
                score, some = np.round(score, 6), np.flatnonzero(hit)
                if len(some) > k:
                    some = some[score[some] >= np.partition(score[some], len(some) - k)[len(some) - k]]
                some = some[np.lexsort((place[some], -score[some]))][:k]
                who.append(np.full(len(some), mine[0]))
                which.append(first[some])
                what.append(score[some])
        at = pa.array(np.concatenate(which))
        return pa.table({"qid": words["qid"].take(pa.array(np.concatenate(who))), **{c: h.take(at) for c, h in zip(own, home)}, "doc": doc.take(at), "tie": tie.take(at), "score": pa.array(np.concatenate(what))})

    small_batches(blocks.sparkSession)
    hits = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(scores, schema)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "tie"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)
