"""The engine: ingest a corpus, search it, look things up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import visible_refs
from clauseworks.operators import fusion, lexical, lookup
from clauseworks.operators.embedding import EmbedCache, Embedder, HashingEmbedder, merge_caches
from clauseworks.plans import index, render
from clauseworks.sources import corpus


class NotFound(LookupError):
    pass


def _act_fields() -> list[Column]:
    """A document of record; a date that is lacking is empty, and a count 0."""
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("section_count", "schedule_clause_count")]
    return [F.col("act_name"), F.col("frbr_uri"), F.col("year"), F.coalesce("as_at_date", F.lit("")).alias("as_at_date"), *counts]


class Engine:
    """``quantised``: what is written has eight-bit codes of its vectors, too, by which searches then choose first.

    ``lists``: a new store files its vectors under so many centroids, of which a search reads the nearest ``probes``.
    """

    def __init__(
        self, spark: SparkSession, storage: str, embedder: Embedder | None = None, rrf_constant: int = 60, quantised: bool = False, lists: int = 0, probes: int | None = None
    ):
        self.spark, self.storage = spark, storage.rstrip("/")
        self.embedder = embedder or HashingEmbedder()
        self.rrf_constant, self.quantised, self.lists, self.probes = rrf_constant, quantised, lists, probes

    def _payload(self, name: str) -> DataFrame:
        return index.read(self.spark, f"{self.storage}/{name}").payload

    # ingest

    def ingest(self, corpus_dir: str, cache_path: str | None = None, shard: tuple[int, int] | None = None) -> dict:
        """Parses, rolls up and adds a corpus, or one shard (number, size) of it, to the store. Returns its counts and missing names."""
        listed = corpus.read_index(self.spark, corpus_dir).persist()
        chosen = corpus.shard(listed, *shard) if shard else listed
        if chosen.isEmpty():
            listed.unpersist()
            return {"provisions": 0, "acts": 0, "missing": []}
        cache = EmbedCache(self.spark, cache_path, self.embedder.name) if cache_path else None
        rows = corpus.read_provisions(self.spark, corpus_dir, listed, chosen)
        folders = [f"{self.storage}/{name}" for name in (index.PROVISIONS, index.ACTS)]
        # counts are taken while rows are written
        new = index.upsert(index.provision_documents(rows), folders[0], self.embedder, cache, self.quantised, self.lists)
        names = chosen.select(F.col("name").alias("act_name")).distinct()
        acts = corpus.roll_up(self._payload(index.PROVISIONS).join(names, "act_name", "left_semi"))
        made = index.upsert(index.act_documents(acts), folders[1], self.embedder, cache, self.quantised)
        here = self.spark.read.parquet(f"{folders[0]}/{new['name']}/payload").select(F.col("act_name").alias("name"))
        gap = [r["name"] for r in corpus.missing(chosen.select("name"), here).collect()]  # the index has thousands of names, not billions
        listed.unpersist()
        return {"provisions": new["rows"], "kinds": new["kinds"], "acts": made["rows"], "missing": gap[:10], "missing_count": len(gap)}

    def merge(self, storages: list[str], caches: list[str] | None = None, cache_out: str | None = None) -> dict[str, int]:
        """Merges shards' storages, and their caches, into this one."""
        if caches and len(caches) != len(storages):
            raise ValueError("give a cache for each storage")
        read = {c: index.merge(self.spark, [f"{s.rstrip('/')}/{c}" for s in storages], f"{self.storage}/{c}", self.quantised) for c in (index.PROVISIONS, index.ACTS)}
        if caches and cache_out:
            read["cache"] = merge_caches(self.spark, caches, cache_out)
        return read

    # search

    def _hybrid(self, name: str, query: str, limit: int, keep: dict[str, str] | None = None) -> DataFrame:
        """Payload of the best, with ``score`` and ``rank``. Filters reach vectors and postings, which carry what they ask for."""
        c = index.read(self.spark, f"{self.storage}/{name}")
        [q] = self.embedder.embed([query], "query")
        terms = lexical.query_terms(self.spark, query)
        branches = [c.search_vector(q, 2 * limit, keep, self.probes)]
        if terms:
            branches.append(c.search_words(terms, 2 * limit, keep))
        named = [b.select(F.struct("tie", "segment", "doc").alias("id"), "score") for b in branches]
        best = fusion.fuse(named, limit, self.rrf_constant, None)
        best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # ``limit`` rows
        return c.fetch(best.select("id.*", "score", "rank"))

    def search_provisions(self, query: str, limit: int = 10, act: str | None = None, provision_type: str | None = None) -> DataFrame:
        keep = {k: v for k, v in (("act_name", act), ("provision_type", provision_type)) if v}
        none = F.array().cast("array<string>")
        found = self._hybrid(index.PROVISIONS, query, limit, keep)
        return found.select("rank", "score", "act_name", "frbr_uri", "eid", "provision_num", "provision_type", "heading", "text", visible_refs(F.coalesce("refs", none)).alias("refs"))

    def search_acts(self, query: str, limit: int = 5) -> DataFrame:
        return self._hybrid(index.ACTS, query, limit).select("rank", "score", *_act_fields())

    def search_text(self, query: str, limit: int = 5, act: str | None = None, provision_type: str | None = None) -> str:
        return render.text(self.search_provisions(query, limit, act, provision_type))

    # maintenance

    def compact(self) -> None:
        """Makes one segment of each collection's rows."""
        for name in (index.PROVISIONS, index.ACTS):
            index.compact(self.spark, f"{self.storage}/{name}")

    def vacuum(self, keep_hours: float = 24 * 7) -> list[str]:
        """Deletes what only versions older than ``keep_hours`` have."""
        return [gone for name in (index.PROVISIONS, index.ACTS) for gone in index.vacuum(self.spark, f"{self.storage}/{name}", keep_hours)]

    def scroll(self, name: str = index.PROVISIONS, after: str | None = None, size: int = 500) -> tuple[list[dict], str | None]:
        """A page of a collection, and the cursor of the next."""
        page, cursor = index.read(self.spark, f"{self.storage}/{name}").scroll(after, size)
        return [r.asDict() for r in page], cursor

    # look-ups

    def act_metadata(self, name: str) -> dict:
        rows = self._payload(index.ACTS).where(F.col("act_name") == name)
        row = rows.select(*_act_fields()).limit(1).first()
        if row is None:
            raise NotFound(name)
        return row.asDict()

    def _provisions(self, name: str, cap: int | None) -> DataFrame:
        rows = self._payload(index.PROVISIONS).where(F.col("act_name") == name)
        return lookup.capped(rows, cap, *index.ORDER)

    def act_provisions(self, name: str, cap: int | None = lookup.CAP) -> DataFrame:
        """Provisions in reading order; a name that is not known has none."""
        order = lookup.reading_order(F.col("provision_type"), F.col("eid"), *index.ORDER)
        return self._provisions(name, cap).orderBy(*order).select("act_name", "frbr_uri", "eid", "provision_num", "provision_type", "heading", "text", "refs")

    def act_text(self, name: str, cap: int | None = lookup.CAP) -> str:
        rows = self._provisions(name, cap)
        keyed = rows.select(
            "act_name", "text", F.when(F.col("provision_type") == "section", 0).otherwise(1).alias("first"), lookup.natural_key(F.col("eid")).alias("key"), *index.ORDER
        )
        row = lookup.joined_text(keyed, ["act_name"], ["first", "key", *index.ORDER]).first()
        return row["text"] if row else ""
