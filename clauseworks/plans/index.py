"""A collection on disk: segments of rows that never change, and a manifest a version that says which of them count.

A change writes what it changes: a *segment* (payload, vectors by list, postings in blocks, term counts) of the new
rows, a *tombstone* table of the rows of older segments whose ids came again, and a manifest that names all that
count. Manifests are numbered, and one is never replaced: of two writers of the same number the second fails and
changes nothing. Readers take the newest manifest and go on with it, as nothing that it names is deleted before
``vacuum`` is told to, by age. ``compact`` makes one segment of the rows that count.

Rows are numbered within a segment (``doc``), in the order in which they are stored: by document of record, then by
place. So rows that a search has found are read by number, and files and row groups that hold none of them are passed
over. Vectors and postings carry the document of record and the kind, so that filters reach them as they reach the
payload, without a join.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.operators import dense, embedding, ivf, postings
from clauseworks.schemas import ORDER
from clauseworks.sources.markup import KINDS

PROVISIONS, ACTS = "legislation_section", "legislation"
MANIFESTS = "manifests"
#: The column by which rows are stored together, and the one that is carried along for filters.
GROUP, CARRIED = "act_name", "provision_type"
#: How texts are stored.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


class Conflict(RuntimeError):
    """Another writer made the next version first."""


def provision_documents(provisions: DataFrame) -> DataFrame:
    """Payload rows with a deterministic ``id``: indexing again makes no second copy."""
    name = F.concat_ws("\x1f", "act_name", "frbr_uri", "provision_type", "eid", F.col("prov_ord").cast("string"))
    return provisions.drop("terms").withColumn("id", F.sha2(name, 256)).withColumn("document", F.col("text"))


def act_documents(acts: DataFrame) -> DataFrame:
    """Documents of record are indexed by name and year, with a dash between."""
    return acts.withColumn("id", F.sha2(F.concat_ws("\x1f", "act_name", "frbr_uri"), 256)).withColumn("document", F.concat_ws(" — ", "act_name", F.col("year").cast("string")))


# files


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, age in milliseconds since 1970) of what lies in a folder."""
    fs, at = _fs(spark, folder)
    return sorted((f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(name.removesuffix(".json")) for name, _ in _listed(spark, f"{folder}/{MANIFESTS}") if name.endswith(".json")]


def current(spark: SparkSession, folder: str) -> int | None:
    """The number of the collection's newest version, if there is one."""
    return max(versions(spark, folder), default=None)


def _manifest(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/{MANIFESTS}/{version:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, folder: str, version: int, manifest: dict) -> None:
    """Makes a version: its file is written aside and then renamed, which fails if there is one of this number."""
    fs, draft = _fs(spark, f"{folder}/{MANIFESTS}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    at = _fs(spark, f"{folder}/{MANIFESTS}/{version:012d}.json")[1]
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {folder} is there already")


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write has shuffled goes when it is written, and not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# reading


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """A table of a segment; a document that is the row's text is stored as the text alone."""
    rows = spark.read.parquet(path)
    return rows.withColumn("document", F.when(F.col("_same"), F.col("text")).otherwise(F.col("document"))).drop("_same") if "_same" in rows.columns else rows


def _marked(rows: DataFrame, docs: DataFrame, keep: bool) -> DataFrame:
    """``rows`` whose ``doc`` is (``keep``) or is not in ``docs``: these are broadcast as a bit a document of the segment,
    4 KB for 32,768 numbers, so that no text or vector is shuffled."""
    bits = docs.groupBy(F.bitmap_bucket_number("doc").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc")).alias("_bits"))
    bit = "getbit(cast(conv(hex(substring(_bits, cast(bitmap_bit_position(doc) div 8 + 1 as int), 1)), 16, 10) as bigint), cast(bitmap_bit_position(doc) % 8 as int))"
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number("doc")).join(F.broadcast(bits), "_bucket", "inner" if keep else "left")
    return joined.where(F.expr(f"coalesce({bit}, 0) = {int(keep)}")).drop("_bucket", "_bits")


@dataclass(frozen=True)
class Collection:
    """One version, whatever is changed meanwhile."""

    spark: SparkSession
    folder: str
    version: int
    manifest: dict

    def _raw(self, segment: dict, table: str) -> DataFrame:
        return _stored(self.spark, f"{self.folder}/{segment['name']}/{table}").withColumn("segment", F.lit(segment["name"]))

    def _every(self, table: str) -> DataFrame:
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [self._raw(s, table) for s in self.manifest["segments"]])

    @property
    def dead(self) -> DataFrame | None:
        """(segment, id, doc) of rows that do not count any more."""
        names = self.manifest["dead"]
        return self.spark.read.parquet(*[f"{self.folder}/{n}/rows" for n in names]) if names else None

    def live(self, table: str, but: DataFrame | None = None) -> DataFrame:
        """Rows that count of payload, vectors or codes, without those that ``but`` (segment, doc) names; only segments
        with tombstones are joined to these."""
        hit = set(self.manifest["touched"])
        parts = []
        for s in self.manifest["segments"]:
            rows = self._raw(s, table)
            for gone in ([self.dead] if s["name"] in hit else []) + ([] if but is None else [but]):
                rows = _marked(rows, gone.where(F.col("segment") == s["name"]), False)
            parts.append(rows)
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    @property
    def payload(self) -> DataFrame:
        return self.live("payload").drop("segment", "doc", "tie", "dl")

    @property
    def vectors(self) -> DataFrame:
        return self.live("vectors")

    @property
    def codes(self) -> DataFrame | None:
        return self.live("codes") if self.manifest["segments"] and all(s["coded"] for s in self.manifest["segments"]) else None

    @property
    def blocks(self) -> DataFrame:
        return self._every("postings")

    @property
    def n(self) -> int:
        return self.manifest["n"]

    def term_stats(self) -> DataFrame:
        """(term, df), exact: of all segments, less what the tombstones take away."""
        df = self._every("term_stats").select("term", "df")
        for name in self.manifest["dead"]:
            df = df.unionByName(self.spark.read.parquet(f"{self.folder}/{name}/terms").select("term", (-F.col("df")).alias("df")))
        return df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def stats(self, terms: list[str]) -> postings.Stats:
        rows = self.term_stats().where(F.col("term").isin(terms)).collect()  # one a term
        return postings.Stats(float(self.n), self.manifest["length"] / max(1, self.n), {r["term"]: float(r["df"]) for r in rows})

    def search_words(self, terms: list[str], k: int, keep: dict[str, str] | None = None, met: dict | None = None) -> DataFrame:
        """The ``k`` best (segment, doc, tie, score) by BM25; ``keep`` are values that columns must have."""
        stats, blocks, inner = self.stats(terms), self.blocks, None
        for name, value in (keep or {}).items():
            if name == GROUP:
                blocks = blocks.where(F.col(name) == value)
            else:
                inner = F.col(name) == value if inner is None else inner & (F.col(name) == value)
        by = GROUP if GROUP in blocks.columns else None
        return postings.search(blocks, stats, k, by, "segment", inner, self.dead, met=met)

    def search_vector(self, query: list[float], k: int, keep: dict[str, str] | None = None, probes: int | None = None, met: dict | None = None) -> DataFrame:
        """The ``k`` best (segment, doc, tie, score) by cosine: exact, or, with ``probes``, among so many lists."""
        vectors, codes = self.vectors, self.codes
        for name, value in (keep or {}).items():
            vectors = vectors.where(F.col(name) == value)
            codes = None if codes is None else codes.where(F.col(name) == value)
        row = F.struct("segment", "doc", "tie").alias("id")
        narrow = vectors.select(row, "vector", *(["list", "near"] if "list" in vectors.columns else []))
        centroids = self.manifest.get("centroids")
        if codes is not None:
            found = dense.rescored(narrow, codes.select(row, "code"), query, k)
        elif centroids and probes:
            found = ivf.search(narrow, centroids, None, query, k, probes, met=met)
        else:
            found = dense.cosine_scores(narrow, query)
        return postings.best(found.select("id.*", "score"), k)

    def fetch(self, hits: DataFrame) -> DataFrame:
        """Payload of a few (segment, doc, …): only row groups with one of these numbers are read."""
        rows = hits.collect()
        few = self.spark.createDataFrame(rows, hits.schema)
        wanted: dict[str, list[int]] = {}
        for r in rows:
            wanted.setdefault(r["segment"], []).append(r["doc"])
        parts = [self._raw(s, "payload").where(F.col("doc").isin(wanted[s["name"]])) for s in self.manifest["segments"] if s["name"] in wanted]
        if not parts:
            return self._every("payload").join(few.drop("tie"), ["segment", "doc"])
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).join(F.broadcast(few.drop("tie")), ["segment", "doc"])

    def scroll(self, after: str | None, size: int, where: Column | None = None) -> tuple[list, str | None]:
        """A page of payload rows in stored order, and the cursor to go on from, if there is more.

        The cursor holds the last row's place, so that a page is found by pushed-down comparisons and never by counting.
        """
        order = [c for c in (GROUP, *ORDER) if c in self.payload.columns]
        rows = self.payload if where is None else self.payload.where(where)
        if after is not None:
            last = json.loads(bytes.fromhex(after))
            steps = [reduce(lambda x, y: x & y, [*[F.col(c).eqNullSafe(v) for c, v in zip(order[:i], last)], F.col(order[i]) > last[i]]) for i in range(len(order))]
            ids = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(v) for c, v in zip(order, last)])
            rows = rows.where(reduce(lambda x, y: x | y, steps, ids & (F.col("id") > last[-1]))).where(F.col(order[0]) >= last[0])
        page = rows.orderBy(*order, "id").limit(size + 1).collect()
        more = len(page) > size
        page = page[:size]
        return page, json.dumps([*[page[-1][c] for c in order], page[-1]["id"]]).encode().hex() if more else None


def read(spark: SparkSession, folder: str, version: int | None = None) -> Collection:
    """The newest version, or one that was before and is not deleted yet."""
    version = current(spark, folder) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no collection in {folder}")
    return Collection(spark, folder, version, _manifest(spark, folder, version))


# writing


def _vectors(docs: DataFrame, embedder: embedding.Embedder, cache: embedding.EmbedCache | None) -> DataFrame:
    texts = docs.select("id", F.col("document").alias("text"))
    if cache is None:
        return embedding.embed_texts(texts, embedder)
    cache.fill(texts, embedder)
    return embedding.lookup(texts, cache.read()).select("id", "vector")


def _segment(docs: DataFrame, folder: str, vectors_of, quantised: bool, centroids: list | None, tie: str | None, ranged: bool = True) -> dict:
    """Writes a segment of (id, document, …); the rows are counted as they are written.

    ``ranged``: in order over all files; else each task's rows are in order, and no text is shuffled.
    """
    spark = docs.sparkSession
    name = f"segment-{uuid.uuid4().hex}"
    at = f"{folder}/{name}"
    order = [c for c in (GROUP, *ORDER) if c in docs.columns]
    rows = docs.withColumn("tie", F.col(tie).cast("long") if tie else F.xxhash64("id"))
    if "text" in docs.columns:
        rows = rows.withColumn("_same", F.col("document").eqNullSafe(F.col("text"))).withColumn("document", F.when(~F.col("_same"), F.col("document")))
    if order:
        rows = (rows.repartitionByRange(*order, "id") if ranged else rows).sortWithinPartitions(*order, "id")
    rows = rows.withColumn("doc", F.monotonically_increasing_id())
    seen, cut, kinds = Observation(), Observation(), KINDS if CARRIED in docs.columns else ()
    counted = [F.count_if(F.col(CARRIED) == kind).alias(kind) for kind in kinds]
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counted).write.options(**PACKED).parquet(f"{at}/payload")
    stored = _stored(spark, f"{at}/payload")
    named = [c for c in (GROUP, CARRIED) if c in stored.columns]
    vectors = vectors_of(stored).select("id", "vector").join(stored.select("id", "doc", "tie", *named), "id")
    if centroids:
        # a few files a list, and more of a large one
        ivf.filed(vectors, centroids).hint("rebalance", "list").write.partitionBy("list").parquet(f"{at}/vectors")
    else:
        vectors.repartitionByRange("doc").sortWithinPartitions("doc").write.parquet(f"{at}/vectors")
    if quantised:
        dense.quantise(spark.read.parquet(f"{at}/vectors")).select("id", "doc", "tie", *named, "code").write.parquet(f"{at}/codes")
    by = GROUP if GROUP in stored.columns else None
    # texts are cut into terms here alone, and lengths are counted as they are
    postings.write(postings.build(stored, by, tuple(c for c in named if c != GROUP), "document", seen=cut), f"{at}/postings", by)
    spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{at}/term_stats")
    length = round(cut.get["n"] * (cut.get["avgdl"] or 0.0))  # exact below 2^50 words
    return {"name": name, "rows": seen.get["rows"], "length": length, "kinds": {k: seen.get[k] for k in kinds if seen.get[k]}, "coded": quantised}


def _bury(old: Collection, new: DataFrame, folder: str) -> tuple[str | None, dict, int, int]:
    """Writes tombstones for the rows of ``old`` whose ids ``new`` has: (their table, counts by segment, rows, length)."""
    spark = old.spark
    name = f"dead-{uuid.uuid4().hex}"
    rows = old.live("payload").select("segment", "id", "doc").join(new.select("id"), "id", "left_semi")
    rows.write.parquet(f"{folder}/{name}/rows")
    rows = spark.read.parquet(f"{folder}/{name}/rows")
    counts = {r["segment"]: r for r in rows.groupBy("segment").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).collect()}
    if not counts:
        fs, at = _fs(spark, f"{folder}/{name}")
        fs.delete(at, True)
        return None, {}, 0, 0
    parts = []
    for s in old.manifest["segments"]:
        if r := counts.get(s["name"]):  # one row a segment
            near = old._raw(s, "payload").where(F.col("doc").between(r["a"], r["b"])).select("doc", "document")
            parts.append(_marked(near, rows.where(F.col("segment") == s["name"]), True))
    postings.term_counts(reduce(DataFrame.unionByName, parts), "document").write.parquet(f"{folder}/{name}/terms")
    length = spark.read.parquet(f"{folder}/{name}/terms").agg(F.sum("cf")).first()[0] or 0
    return name, counts, sum(r["n"] for r in counts.values()), length


def _last(docs: DataFrame) -> DataFrame:
    """Of rows with one id the last by place; texts are shuffled for that only where an id comes twice."""
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return docs
    place = F.struct(*[c for c in (*ORDER, "document") if c in docs.columns])
    return embedding.last_wins(docs.withColumn("_place", place), "id", "_place").drop("_place")


def upsert(
    docs: DataFrame, folder: str, embedder: embedding.Embedder, cache: embedding.EmbedCache | None = None, quantised: bool = False, lists: int = 0, tie: str | None = None
) -> dict:
    """Adds ``docs`` (id, document and payload columns) to the collection, which is made if there is none.

    Rows of an id that is there already take its place, all others stay as and where they are. Returns the new
    segment's entry. ``lists``: of a new collection, file vectors under so many centroids. ``tie`` names the column
    that decides between equal scores.
    """
    spark = docs.sparkSession
    version = current(spark, folder)
    old = read(spark, folder, version) if version is not None else None
    base = old.manifest if old else {"segments": [], "dead": [], "touched": [], "n": 0, "length": 0, "centroids": None}
    centroids = base["centroids"]

    def vectors(stored: DataFrame) -> DataFrame:
        return _vectors(stored, embedder, cache)

    with _shuffles_freed(spark):
        docs = _last(docs)
        if lists and not base["segments"]:
            centroids = ivf.train(vectors(docs), lists)
        segment = _segment(docs, folder, vectors, quantised, centroids, tie)
    manifest = {**base, "centroids": centroids, "segments": [*base["segments"], segment], "n": base["n"] + segment["rows"], "length": base["length"] + segment["length"]}
    if old:
        with _shuffles_freed(spark):
            table, touched, n, length = _bury(old, spark.read.parquet(f"{folder}/{segment['name']}/payload"), folder)
        manifest |= {"dead": base["dead"] + ([table] if table else []), "touched": sorted({*base["touched"], *touched}), "n": manifest["n"] - n, "length": manifest["length"] - length}
    _commit(spark, folder, (version or 0) + 1, manifest)
    return segment


def _whole(spark: SparkSession, folder: str, payload: DataFrame, vectors: DataFrame, quantised: bool, centroids: list | None, tie: str | None, ranged: bool = True) -> None:
    """A version of one segment, of rows whose vectors are there."""
    version = current(spark, folder) or 0
    with _shuffles_freed(spark):
        segment = _segment(payload, folder, lambda stored: vectors, quantised, centroids, tie, ranged)
    _commit(spark, folder, version + 1, {"segments": [segment], "dead": [], "touched": [], "n": segment["rows"], "length": segment["length"], "centroids": centroids})


def compact(spark: SparkSession, folder: str, tie: str | None = None) -> None:
    """Makes one segment of all rows that count; nothing is embedded again, and readers go on with what they read."""
    old = read(spark, folder)
    _whole(spark, folder, old.payload, old.vectors.select("id", "vector"), old.codes is not None, old.manifest["centroids"], tie)


def vacuum(spark: SparkSession, folder: str, keep_hours: float = 24 * 7) -> list[str]:
    """Deletes versions older than ``keep_hours``, but never the newest, and what no version that is left names."""
    cut = time.time() * 1000 - keep_hours * 3_600_000
    ages = {int(n.removesuffix(".json")): t for n, t in _listed(spark, f"{folder}/{MANIFESTS}") if n.endswith(".json")}
    left = {v for v, t in ages.items() if t >= cut or v == max(ages)}
    named = set()
    for v in left:
        m = _manifest(spark, folder, v)
        named |= {s["name"] for s in m["segments"]} | set(m["dead"])
    gone = []
    for v in sorted(set(ages) - left):
        fs, at = _fs(spark, f"{folder}/{MANIFESTS}/{v:012d}.json")
        fs.delete(at, False)
    for name, age in _listed(spark, folder):
        # what is younger may belong to a change that is not committed yet
        if name.startswith(("segment-", "dead-")) and name not in named and age < cut:
            fs, at = _fs(spark, f"{folder}/{name}")
            fs.delete(at, True)
            gone.append(name)
    return gone


def merge(spark: SparkSession, folders: list[str], out: str, quantised: bool = False, tie: str | None = None) -> int:
    """Merges collections without embedding anything again; of equal ids the last folder's wins. Returns rows read.

    Only ids are shuffled: rows of a file stay together, in their order (``compact`` orders all).
    """
    parts = [read(spark, f) for f in folders]
    rows = [c.live("payload").select("id", "segment", "doc", F.lit(i).alias("_seq")) for i, c in enumerate(parts)]
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_seq")))
    at = f"{out}/lost-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        reduce(DataFrame.unionByName, rows).withColumn("_nth", nth).where("_nth > 1").select("_seq", "segment", "doc").write.parquet(at)
    lost = spark.read.parquet(at)
    payload, vectors = (
        reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [c.live(table, lost.where(F.col("_seq") == i)) for i, c in enumerate(parts)])
        for table in ("payload", "vectors")
    )
    _whole(spark, out, payload.drop("segment", "doc", "tie", "dl"), vectors.select("id", "vector"), quantised, None, tie, False)
    fs, path = _fs(spark, at)
    fs.delete(path, True)
    return sum(c.n for c in parts)
