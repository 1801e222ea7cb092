"""Streams: cached embedding of texts, and versions of provisions into a store (extensions: batch ingest needs neither)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseworks.operators.embedding import EmbedCache, Embedder, last_wins, lookup
from clauseworks.plans import index


def embed_stream(spark: SparkSession, landing: str, schema: str, out: str, cache_path: str, checkpoint: str, embedder: Embedder) -> StreamingQuery:
    """Reads Parquet files as they land, embeds new texts once, and appends rows with vectors.

    A batch that is done again writes its own folder again, so that no row comes twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        cache = EmbedCache(spark, cache_path, embedder.name)
        cache.fill(batch, embedder)
        lookup(batch, cache.read()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(landing)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(spark: SparkSession, landing: str, schema: str, folder: str, checkpoint: str, embedder: Embedder, delay: str = "7 days", tie: str | None = None) -> StreamingQuery:
    """Reads versions (id, version, ts, document, …) of rows as they land, and keeps the newest of each id in a store.

    A version that comes again within ``delay`` is dropped by the stream's state, one that is older than the watermark by
    the watermark, and one that is not newer than what the store has by comparison: so batches may come late, twice or
    in any order, and the store ends up as if all rows had come at once. A batch that is done again changes nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        newest = last_wins(batch, "id", "version")
        if index.current(spark, folder) is not None:
            have = index.read(spark, folder).payload.select("id", F.col("version").alias("_have"))
            newest = newest.join(have, "id", "left").where(F.col("_have").isNull() | (F.col("version") > F.col("_have"))).drop("_have")
        if not newest.isEmpty():
            index.upsert(newest, folder, embedder, tie=tie)

    rows = spark.readStream.schema(schema).parquet(landing).withWatermark("ts", delay)
    rows = rows.where(F.col("id").isNotNull() & F.col("version").isNotNull()).dropDuplicatesWithinWatermark(["id", "version"])
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows the watermark has dropped in a query's batches so far."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
