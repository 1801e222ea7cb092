"""Embedders, and the cache that spares embedding a text again."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.functions.text import content_key
from clauseworks.operators.batches import small_batches
from clauseworks.schemas import CACHE


class Embedder(Protocol):
    """``name`` goes with the cache; ``kind`` is passage or query, which a model may embed differently."""

    name: str
    dim: int

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed feature hashing of words (Weinberger et al. 2009), to length 1: deterministic, and without a model."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"hashing-{dim}"

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"[^\W_]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


def embed_texts(texts: DataFrame, embedder: Embedder, kind: str = "passage") -> DataFrame:
    """(id, vector) of (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "vector": embedder.embed(batch["text"].tolist(), kind)})

    small_batches(texts.sparkSession)
    return texts.select("id", "text").mapInPandas(run, CACHE)


def lookup(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``key`` and ``vector``: null where the cache has none."""
    return texts.withColumn("key", content_key(F.col(text))).join(cache.select(F.col("id").alias("key"), "vector"), "key", "left")


def hit_counts(looked_up: DataFrame) -> DataFrame:
    """One row (hits, misses): texts that come twice count twice."""
    return looked_up.agg(F.count_if(F.col("vector").isNotNull()).alias("hits"), F.count_if(F.col("vector").isNull()).alias("misses"))


def misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(id, text) of what the cache lacks, each text once."""
    keyed = texts.select(content_key(F.col(text)).alias("id"), F.col(text).alias("text"))
    return keyed.join(cache.select("id"), "id", "left_anti").dropDuplicates(["id"])


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the row of the greatest ``seq``; each task keeps one row a key before anything is shuffled."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.select(*[F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in rows.columns])


class EmbedCache:
    """A Parquet table of vectors by content key, beside the name of the model that made them."""

    def __init__(self, spark: SparkSession, path: str, model: str | None = None):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        if model is not None:
            known = self.model_name()
            if known is None:
                self._record(model)
            elif known != model:
                raise ValueError(f"the cache holds vectors of {known!r}, not of {model!r}")

    def _exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _record(self, model: str) -> None:
        self.spark.createDataFrame([("model_name", model)], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    def model_name(self) -> str | None:
        if not self._exists("meta"):
            return None
        row = self.spark.read.parquet(f"{self.path}/meta").where("key = 'model_name'").first()
        return row["value"] if row else None

    def read(self) -> DataFrame:
        if not self._exists("vectors"):
            return self.spark.createDataFrame([], CACHE)
        return self.spark.read.schema(CACHE).parquet(f"{self.path}/vectors")

    def put(self, vectors: DataFrame) -> None:
        """Appends (id, vector) of keys that the cache lacks."""
        new = vectors.select("id", "vector").dropDuplicates(["id"]).join(self.read().select("id"), "id", "left_anti")
        new.write.mode("append").parquet(f"{self.path}/vectors")

    def fill(self, texts: DataFrame, embedder: Embedder, text: str = "text") -> None:
        """Embeds what the cache lacks, each text once."""
        self.put(embed_texts(misses(texts, self.read(), text), embedder))


def merge_caches(spark: SparkSession, paths: list[str], out: str) -> int:
    """Merges caches, later ones first in right; all must be of one model, which goes along. Returns rows read."""
    models = {EmbedCache(spark, p).model_name() for p in paths}
    if len(models) > 1:
        raise ValueError(f"caches of different models: {sorted(map(str, models))}")
    parts = [EmbedCache(spark, p).read().withColumn("_seq", F.lit(i)) for i, p in enumerate(paths)]
    if not parts:
        return 0
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    last_wins(every, "id", "_seq").drop("_seq").write.mode("overwrite").parquet(f"{out.rstrip('/')}/vectors")
    model = models.pop()
    if model is not None:
        EmbedCache(spark, out, model)
    return every.count()
