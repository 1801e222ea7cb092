"""What goes to and from Python workers: many small rows in one batch, no more than a set number of bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from clauseworks.operators import batches, embedding
from clauseworks.sources import markup

NS = "http://docs.oasis-open.org/legaldocml/ns/akn/3.0"


def document(i):
    return f'<akomaNtoso xmlns="{NS}"><act><body><section eId="sec-{i}"><num>{i}</num><content><p>Text {i}.</p></content></section></body></act></akomaNtoso>'.encode()


def test_rows_of_many_documents_are_one_batch(monkeypatch):
    n = 500
    given = pa.RecordBatch.from_pydict({"act_ord": pa.array(range(n), pa.int32()), "act_name": ["A"] * n, "content": [document(i) if i % 2 else f'<x xmlns="{NS}"/>'.encode() for i in range(n)]})
    [out] = markup.parsed([given])
    assert out["text"].to_pylist() == [f"{i} Text {i}." for i in range(1, n, 2)]
    monkeypatch.setattr(markup, "OUT_BYTES", 1000)
    cut = list(markup.parsed([given]))
    assert 5 < len(cut) < n and pa.Table.from_batches(cut).to_pylist() == out.to_pylist()


class Counting:
    name, dim = "counting", 2

    def embed(self, texts, kind):
        return [[float(len(texts)), float(sum(map(len, texts)))] for _ in texts]


def test_an_embedder_gets_bounded_batches(spark):
    short = spark.range(9000).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text"))
    assert embedding.embed_texts(short, Counting()).agg(F.max(F.col("vector")[0])).first()[0] <= batches.ROWS
    long = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    assert embedding.embed_texts(long, Counting()).agg(F.max(F.col("vector")[1])).first()[0] <= batches.BYTES + 100_000
