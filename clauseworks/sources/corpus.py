"""The corpus: its index file, its documents, shards of them, and the roll-up to documents of record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.functions import text as X
from clauseworks.functions.refs import with_refs
from clauseworks.schemas import INDEX_JSON, ORDER
from clauseworks.sources import markup


def index_rows(raw: DataFrame) -> DataFrame:
    """Rows (act_ord, slug, name, xml_path, frbr_expression_uri) of index JSON in ``value``; entries without a name go.

    The order is that of the file; ordinals count the entries that have a name.
    """
    acts = raw.select(F.from_json("value", INDEX_JSON).alias("j")).select(F.posexplode(F.map_entries("j.acts")).alias("pos", "e"))
    one = acts.select(
        "pos", F.col("e.key").alias("slug"), *[F.try_element_at("e.value", F.lit(c)).alias(c) for c in ("name", "xml_path", "frbr_expression_uri")]
    ).where(F.col("name").isNotNull())
    # an index has one row a document of record: thousands, not billions
    return one.withColumn("act_ord", F.row_number().over(Window.orderBy("pos")) - 1).drop("pos")


def read_index(spark: SparkSession, corpus_dir: str) -> DataFrame:
    return index_rows(spark.read.text(f"{corpus_dir}/index.json", wholetext=True))


def act_names(index: DataFrame) -> DataFrame:
    return index.select("name").distinct()


def shard(index: DataFrame, number: int, size: int) -> DataFrame:
    """The documents of one shard, by ordinal: a name that comes twice stays in the shard of each."""
    start, end = X.shard_bounds(index.count(), number, size)
    return index.where((F.col("act_ord") >= start) & (F.col("act_ord") < end))


def resolver(index: DataFrame) -> DataFrame:
    """(name, uri) for citations: of a name that comes twice the last; an entry without a URI has an empty one."""
    last = F.max_by(F.coalesce("frbr_expression_uri", F.lit("")), "act_ord")
    return index.groupBy("name").agg(last.alias("uri"))


def read_provisions(spark: SparkSession, corpus_dir: str, index: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Provisions of the ``chosen`` documents (all, if not given), with references resolved against the whole index."""
    chosen = index if chosen is None else chosen
    # only the chosen files are listed and read
    paths = [r["xml_path"] for r in chosen.select("xml_path").distinct().collect()]
    if not paths:
        return with_refs(markup.parse(spark.createDataFrame([], "act_ord int, act_name string, content binary")), resolver(index), list(ORDER)).withColumn("terms", F.array().cast("array<string>"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(corpus_dir)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    files = spark.read.format("binaryFile").load([f"{corpus_dir}/{p}" for p in paths])
    files = files.select(F.substring("path", len(root) + 2, 1_000_000).alias("xml_path"), "content")
    joined = files.join(chosen.select("act_ord", F.col("name").alias("act_name"), "xml_path"), "xml_path")
    rows = with_refs(markup.parse(joined), resolver(index), list(ORDER))
    return rows.withColumn("terms", F.array().cast("array<string>"))


def roll_up(provisions: DataFrame) -> DataFrame:
    """One row a document of record: of its first provision the URI, its year and date, and counts by kind."""
    first = F.struct(*ORDER)
    acts = provisions.groupBy("act_name").agg(
        F.min("act_ord").alias("act_ord"),
        F.min_by("frbr_uri", first).alias("frbr_uri"),
        F.count_if(F.col("provision_type") == "section").alias("section_count"),
        F.count_if(F.col("provision_type") == "schedule_clause").alias("schedule_clause_count"),
    )
    uri = F.coalesce("frbr_uri", F.lit(""))
    return acts.select("act_name", "frbr_uri", X.year_int(uri).alias("year"), X.as_at(uri).alias("as_at_date"), "section_count", "schedule_clause_count", "act_ord")


def kind_counts(provisions: DataFrame, *by: str) -> DataFrame:
    return provisions.groupBy(*by, "provision_type").agg(F.count("*").alias("n"))


def missing(wanted: DataFrame, have: DataFrame, name: str = "name") -> DataFrame:
    """Names in ``wanted`` and not in ``have``, each once, in code-point order."""
    return wanted.select(name).distinct().join(have.select(name), name, "left_anti").orderBy(name)
