"""What the operators share: word definition, shared folder, written tables, running totals."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space between words.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"

_own_dirs: dict[str, str] = {}
#: Folders of the tables that were written and not dropped, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session sets none, and runs in this machine alone, a temporary folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="clauseworks-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[app] = "file://" + folder
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` returned, when nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def written_so_far() -> int:
    return len(_written)


def drop_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Deletes what was written after ``mark`` of ``written_so_far``, but for the table ``keep``."""
    for path in [p for p in _written[mark:] if p != keep._written_at]:
        _delete(spark, path)


def column(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(columns: list[str], prefix: str = "keep") -> list[str]:
    """Names under which columns of any name pass through an operator without a clash."""
    return [f"{prefix}_{i}" for i in range(len(columns))]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def vocabulary_file(name: str) -> str:
    """The vocabulary file is a parameter of the operators; the queries take the installed one."""
    import public_tokenizers

    return os.environ.get("CLAUSEWORKS_VOCABULARY") or public_tokenizers.path(name)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or one like it that no column has."""
    while name in columns:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_count(rows: int) -> int:
    """A power of two, about as many buckets as an evenly spread key has rows in each: the root of ``rows``."""
    n = 1
    while n * n < rows:
        n *= 2
    return n


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` up to and with each row, in ``group``, by ``bucket`` and ``order``.

    A group is dealt out by bucket, so that the largest group needs no task of its own: each bucket is summed
    within, and gets the sum of the buckets before it from a table of one row a bucket. ``bucket`` must never
    fall as ``order`` rises.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(bucket) if not group else Window.partitionBy(*group).orderBy(bucket)
    sums = sums.select(
        *keys,
        F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left = df.withColumn("_within", F.sum(value).over(within)).alias("l")
    right = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = left.join(right, on)
    return joined.withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).drop(
        "_before", "_within", *[f"_k_{k}" for k in keys]
    )


#: A key is hot where it has more than one in HOT of a table's rows: there are fewer than HOT such keys.
HOT = 200


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``left`` joined to ``right`` (one row a key at most) on ``key``, rows without a match kept.

    The rows of hot keys, and those whose key is null, are dealt out by the columns ``by``, and the few rows of
    ``right`` that belong to hot keys are repeated, so that no task gets a whole hot key.
    """
    rows = left.count()
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = [r[0] for r in counts.where(F.col("_n") * HOT > rows).select(key).collect()] if rows > HOT * HOT else []
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    spot = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    dealt = left.withColumn("_part", F.when(is_hot | F.col(key).isNull(), spot).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_part", F.explode(every)), [key, "_part"], "left").drop("_part")
