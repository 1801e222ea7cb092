"""Search results as text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseworks.functions import text as X

NOTHING = "No results found."


@F.udf(T.StringType())
def two_digits(score):
    """The score as Python rounds it; only the few rows of a result come here."""
    return None if score is None else f"{score:.2f}"


def head(score: Column) -> Column:
    uri = F.coalesce("frbr_uri", F.lit(""))
    dated = X.as_at(uri)
    cited = X.citation(F.col("act_name"), uri, F.col("provision_type"), F.col("eid"), F.col("provision_num"))
    date = F.when(dated != "", F.concat(F.lit(" (as at "), dated, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), cited, F.lit(" ("), F.col("eid"), F.lit(") score="), score, date, F.lit("]"))


def body() -> Column:
    shown = X.visible_refs(F.coalesce("refs", F.array().cast("array<string>")))
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("\n"), "heading")).otherwise("")
    refs = F.when(F.size(shown) > 0, F.concat(F.lit("\nRefs: "), F.array_join(shown, ", "))).otherwise("")
    return F.concat(heading, F.lit("\n"), "text", refs)


def blocks(results: DataFrame) -> DataFrame:
    """(rank, block) of results with a score and a rank."""
    return results.select("rank", F.concat(head(two_digits("score")), body()).alias("block"))


def text(results: DataFrame) -> str:
    rows = blocks(results).orderBy("rank").collect()  # as many as were asked for
    return "\n\n".join(r["block"] for r in rows) if rows else NOTHING
