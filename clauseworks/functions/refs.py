"""Citations in provision text, found by regular expressions and resolved against the corpus index.

Each pattern is matched on its own over the whole text; references come in pattern order, then in text order, each
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.functions.text import UNRESOLVED

# What counts as a citation, and the reference it makes.
INTERNAL = (
    (r"(?U)\bs\s*(\d+[A-Z]*)\((\d+[A-Z]*)\)\(([a-z]+)\)", "#sec-$1__subsec-$2__para-$3"),
    (r"(?U)\bs\s*(\d+[A-Z]*)\((\d+[A-Z]*)\)", "#sec-$1__subsec-$2"),
    (r"(?U)\b(?:section|s)\s+(\d+[A-Z]*)", "#sec-$1"),
)
PART = r"(?U)\b(Part|Division)\s+([\dIVX]+[A-Z]?)(?!\s+of\s+the)"
SCHEDULES = (
    (r"(?iuU)\bSchedule\s+(\d+)[,\s]+(?:clause|item|Part)\s+(\d+[A-Z]?)", "#schedule-$1__clause-$2"),
    (r"(?U)\b(?:paragraph|para)\s+\(([a-z])\)", "#para-$1"),
)
OTHER_ACT = r"(?U)\bthe\s+([A-Z][A-Za-z ]+?Act\s+\d{4})"
OTHER_INSTRUMENT = r"(?U)\bthe\s+([A-Z][A-Za-z ]+?(?:Regulation|Instrument|Order|Rules?)\s+\d{4})"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _made(text: Column, pattern: str, ref: str) -> Column:
    return F.transform(_all(text, pattern, 0), lambda m: F.regexp_replace(m, pattern, ref))


def internal_refs(text: Column) -> Column:
    """References within the document of record: sections, parts, schedules and paragraphs."""
    # the two groups of one match: a match taken alone would lose what must not follow it
    parts = F.zip_with(
        _all(text, PART, 1), _all(text, PART, 2), lambda kind, n: F.concat(F.when(kind == "Part", "#part-").otherwise("#dvs-"), n)
    )
    return F.concat(*[_made(text, *p) for p in INTERNAL], parts, *[_made(text, *p) for p in SCHEDULES])


def cited_acts(text: Column) -> Column:
    return _all(text, OTHER_ACT, 1)


def cited_instruments(text: Column) -> Column:
    return F.transform(_all(text, OTHER_INSTRUMENT, 1), lambda n: F.concat(F.lit(UNRESOLVED), n))


#: Documents of record of an index that goes along with every row as one map; a larger index is joined.
MAX_MAP = 5_000


def with_refs(rows: DataFrame, index: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``rows`` and ``refs``. ``index`` has (name, uri), one row a name; ``key`` tells rows apart.

    Names are looked up in a map of the whole index, which is one broadcast row, so that no text is shuffled and ``rows``
    are worked out once. With more than ``MAX_MAP`` names, rows that cite an Act are joined to the index instead. A URI
    that is empty counts as resolved.
    """
    t = F.col(text)
    none = F.array().cast("array<string>")
    index = index.where(F.col("name").isNotNull())
    if index.limit(MAX_MAP + 1).count() <= MAX_MAP:
        book = index.agg(F.map_from_entries(F.collect_list(F.struct("name", "uri"))).alias("_book"))
        acts = F.transform(cited_acts(t), lambda n: F.coalesce(F.try_element_at(F.col("_book"), n), F.concat(F.lit(UNRESOLVED), n)))
        refs = F.array_distinct(F.concat(internal_refs(t), acts, cited_instruments(t)))
        return rows.crossJoin(F.broadcast(book)).withColumn("refs", F.coalesce(refs, none)).drop("_book")  # one row
    named = rows.select(*key, F.posexplode(cited_acts(t)).alias("_pos", "_name"))
    found = named.join(index.select(F.col("name").alias("_name"), F.col("uri").alias("_uri")), "_name", "left")
    found = found.withColumn("_ref", F.coalesce("_uri", F.concat(F.lit(UNRESOLVED), "_name")))
    acts = found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_ref"))), lambda s: s["_ref"]).alias("_acts"))
    refs = F.array_distinct(F.concat(internal_refs(t), F.coalesce("_acts", none), cited_instruments(t)))
    return rows.join(acts, key, "left").withColumn("refs", F.coalesce(refs, none)).drop("_acts")
