"""Scalar functions as Column expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNRESOLVED = "unresolved:"
#: Fixed value: the namespace of content keys (the DNS namespace of RFC 4122).
KEY_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
#: A token of the default tokenizer ends at anything that is neither letter nor number.
TOKEN_GAP = r"[^\p{L}\p{N}]+"


def squeeze(c: Column) -> Column:
    """Runs of white space, of any script and the information separators, to one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def year_text(uri: Column) -> Column:
    """The fifth part of the URI's path, or an empty string."""
    return F.coalesce(F.try_element_at(F.split(uri, "/"), F.lit(5)), F.lit(""))


def year_int(uri: Column) -> Column:
    return F.coalesce(year_text(uri).try_cast("int"), F.lit(0))


def as_at(uri: Column) -> Column:
    """What stands between the last ``@`` and the slash after it, or an empty string."""
    return F.when(F.contains(uri, F.lit("@")), F.substring_index(F.substring_index(uri, "@", -1), "/", 1)).otherwise("")


def as_at_date(uri: Column) -> Column:
    return F.try_to_date(as_at(uri), "yyyy-MM-dd")


def schedule_number(eid: Column) -> Column:
    """Of the first ``schedule-`` part of the id, or a question mark."""
    first = F.get(F.filter(F.split(eid, "__"), lambda p: F.startswith(p, F.lit("schedule-"))), F.lit(0))
    return F.coalesce(F.substring(first, 10, 1_000_000), F.lit("?"))


def content_key(text: Column) -> Column:
    """The name-based UUID (version 5) of a text: the key of the embedding cache."""
    digest = F.sha1(F.concat(F.unhex(F.lit(KEY_NAMESPACE)), F.encode(text, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1
    variant = F.substring(F.lit("89ab"), nibble, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def natural_key(eid: Column) -> Column:
    """The numbers in an id, in turn; arrays order as the numbers do."""
    return F.transform(F.regexp_extract_all(eid, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))


def visible_refs(refs: Column) -> Column:
    return F.filter(refs, lambda r: ~F.startswith(r, F.lit(UNRESOLVED)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.array_remove(F.split(F.lower(text), TOKEN_GAP), "")


def citation(act: Column, uri: Column, kind: Column, eid: Column, number: Column) -> Column:
    head = F.concat(act, F.lit(" "), year_text(uri))
    clause = F.concat(head, F.lit(" Sch "), schedule_number(eid), F.lit(" cl "), number)
    return F.when(kind == "schedule_clause", clause).otherwise(F.concat(head, F.lit(" s "), number))


def shard_count(total: int, size: int) -> int:
    if size <= 0:
        raise ValueError("a shard holds one document at least")
    return -(-total // size)


def shard_bounds(total: int, index: int, size: int) -> tuple[int, int]:
    """The half-open range of ordinals of a shard, within the total."""
    if size <= 0:
        raise ValueError("a shard holds one document at least")
    return min(index * size, total), min((index + 1) * size, total)
