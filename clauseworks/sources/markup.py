"""Akoma Ntoso documents to provision rows: a tree walk in Python workers, one file at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from clauseworks.operators.batches import small_batches
from clauseworks.schemas import PARSED

# The namespace of version 3.0, the kinds of provision in order, and the shortest subsection.
NAMESPACE = "{http://docs.oasis-open.org/legaldocml/ns/akn/3.0}"
KINDS = ("section", "subsection", "schedule_clause")
SHORTEST_SUBSECTION = 20
#: Bytes of documents whose rows go on as one batch, and the kind of such a batch.
OUT_BYTES = 4_000_000
OUT = to_arrow_schema(PARSED)


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _table(table: ElementTree.Element) -> str:
    """Rows that stand directly in the table: cells that have text, with bars between."""
    rows = []
    for row in table:
        if _local(row.tag) == "tr":
            cells = (" ".join(cell.itertext()).strip() for cell in row)
            rows.append(" | ".join(c for c in cells if c))
    return " ".join(r for r in rows if r)


def _pieces(top: ElementTree.Element) -> Iterator[str]:
    """Text in document order; a table is one piece."""
    if _local(top.tag) == "table":
        yield _table(top)
        return
    yield top.text or ""
    for child in top:
        if isinstance(child.tag, str):
            yield from _pieces(child)
        yield child.tail or ""


def plain_text(top: ElementTree.Element) -> str:
    return " ".join(" ".join(_pieces(top)).split())


def _own(el: ElementTree.Element, name: str) -> str | None:
    child = el.find(NAMESPACE + name)
    return child.text.strip() if child is not None and child.text else None


def subsection_suffix(eid: str) -> str:
    """Of the last ``subsec-`` part, in an opening bracket; the closing one is left out, as it is in the index."""
    found = [p for p in eid.split("__") if p.startswith("subsec-")]
    return "(" + found[-1].removeprefix("subsec-") if found else ""


@dataclass(frozen=True)
class _Place:
    """Where the walk is: the number of the nearest section, and how far down the way to a schedule's clause."""

    section: str = ""
    depth: int = 0

    def below(self, el: ElementTree.Element) -> _Place:
        name, kind = _local(el.tag), el.get("name")
        section = (_own(el, "num") or "") if name == "section" else self.section
        named = el.tag.startswith(NAMESPACE)
        depth = 0
        if named and name == "attachments":
            depth = 1
        elif named and (self.depth, name) == (1, "attachment"):
            depth = 2
        elif named and (self.depth, name, kind) == (2, "hcontainer", "schedule"):
            depth = 3
        return _Place(section, depth)


def _walk(el: ElementTree.Element, place: _Place) -> Iterator[tuple[int, str, str, str | None, str]]:
    """(kind, eid, number, heading, text) of each provision, in document order."""
    eid = el.get("eId", "")
    if el.tag == NAMESPACE + "section":
        yield 0, eid, _own(el, "num") or "", _own(el, "heading"), plain_text(el)
    elif el.tag == NAMESPACE + "subsection":
        text = plain_text(el)
        if len(text) >= SHORTEST_SUBSECTION:
            yield 1, eid, place.section + subsection_suffix(eid), _own(el, "heading"), text
    elif el.tag == NAMESPACE + "hcontainer" and el.get("name") == "clause" and place.depth == 3:
        yield 2, eid, _own(el, "num") or "", _own(el, "heading"), plain_text(el)
    below = place.below(el)
    for child in el:
        if isinstance(child.tag, str):
            yield from _walk(child, below)


def provisions(content: bytes) -> list[tuple[str | None, int, int, str, str, str, str | None, str]]:
    """(frbr_uri, kind_ord, prov_ord, eid, number, type, heading, text) of one document."""
    root = ElementTree.fromstring(content)
    uri_el = root.find(f".//{NAMESPACE}FRBRExpression/{NAMESPACE}FRBRuri")
    uri = "" if uri_el is None else uri_el.get("value")
    found = list(_walk(root, _Place()))
    out = []
    for kind, name in enumerate(KINDS):
        rows = [f for f in found if f[0] == kind]
        out += [(uri, kind, i, eid, number, name, heading, text) for i, (_, eid, number, heading, text) in enumerate(rows)]
    return out


class Provisions:
    """The parser as a table function: ``register(spark)``, then ``SELECT … FROM files, LATERAL akn_provisions(content)``.

    A content that is null gives no row.
    """

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            yield from provisions(bytes(content))


#: What the table function returns, for each provision of a document.
FUNCTION = "frbr_uri string, kind_ord int, prov_ord int, eid string, provision_num string, provision_type string, heading string, text string"


def register(spark: SparkSession, name: str = "akn_provisions") -> None:
    spark.udtf.register(name, udtf(Provisions, returnType=FUNCTION))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Provision rows of batches of (act_ord, act_name, content), those of many documents in one batch."""
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for act_ord, act_name, content in zip(batch["act_ord"].to_pylist(), batch["act_name"].to_pylist(), batch["content"], strict=True):
            content = content.as_py()
            rows += [(act_ord, act_name, *p) for p in provisions(content)]
            size += len(content)
            if rows and size >= OUT_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def parse(files: DataFrame) -> DataFrame:
    """Provision rows of ``files`` (act_ord, act_name, content). Filter files before, not after."""
    small_batches(files.sparkSession)
    return files.select("act_ord", "act_name", "content").mapInArrow(parsed, PARSED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of many documents as one batch: a batch of its own for every document costs more than to parse it."""
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, OUT.field(i).type) for i, c in enumerate(columns)], schema=OUT)
