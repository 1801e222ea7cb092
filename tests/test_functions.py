"""Scalar functions against plain statements of what they do."""

import re
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseworks.functions import refs as R
from clauseworks.functions import text as X

NS = uuid.UUID(X.KEY_NAMESPACE)


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab \t\n\x1c\x1f\xa0 　é"), max_size=12), min_size=1, max_size=40))
def test_squeeze_is_split_and_join(spark, values):
    assert column(spark, values, X.squeeze) == [" ".join(v.split()) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), min_size=1, max_size=40))
def test_content_key_is_a_named_uuid(spark, values):
    assert column(spark, values, X.content_key) == [str(uuid.uuid5(NS, v)) for v in values]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"(sec|sch)-[0-9]{1,3}[A-Z]?(__x-[0-9]{1,2})?", fullmatch=True), min_size=1, max_size=40))
def test_natural_key_orders_as_tuples(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["v"] for r in rows.orderBy(X.natural_key(F.col("v")), "v").collect()]
    assert got == sorted(values, key=lambda v: (tuple(map(int, re.findall(r"\d+", v))), v))


URIS = ["/akn/au/act/1988/119/eng@2026-01-01", "/akn/au/act/x/119", "", "short", "/a@b@2020-01-01/rest"]


def test_uri_parts(spark):
    assert column(spark, URIS, X.year_text) == ["1988", "x", "", "", ""]
    assert column(spark, URIS, X.year_int) == [1988, 0, 0, 0, 0]
    assert column(spark, URIS, X.as_at) == ["2026-01-01", "", "", "", "2020-01-01"]


def test_schedule_number(spark):
    assert column(spark, ["schedule-1__clause-6", "sec-1", "a__schedule-2A", ""], X.schedule_number) == ["1", "?", "2A", "?"]


def test_visible_refs(spark):
    assert column(spark, [["#sec-1", "unresolved:X", "/akn"], []], X.visible_refs, "array<string>") == [["#sec-1", "/akn"], []]


def test_shards():
    assert X.shard_count(10, 3) == 4 and X.shard_count(0, 3) == 0
    assert [X.shard_bounds(10, i, 3) for i in range(5)] == [(0, 3), (3, 6), (6, 9), (9, 10), (10, 10)]
    with pytest.raises(ValueError):
        X.shard_count(10, 0)


CITED = [
    ("under s 6(1)(a) of this Act", ["#sec-6__subsec-1__para-a", "#sec-6__subsec-1", "#sec-6"]),
    ("see section 13G and section 13G", ["#sec-13G"]),
    ("it's 6 o'clock", ["#sec-6"]),
    ("Part IIIA and Division 2", ["#part-IIIA", "#dvs-2"]),
    ("Part III of the Code", ["#part-II"]),
    ("Part 10 of the Code", ["#part-1"]),
    ("schedule 1, CLAUSE 6A", ["#schedule-1__clause-6A"]),
    ("paragraph (c)", ["#para-c"]),
    ("the Privacy Act 1988 applies", ["/akn/privacy"]),
    ("the Empty Act 1999 applies", [""]),
    ("the Unknown Act 1999 applies", ["unresolved:Unknown Act 1999"]),
    ("the Minister and the Privacy Act 1988", ["unresolved:Minister and the Privacy Act 1988"]),
    ("under the Export Control Rules 2021", ["unresolved:Export Control Rules 2021"]),
    ("nothing here", []),
    ("section 7", ["#sec-7"]),
]


@pytest.mark.parametrize("i", range(len(CITED)))
def test_refs(spark, i):
    got = _cited(spark)
    assert got[i] == CITED[i][1], CITED[i][0]


_found: list = []


def _cited(spark):
    if not _found:
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CITED)], "i long, text string")
        index = spark.createDataFrame([("Privacy Act 1988", "/akn/privacy"), ("Empty Act 1999", "")], "name string, uri string")
        _found.extend(r["refs"] for r in R.with_refs(rows, index, ["i"]).orderBy("i").collect())
    return _found
