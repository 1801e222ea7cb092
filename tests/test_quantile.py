"""The exact quantile that eight-bit codes are scaled by, against sorted values and DuckDB."""

import math

import duckdb
import numpy as np
import pytest

from clauseworks.operators import dense


@pytest.mark.parametrize("few", [10_000, 3])
def test_quantile_is_that_of_duckdb(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(dense, "FEW", few)
    r = np.random.default_rng(4)
    shapes = [np.abs(r.standard_normal(997)), np.r_[np.zeros(300), 1e300, r.random(60) * 1e-9], np.full(250, 0.25), np.array([3.0]), np.r_[r.random(99), math.inf]]
    for values in shapes:
        v = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
        for q in (0.5, 0.99, 1.0):
            con = duckdb.connect()
            con.execute("create table t (x double)")
            con.executemany("insert into t values (?)", [[float(x)] for x in values])
            want = con.execute(f"select quantile_disc(x, {q}) from t").fetchone()[0]
            assert dense.exact_quantile(v, q) == want
    assert dense.exact_quantile(v.limit(0), 0.99) is None


def test_close_values_are_told_apart(spark):
    """An approximate quantile of two million values gave a neighbour's."""
    v = spark.range(2_000_003).selectExpr("1 + id * 1e-9 as x")
    assert dense.exact_quantile(v, 0.99) == 1 + (math.ceil(0.99 * 2_000_003) - 1) * 1e-9


def test_halves_go_away_from_zero_and_just_below_do_not(spark):
    x = [127.0, 0.5, -0.5, 1.5, 0.3, -127.0]
    [row] = dense.quantise(spark.createDataFrame([(x,)], "vector array<double>"), quantile=1.0).collect()
    assert row["code"] == [127, 1, -1, 2, 0, -127]
