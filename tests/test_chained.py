"""Chained equations: what is known stays, donors are the nearest of all, masked values come back."""

import numpy as np
import pandas as pd
import pytest

from touchline.operators import chained


@pytest.fixture(scope="module")
def masked(spark):
    rng = np.random.default_rng(5)
    n = 600
    place = rng.choice(list("abcd"), n)
    x = rng.normal(0, 1, n)
    y = 3 * x + np.select([place == c for c in "abcd"], [0, 4, 8, 12]) + rng.normal(0, 0.3, n)
    z = y - x + rng.normal(0, 0.3, n)
    whole = pd.DataFrame({"id": np.arange(n), "place": place, "x": x, "y": y, "z": z})
    gaps = whole.copy()
    gaps.loc[rng.random(n) < 0.2, "y"] = np.nan
    gaps.loc[rng.random(n) < 0.3, "z"] = np.nan
    return whole, gaps, spark.createDataFrame(gaps)


def filled(df, **more):
    out = chained.complete(df, "id", ["x", "y", "z"], ["place"], **{"tables": 2, "sweeps": 2} | more).toPandas()
    return out.sort_values(["table", "id"]).reset_index(drop=True)


def test_nearest_donors_by_brute_force():
    rng = np.random.default_rng(1)
    for donors in (1, 3, 40):
        at, pool = rng.normal(size=50), np.sort(rng.normal(size=donors))
        got = chained.nearest_donors(at, pool, 5)
        for place, found in zip(at, got):
            want = np.argsort(np.abs(pool - place), kind="stable")[:5]
            assert list(found[found >= 0]) == list(want)


def test_known_values_stay_and_masked_ones_come_back(masked):
    whole, gaps, df = masked
    out = filled(df)
    for t in (0, 1):
        own = out[out["table"] == t].reset_index(drop=True)
        assert list(own["id"]) == list(whole["id"])
        for c in ("y", "z"):
            known, hidden = gaps[c].notna(), gaps[c].isna()
            assert (own.loc[known, c] == gaps.loc[known, c]).all()
            assert set(own.loc[hidden, c]) <= set(gaps.loc[known, c])
            error = lambda guess: np.sqrt(((guess - whole.loc[hidden, c]) ** 2).mean())
            assert error(own.loc[hidden, c]) < 0.25 * error(gaps[c].mean())
    assert not out[out["table"] == 0].reset_index(drop=True)["y"].equals(out[out["table"] == 1].reset_index(drop=True)["y"])


def test_ranges_do_not_change_the_result(masked):
    df = masked[2]
    assert filled(df, partitions=1).equals(filled(df.repartition(5), partitions=7))
    assert not filled(df, partitions=3).equals(filled(df, partitions=3, seed=70))


def test_pooled_means(masked, spark):
    out = filled(masked[2])
    got = chained.pooled_means(spark.createDataFrame(out), ["y", "z"]).toPandas().set_index("column")
    for c in ("y", "z"):
        q = out.groupby("table")[c].mean()
        u = out.groupby("table")[c].agg(lambda v: v.var() / len(v)).mean()
        assert np.allclose(got.loc[c, ["estimate", "within", "between", "total"]].astype(float), [q.mean(), u, q.var(), u + 1.5 * q.var()])


def test_odd_tables(spark):
    schema = "id long, x double, y double, place string"
    empty = chained.complete(spark.createDataFrame([], schema), "id", ["x", "y"], ["place"], tables=2, sweeps=1)
    assert empty.columns == ["id", "table", "x", "y"] and not empty.count()
    rows = [(1, 1.0, None, None), (1, None, None, "a"), (2, float("nan"), None, "a"), (3, 5.0, None, None)]
    out = chained.complete(spark.createDataFrame(rows, schema), "id", ["x", "y"], ["place"], tables=2, sweeps=1).toPandas()
    assert len(out) == 8 and set(out["x"]) == {1.0, 5.0} and out["y"].isna().all()


def test_ranges_of_several_batches_give_the_same_table(spark, masked):
    whole, gaps, df = masked
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, want = spark.conf.get(name), filled(df, partitions=1)
    spark.conf.set(name, "70")
    try:
        pd.testing.assert_frame_equal(filled(df, partitions=1), want, check_exact=True)
    finally:
        spark.conf.set(name, before)
