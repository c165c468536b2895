"""Data behind plots, and profiles: by brute force, with nulls, equal values and empty tables."""

import numpy as np
import pytest

from touchline.operators import evaluation


def test_density_by_brute_force(spark):
    x = np.random.default_rng(3).normal(10, 4, 3000)
    got = evaluation.density(spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double"), "v", points=50).toPandas().sort_values("point")
    h = x.std(ddof=1) * len(x) ** -0.2
    places = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((places[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], places) and np.allclose(got["density"], want, atol=1e-4)


@pytest.mark.parametrize("values", [[], [None], [2.0, 2.0]])
def test_density_needs_two_values(spark, values):
    assert evaluation.density(spark.createDataFrame([(v,) for v in values], "v double"), "v").count() == 0


def test_pair_counts(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.9, 0.5), (2.0, -0.1), (None, 1.0), (1.0, float("inf"))], "a double, b double")
    assert {tuple(r) for r in evaluation.pair_counts(df, "a", "b", 2.0).collect()} == {(0.0, 0.0, 2), (2.0, -2.0, 1)}


def test_present_shares(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None), (4, None)], "a int, b string")
    assert {tuple(r) for r in evaluation.present_shares(df, ["a", "b"]).collect()} == {("a", 0.75), ("b", 0.25)}
    assert {r["share"] for r in evaluation.present_shares(df.limit(0), ["a", "b"]).collect()} == {None}


def test_profile_sketches_within_their_error(spark):
    rng = np.random.default_rng(8)
    x, levels = rng.exponential(5, 20000), rng.choice(list("abcdefgh"), 20000, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])
    rows = [(float(v), str(t), i) for i, (v, t) in enumerate(zip(x, levels))] + [(None, None, None), (float("nan"), "a", 1)]
    got = evaluation.profile_sketches(spark.createDataFrame(rows, "x double, t string, i long"), ["x", "t", "i"]).toPandas().set_index("column")
    assert list(got.loc["x", ["present", "missing"]]) == [20000, 2] and list(got.loc["t", ["present", "missing"]]) == [20001, 1]
    for c, different in (("x", 20000), ("t", 8), ("i", 20000)):
        assert abs(got.loc[c, "different"] - different) <= 0.03 * different
    for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        assert abs((x <= got.loc["x", name]).mean() - q) < 0.001
    top = [(m["value"], m["n"]) for m in got.loc["t", "most_frequent"]]
    assert top == sorted(((c, int((levels == c).sum()) + (c == "a")) for c in "abc"), key=lambda m: -m[1])
    empty = evaluation.profile_sketches(spark.createDataFrame([], "x double, t string"), ["x", "t"]).collect()
    assert [(r["present"], r["different"], list(r["most_frequent"] or [])) for r in empty] == [(0, 0, [])] * 2
