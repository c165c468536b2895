"""Forests of cells against MLlib's on the rows."""

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from touchline.operators import cells
from touchline.plans import registry


def rows_of(n, seed=4):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 8, (n, 3))
    right = np.where(bins[:, 0] + bins[:, 1] > 8, 2, np.where(bins[:, 2] > 5, 1, 0))
    return bins, np.where(rng.random(n) < 0.75, right, rng.integers(0, 3, n)), rng.random(n) < 0.8


def test_cells_hold_bins_class_and_part():
    bins, label, train = rows_of(500)
    codes = cells.pack(list(bins.T), label, train)
    found = cells.unpack(codes, 3)
    assert (found[0] == bins.T).all() and (found[1] == label).all() and (found[2] == train).all()


def test_a_forest_of_cells_agrees_as_one_of_rows(spark):
    bins, label, train = rows_of(6000)
    codes, n = np.unique(cells.pack(list(bins.T), label, train), return_counts=True)
    got = [cells.kappa(codes, n, 3, 20, seed) for seed in range(3)]
    frame = pd.DataFrame(bins.astype(float), columns=list("abc")).assign(label=label.astype(float), train=train)
    made = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(frame))
    want = []
    for seed in range(3):
        out = RandomForestClassifier(numTrees=20, seed=seed).fit(made.filter("train")).transform(made.filter("not train")).select("label", "prediction").toPandas()
        agreed, of = (out["label"] == out["prediction"]).mean(), lambda v: (out["label"] == v).mean() * (out["prediction"] == v).mean()  # noqa: B023, E731
        chance = sum(map(of, range(3)))
        want.append((agreed - chance) / (1 - chance))
    assert abs(np.mean(got) - np.mean(want)) < 0.05 and np.mean(got) > 0.5
    assert cells.kappa(codes[::-1].copy(), n[::-1].copy(), 3, 20, 1) == got[1]
    assert cells.kappa(codes[:0], n[:0], 3, 5, 1) == 0.0


def test_a_forest_for_each_k_takes_few_jobs(spark):
    """Each of the fifty forests was a fit of its own over all rows, of eight jobs or more."""
    spark.sparkContext.setJobGroup("forests", "")
    assert registry.QUERIES["elo_forest_kappa"](spark, "/root/testdata/sf0.001").count() == 50
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forests"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 100
