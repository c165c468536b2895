"""The Poisson network: gradients by finite differences, folds unseen, a curve that a regression can't follow."""

import numpy as np
import pandas as pd
import pytest

from touchline.operators import models, network


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    x, y, hidden = rng.normal(size=(30, 4)), rng.poisson(3, 30).astype(float), 3
    w = rng.normal(0, 0.5, 4 * hidden + hidden + 1)
    got = network.loss_and_gradient(w, x, y, hidden)[1]
    for i in range(len(w)):
        step = np.eye(len(w))[i] * 1e-6
        slope = (network.loss_and_gradient(w + step, x, y, hidden)[0] - network.loss_and_gradient(w - step, x, y, hidden)[0]) / 2e-6
        assert abs(slope - got[i]) < 1e-4 * max(1, abs(slope))


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(9)
    x, team = rng.uniform(-2, 2, 1500), rng.choice(["a", "b"], 1500)
    y = rng.poisson(np.exp(0.5 + 0.6 * x**2 + (team == "b") * 0.5)).astype(float)
    frame = pd.DataFrame({"game_id": np.arange(1500), "x": x, "noise": rng.normal(size=1500), "team": team, "y": y})
    return spark.createDataFrame(frame)


def test_follows_a_curve_and_chooses_by_folds(spark, counts):
    plain, curved = network.Network(hidden=1, steps=1), network.Network(hidden=6, steps=70, rate=0.1)
    found, deviances = network.search(counts, ["x", "noise"], ["team"], "y", [plain, curved], folds=2)
    assert found.network == curved and deviances[1] < 0.5 * deviances[0]
    odd = spark.createDataFrame([(1, None, 0.0, None), (2, float("nan"), None, "new"), (3, 2.0, 0.0, "b")], "game_id long, x double, noise double, team string")
    rows = {r["game_id"]: r["prediction"] for r in found.predict(odd).collect()}
    assert all(v > 0 for v in rows.values()) and rows[3] > 2 * rows[1]
    with pytest.raises(ValueError):
        network.search(counts.limit(0), ["x"], [], "y", [plain])


def test_partitions_do_not_change_the_weights(counts):
    some = network.Network(hidden=2, steps=5)
    one, many = (network.search(counts.repartition(n, "x"), ["x"], ["team"], "y", [some], folds=2)[0].weights for n in (1, 6))
    assert np.allclose(one, many, atol=1e-6)


def test_elimination_keeps_the_size_of_the_best_folds(counts):
    tried = models.eliminate_by_folds(counts.filter("x > 0"), ["x", "noise", "team"], "y", key="game_id", folds=2)
    assert [len(kept) for _, kept in tried] == [3, 2, 1]
    assert set(min(tried)[1]) >= {"x", "team"} and all(d > 0 for d, _ in tried)


def test_texts_are_coded_once_for_all_passes(spark):
    rows = [(k, float(k % 5), "abc"[k % 3] if k % 4 else None, None, float(k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, place string, none string, y double")
    table, design = network.prepare(df, ["x"], ["place", "none"], "y", "id", levels=2)
    assert dict(table.dtypes)["place"] == "int" and dict(table.dtypes)["none"] == "int"
    found = table.toPandas()
    raw = found.assign(**{c: [dict(enumerate(design.levels[c])).get(k) for k in found[c]] for c in ("place", "none")})
    assert (network._coded_matrix(design, found) == network._matrix(design, raw)).all() and set(found["place"]) == {-1, 0, 1}


def test_folds_and_all_rows_take_the_same_passes(counts, monkeypatch):
    """The chosen network took its steps anew, and passes looked at batches of a thousand rows."""
    some, passes, train = [network.Network(hidden=h, steps=4) for h in (1, 2)], [], network.train
    monkeypatch.setattr(network, "train", lambda table, design, specs: passes.append(specs) or train(table, design, specs))
    found, deviances = network.search(counts, ["x"], ["team"], "y", some, folds=2)
    assert len(passes) == 1 and [f for _, f in passes[0]] == [0, 1, 0, 1, -1, -1]
    table, design = network.prepare(counts, ["x"], ["team"], "y", "game_id", 2)
    assert np.allclose(found.weights, train(table, design, [(found.network, -1)])[0], atol=1e-9)
