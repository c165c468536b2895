"""Curves against DuckDB, forests against a refit and a plain tree."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import forest, ranks
from touchline.operators.boosting import binned
from touchline.operators.forest import Forest, Growing, fold_of, grow, in_bag, repeated_cv


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_curves_with_ties_against_all_pairs(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.randrange(2), round(rng.random(), 1), i) for i in range(200)] + [(None, 0.4, 0), (1, None, 0), (1, float("nan"), 0), (0, -0.0, 0), (1, 0.0, 0)]
    curve = ranks.roc_curve(spark.createDataFrame(rows, "y int, s double, i int"), F.col("y") == 1, F.col("s"), partitions)
    known = [(y, s) for y, s, _ in rows if y is not None and s is not None and s == s]
    got = {r["cutoff"]: (r["tp"], r["fp"]) for r in curve.collect()}
    assert got == {c: (sum(y and s >= c for y, s in known), sum((not y) and s >= c for y, s in known)) for c in {s for _, s in known}}
    pairs = [(a > b) + (a == b) / 2 for y, a in known if y for z, b in known if not z]
    assert ranks.area(curve).first()["auc"] == pytest.approx(sum(pairs) / len(pairs))

    def kappa(c):
        table = np.array([[sum(bool(y) == a and (s >= c) == b for y, s in known) for b in (True, False)] for a in (True, False)], float) / len(known)
        chance = (table.sum(0) * table.sum(1)).sum()
        return (np.trace(table) - chance) / (1 - chance)

    best = ranks.largest_kappa(curve).first()
    assert best["kappa"] == pytest.approx(max(kappa(c) for c in got)) and kappa(best["cutoff"]) == pytest.approx(best["kappa"])


def test_curves_without_cases(spark):
    none = spark.createDataFrame([], "y int, s double")
    assert ranks.roc_curve(none, F.col("y") == 1, F.col("s")).count() == 0
    assert tuple(ranks.area(ranks.roc_curve(none, F.col("y") == 1, F.col("s"))).first()) == (None, 0, 0)
    ones = ranks.roc_curve(spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double"), F.col("y") == 1, F.col("s"))
    assert ranks.area(ones).first()["auc"] is None and {r["fpr"] for r in ones.collect()} == {None}


def test_running_totals_in_many_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("n"))
    got = {r["k"]: r["t"] for r in ranks.running_totals(rows, "k", {"t": "n"}, partitions=13).collect()}
    total, by_key = 0, dict((r["k"], r["n"]) for r in rows.collect())
    for k in sorted(by_key):
        total += by_key[k]
        assert got[k] == total


def rows_of(spark, n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        a, b, t = rng.random(), rng.choice([None, 1.0, 2.0]), rng.choice(["x", "y", None])
        rows.append((i, a, b, t, int(rng.random() < (0.9 if (a > 0.5) ^ (t == "y") else 0.15)) if i % 50 else None))
    return spark.createDataFrame(rows, "id long, a double, b double, t string, y int")


PREDICTORS = ["a", "b", "t"]


def plain_tree(rows, texts, f, number):
    """Leaves of one tree by path, from single rows."""
    weight = in_bag(np.array([k for k, _, _ in rows]), f, number)
    bag = [r for r, w in zip(rows, weight) for _ in range(w)]
    gini = lambda rs: 2 * (k := sum(y for _, _, y in rs)) * (len(rs) - k) / max(len(rs), 1)
    share = lambda rs: sum(y for _, _, y in rs) / len(rs)
    out, level, node_numbers, following = {"": share(bag)}, {"": bag}, {"": 0}, 1
    for _ in range(f.max_depth):
        deeper = {}
        for path, rs in level.items():
            growing = Growing(f, number, level=[node_numbers[path]])
            best = None
            for p in sorted(growing.tried(len(texts))[0]):
                for b in range(66):
                    left = [r for r in rs if (r[1][p] == b if texts[p] else r[1][p] <= b)]
                    right = [r for r in rs if not (r[1][p] == b if texts[p] else r[1][p] <= b)]
                    if min(len(left), len(right)) >= f.min_rows:
                        gain = round(gini(rs) - gini(left) - gini(right), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, int(p), b, left, right)
            if best:
                out[path] = best[1:3]
                for side, part in (("l", best[3]), ("r", best[4])):
                    node_numbers[path + side], following = following, following + 1
                    out[path + side] = share(part)
                    if 0 < share(part) < 1:
                        deeper[path + side] = part
        level = deeper
    return out


def by_path(tree, node=0, path=""):
    if tree.predictor[node] < 0:
        return {path: round(tree.value[node], 9)}
    return {path: (tree.predictor[node], tree.bin[node])} | by_path(tree, tree.left[node], path + "l") | by_path(tree, tree.right[node], path + "r")


def test_trees_equal_plain_ones(spark):
    table, binning = binned(rows_of(spark), PREDICTORS, "y", "id")
    rows = [(r["key"], list(r["bins"]), int(r["y"])) for r in table.collect()]
    f = Forest(trees=3, tried=2, max_depth=4, min_rows=3)
    for number, tree in enumerate(grow(table.repartition(3), binning, [f])[0]):
        assert by_path(tree) == {p: x if isinstance(x, tuple) else round(x, 9) for p, x in plain_tree(rows, binning.texts, f, number).items()}


def test_out_of_bag_votes_and_cutoff(spark, monkeypatch):
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 7)
    rows = rows_of(spark)
    f = Forest(trees=30, tried=2, max_depth=5)
    fitted = forest.fit(rows, PREDICTORS, "y", "id", f)
    voted = {r["id"]: r for r in fitted.votes(rows, out_of_bag=True).collect()}
    keys = {r["id"]: r["k"] for r in rows.select("id", F.xxhash64("id").alias("k")).collect()}
    bags = np.stack([in_bag(np.array([keys[i] for i in sorted(keys)]), f, t) for t in range(30)])
    assert 0.3 < (bags == 0).mean() < 0.44 and abs(bags.mean() - 1) < 0.05
    assert all(voted[i]["trees"] == (bags[:, n] == 0).sum() for n, i in enumerate(sorted(keys)))
    # a tree whose bag doesn't hold a row is the same without the row
    left_out = 7
    table, binning = binned(rows, PREDICTORS, "y", "id")
    refit = grow(table.filter(F.col("key") != keys[left_out]), binning, [f])[0]
    unseen = [t for t in range(30) if not bags[t, left_out]]
    assert [by_path(refit[t]) for t in unseen] == [by_path(fitted.trees[t]) for t in unseen]
    assert len(unseen) == voted[left_out]["trees"] and [by_path(t) for t in refit] != [by_path(t) for t in fitted.trees]
    curve = ranks.roc_curve(spark.createDataFrame([(r["y"], r["votes"]) for r in voted.values()], "y int, votes double"), F.col("y") == 1, F.col("votes"))
    assert 0.75 < ranks.area(curve).first()["auc"] < 1
    seen = ranks.roc_curve(fitted.votes(rows), F.col("y") == 1, F.col("votes"))
    assert ranks.area(seen).first()["auc"] > ranks.area(curve).first()["auc"]
    con = duckdb.connect()
    con.register("v", rows.toPandas()[["id"]].assign(y=[voted[i]["y"] for i in sorted(voted)], votes=[voted[i]["votes"] for i in sorted(voted)]))
    kappas = con.sql("""WITH c AS (SELECT DISTINCT votes AS cut FROM v WHERE y IS NOT NULL AND votes IS NOT NULL), m AS (
        SELECT cut, avg(CAST((votes >= cut) = (y = 1) AS DOUBLE)) AS agreed, avg(CAST(votes >= cut AS DOUBLE)) AS c, avg(CAST(y AS DOUBLE)) AS p FROM v, c WHERE y IS NOT NULL AND votes IS NOT NULL GROUP BY cut)
        SELECT max((agreed - (c * p + (1 - c) * (1 - p))) / (1 - (c * p + (1 - c) * (1 - p)))) FROM m WHERE c < 1""").fetchall()[0][0]
    assert ranks.largest_kappa(curve).first()["kappa"] == pytest.approx(kappas)


def test_repeated_cv(spark):
    rows = rows_of(spark)
    table = repeated_cv(rows, PREDICTORS, "y", "id", tried=[1, 2], folds=3, repeats=2, forest=Forest(trees=15, max_depth=4))
    got = table.collect()
    assert {(r["tried"], r["repeat"], r["fold"]) for r in got} == {(k, r, f) for k in (1, 2) for r in range(2) for f in range(3)}
    labelled = rows.filter("y is not null").count()
    for k in (1, 2):
        for repeat in range(2):
            assert sum(r["rows"] for r in got if (r["tried"], r["repeat"]) == (k, repeat)) == labelled  # each row in one fold
    assert np.mean([r["auc"] for r in got]) > 0.75 and all(0 <= r["sensitivity"] <= 1 and 0 <= r["specificity"] <= 1 for r in got)
    keys = np.arange(3000, dtype=np.int64)
    a, b = (fold_of(keys, Forest(folds=5, repeat=r)) for r in range(2))
    assert set(a) == set(range(5)) and min(np.bincount(a)) > 500 and 0.1 < (a == b).mean() < 0.3
