"""The jobs end to end, exact probabilities for any mean, the store, and the search."""

import math

import pytest
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from touchline import jobs
from touchline.functions.columns import outcome_probabilities, poisson_terms
from touchline.operators import evaluation
from touchline.operators import cleaning, models, standings
from touchline.plans.fixtures import games
from touchline.session import settle
from touchline.sources import store

SF = "/root/testdata/sf0.001"
PREDICTION = "game_id long, home_team_result string, home_team_win_prob double, home_team_lose_prob double"


def by_hand(h, a):
    """Probabilities of home, away and draw by plain sums."""
    n = int(max(h, a) + 15 * math.sqrt(max(h, a)) + 60)
    pmf = lambda m: [math.exp(k * math.log(m) - m - math.lgamma(k + 1)) if m else float(k == 0) for k in range(n)]
    ph, pa = pmf(h), pmf(a)
    below, home, draw = 0.0, 0.0, 0.0
    for x, y in zip(ph, pa):
        home, draw, below = home + x * below, draw + x * y, below + y
    return home, 1 - home - draw, draw


def test_outcomes_of_any_mean(spark):
    means = [(0.0, 0.0), (0.0, 3.0), (24.5, 18.25), (90.0, 85.0), (150.0, 140.0), (200.0, 190.0), (900.0, 880.0), (1.0, 800.0)]
    rows = spark.createDataFrame([*means, (None, 3.0)], "h double, a double").withColumn("p", outcome_probabilities(F.col("h"), F.col("a"))).collect()
    for r in rows[:-1]:
        assert all(abs(x - y) < 1e-9 for x, y in zip((r["p"]["home"], r["p"]["away"], r["p"]["draw"]), by_hand(r["h"], r["a"]))), r
    assert rows[-1]["p"] is None
    terms = spark.createDataFrame([(0.0,), (3.0,), (700.0,), (900.0,)], "m double").select("m", poisson_terms(F.col("m")).alias("t")).collect()
    for r in terms:
        assert abs(sum(r["t"]) - 1) < 1e-9 and abs(sum(k * x for k, x in enumerate(r["t"])) - r["m"]) < 1e-6


def test_the_last_row_of_a_key_wins(spark):
    old = spark.createDataFrame([(1, "Win", 0.6, 0.3), (2, "Win", 0.5, 0.4)], PREDICTION)
    new = spark.createDataFrame([(2, "Loss", 0.1, 0.8, 1), (2, "Win", 0.9, 0.1, 3), (2, "Loss", 0.2, 0.7, 2), (3, "Win", 0.7, 0.2, 1)], PREDICTION + ", revision int")
    got = store.upsert(old, new, order="revision").collect()
    assert sorted((r["game_id"], r["home_team_win_prob"]) for r in got) == [(1, 0.6), (2, 0.9), (3, 0.7)]
    without = store.upsert(old, new.drop("revision")).collect()
    assert len(without) == 3


def test_a_broken_swap_is_mended(spark):
    for name in ("swapped", "swapped_before"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    store.save_predictions(spark, "swapped", spark.createDataFrame([(1, "Win", 0.6, 0.3)], PREDICTION))
    spark.sql("ALTER TABLE swapped RENAME TO swapped_before")  # a run that ended in between
    store.save_predictions(spark, "swapped", spark.createDataFrame([(2, "Win", 0.6, 0.3)], PREDICTION))
    assert {r["game_id"] for r in spark.table("swapped").collect()} == {1, 2} and not spark.catalog.tableExists("swapped_before")
    spark.sql("DROP TABLE swapped")


def test_sql_files(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT game_id, home_team_result\nFROM stored WHERE home_team_win_prob > 0.5;\n")
    rows = spark.createDataFrame([(1, "Win", 0.6, 0.3), (2, "Loss", 0.2, 0.7)], PREDICTION)
    assert [r["game_id"] for r in store.read_sql(spark, str(tmp_path / "q.sql"), {"stored": rows}).collect()] == [1]


def test_train_predict_store_and_report(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS job_predictions")
    all_games = games(spark, SF)
    found, predictors = jobs.prepare(all_games, standings.ladder(all_games))
    found, predictors = settle(found), [p for p in models.filter_predictors(predictors) if not p.startswith(("draw", "loss", "avg"))]
    deviances = jobs.train(found, predictors, str(tmp_path), draws=1, folds=2)
    assert set(deviances) == {"home", "away"} and all(0 < d < 50 for d in deviances.values())
    jobs.predict_and_store(spark, found, predictors, str(tmp_path), "job_predictions")
    stored = spark.table("job_predictions").collect()
    ahead = {r["game_id"] for r in found.filter("game_state_name = 'Pre Game'").select("game_id").collect()}
    assert {r["game_id"] for r in stored} == ahead and all(0 <= r["home_team_win_prob"] <= 1 for r in stored)
    shown = found.withColumns({"position_home": F.lit(1), "position_away": F.lit(2), "home_team_result": F.lit("x")})
    texts = jobs.report(spark, shown, "job_predictions").collect()
    assert texts and sum(r["report"].count("Home Team Result: ") for r in texts) == len(ahead)
    spark.sql("DROP TABLE job_predictions")


def test_random_draws_repeat_and_stay_in_range():
    glm = GeneralizedLinearRegression()
    one, other = (models.random_grid(glm, models.GLM_SPACE, 20, seed=s) for s in (1, 1))
    assert one == other and len({tuple(d.values()) for d in one}) == 20
    assert all(1e-4 <= v <= 1.0 for d in one for v in d.values()) and one != models.random_grid(glm, models.GLM_SPACE, 20, seed=2)


def test_predictors_and_levels(spark):
    assert models.filter_predictors(["a", "b_performance", "c"]) == ["a", "c"]
    assert models.filter_predictors(["a", "b_performance"], include=True) == ["a", "b_performance"]
    df = spark.createDataFrame([("x",), ("x",), (None,)], "team string")
    assert {(r["team"], r["rows"]) for r in cleaning.known_levels(df, "team", ("y", "x")).collect()} == {("x", 2), ("y", 0)}


def test_arrow_batches_that_the_user_chose_stay(spark):
    from touchline.session import BATCH_ROWS, ship_package

    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert spark.conf.get(key) == BATCH_ROWS
    spark.conf.set(key, "10000")
    ship_package(spark)
    assert spark.conf.get(key) == "10000"
    spark.conf.set(key, BATCH_ROWS)


@pytest.mark.parametrize("side", ["home", "away"])
def test_home_ground_estimates_are_given_to_every_game(spark, side):
    rows = games(spark, SF).limit(400)
    out = models.home_ground_estimates(rows, [f"team_{side}", "round_id"], trees=3)
    assert out.count() == 400 and out.filter("home_ground_advantage is null").count() == 0


def test_probabilities_are_summed_for_a_batch_of_rows(spark):
    """As an expression of a row they took half a millisecond, and totals by subqueries made them anew."""
    rows = spark.range(1000).select((F.col("id") % 3 == 0).alias("y"), (F.col("id") % 61).cast("double").alias("h"), (F.col("id") % 53).cast("double").alias("a"))
    judged = rows.select("y", outcome_probabilities(F.col("h"), F.col("a"))["home"].alias("ph"))
    found = evaluation.kappa_by_cutoff(judged, F.col("y"), F.col("ph"), 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "ArrowEvalPython" in plan and "Subquery" not in plan
    assert found.count() == 19
