"""Small hand-made panels with known answers."""

import math
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from touchline import session
from touchline.operators import features, ratings, standings
from touchline.operators.cleaning import drop_first_season, fill_nulls, inference_games, lump_levels, training_games
from touchline.functions.columns import evidence_strength
from touchline.operators.evaluation import best_cutoff, kappa_by_cutoff
from touchline.operators.models import eliminate_predictors
from touchline.operators.prediction import PICK_LINES, prediction_records, report_texts, simulate, value_picks
from touchline.plans.fixtures import games as fixture_games

SCHEMA = "game_id long, competition_id string, competition_year long, round_id long, round_name string, start_time timestamp_ntz, team_home string, team_away string, game_state_name string, score_home double, score_away double, odds_home double, odds_away double"


def panel(spark, rows):
    """rows: (year, round, home, away, score home, score away)"""
    start = datetime(2020, 1, 1)
    made = []
    for i, (year, rnd, home, away, a, b) in enumerate(rows, 1):
        made.append((i, "c", year, rnd, f"Round {rnd}", start + timedelta(days=7 * i), home, away, "Final" if a is not None else "Pre Game", a, b, 2.0, 1.5))
    return spark.createDataFrame(made, SCHEMA)


def by_game(df):
    return {r["game_id"]: r for r in df.collect()}


def test_matchup_form_needs_games_and_forgets(spark):
    games = panel(spark, [(2020 + i // 4, i, "a", "b", 10.0, 9.0 if i != 3 else 10.0) for i in range(8)])
    form = by_game(features.matchup_form(games))
    assert [form[i]["matchup_form"] for i in range(1, 9)] == [0, 1, 2, 3, 3, 4, 4, 4]
    assert by_game(features.matchup_form(games, 2))[8]["matchup_form"] == 2


def test_previous_results_keep_their_side(spark):
    games = panel(spark, [(2020, 1, "a", "b", 20.0, 10.0), (2020, 2, "b", "a", 5.0, 9.0), (2020, 3, "a", "b", 1.0, 1.0), (2021, 1, "a", "b", 3.0, 2.0)])
    found = by_game(features.previous_results(games))
    assert (found[3]["prev_result_home"], found[3]["prev_result_away"], found[3]["prev_result_diff"]) == (10.0, 10.0, 0.0)
    assert found[2]["prev_result_home"] == found[2]["prev_result_diff"] == 0.0 and found[4]["prev_result_home"] == 0.0


def test_one_missing_side_makes_the_difference_zero(spark):
    games = panel(spark, [(2020, 1, "a", "x", 20.0, 10.0), (2020, 2, "a", "b", 5.0, 9.0)])
    found = by_game(features.previous_results(games))[2]
    assert (found["prev_result_home"], found["prev_result_away"], found["prev_result_diff"]) == (10.0, 0.0, 0.0)


def test_turn_around_uses_the_mean_for_first_games(spark):
    games = panel(spark, [(2020, 1, "a", "b", 1.0, 2.0), (2020, 2, "a", "b", 1.0, 2.0), (2021, 1, "b", "c", 1.0, 2.0)])
    found = by_game(features.turn_around(games))
    assert found[2]["turn_around_home"] == 7 and found[3]["turn_around_home"] == 7 and found[1]["turn_around_home"] == 7


def test_nulls_stop_running_totals(spark):
    games = panel(spark, [(2020, 1, "a", "b", 10.0, 2.0), (2020, 2, "a", "b", None, None), (2020, 3, "a", "b", 4.0, 2.0)])
    found = by_game(features.season_stats(games))
    assert found[2]["season_points_for_home"] == 10 and found[3]["season_points_for_home"] == 0 and found[3]["season_record_home"] == 1


def test_points_are_summed_then_averaged(spark):
    games = panel(spark, [(2020, i, "a", "b", 10.0, 2.0) for i in range(1, 9)])
    found = by_game(features.form_stats(games))
    assert [found[i]["form_points_for_home"] for i in range(1, 9)] == [0, 10, 20, 30, 40, 10, 10, 10]


def test_small_rounds_and_the_next(spark):
    games = panel(spark, [(2020, 1, f"a{i}", f"b{i}", 1.0, 0.0) for i in range(5)] + [(2020, 2, f"a{i}", f"b{i}", 1.0, 0.0) for i in range(6)])
    flags = {r["round_id"]: (r["small_round"], r["after_small_round"]) for r in features.small_rounds(games).collect()}
    assert flags == {1: (1, 0), 2: (0, 1)}


def test_features_do_not_see_later_games(spark):
    rows = [(2020 + i // 6, i % 6, "abc"[i % 3], "abc"[(i + 1) % 3], float(i % 7), float(i % 5)) for i in range(18)]
    whole, cut = panel(spark, rows), panel(spark, rows[:12])
    for make in (features.previous_results, features.matchup_form, features.season_stats, features.form_stats, features.bye_flags):
        early = by_game(make(cut))
        assert {k: v for k, v in by_game(make(whole)).items() if k in early} == early


def test_ratings_conserve_and_regress(spark):
    games = panel(spark, [(2020, 1, "a", "b", 100.0, 0.0), (2020, 2, "a", "b", None, None), (2021, 1, "b", "a", 3.0, 3.0)])
    rated = by_game(ratings.rate_games(games))
    assert rated[1]["elo_home"] == rated[1]["elo_away"] == 1500 and rated[1]["w"] == 1.0 and rated[2]["w"] is None
    assert rated[2]["elo_home"] + rated[2]["elo_away"] == pytest.approx(3000)
    assert rated[3]["elo_away"] - 1500 == pytest.approx((rated[2]["elo_home"] - 1500) / 2) and rated[3]["w"] == 0.5


def test_ladder_counts_what_came_before(spark):
    games = panel(spark, [(2020, 1, "a", "b", 2.0, 1.0), (2020, 2, "b", "a", 1.0, 1.0), (2020, 3, "a", "b", 0.0, 1.0)])
    before = {(r["round_id"], r["team"]): r for r in standings.entering_round(standings.ladder(games)).collect()}
    assert before[1, "a"]["wins"] == 0 and before[3, "a"]["wins"] == 1 and before[3, "a"]["draws"] == 1 and before[3, "a"]["recent_form"] == "WD"


def test_lump_ties(spark):
    rows = [(v,) for v, n in (("a", 5), ("b", 3), ("c", 2), ("d", 2), ("e", 1)) for _ in range(n)] + [(None,)]
    df = spark.createDataFrame(rows, "v string")
    kept = lambda n, ties: {r["v"] for r in lump_levels(df, "v", n, ties).collect()}
    assert kept(3, "max") == {"a", "b", "Other", None} and kept(3, "min") == {"a", "b", "c", "d", "Other", None}
    assert lump_levels(df, "v", 3).count() == len(rows)


def test_splits(spark):
    games = panel(spark, [(2020, 1, "a", "b", 1.0, 0.0), (2021, 2, "a", "b", None, None), (2021, 3, "a", "b", None, None), (2021, 1, "a", "b", 1.0, 0.0)])
    games = games.withColumn("game_state_name", F.when(F.col("game_id") == 3, "Live").otherwise(F.col("game_state_name")))
    assert {r["game_id"] for r in training_games(games).collect()} == {1, 4}
    assert {r["game_id"] for r in inference_games(games).collect()} == {2}
    assert {r["game_id"] for r in drop_first_season(games).collect()} == {2, 3, 4}
    filled = fill_nulls(games).filter("game_id = 2").first()
    assert filled["score_home"] == 0.0 and filled["team_home"] == "a"


def test_predictions_exact_and_simulated(spark):
    scored = spark.createDataFrame([(1, 20.5, 18.2), (2, 3.0, 3.0), (3, 1.0, 0.0), (4, None, 2.0)], "game_id long, home_score_avg double, away_score_avg double")
    exact = by_game(prediction_records(scored))
    assert set(exact) == {1, 2, 3}
    assert exact[1]["home_team_win_prob"] == pytest.approx(0.61375, abs=1e-5) and exact[1]["draw_prob"] == pytest.approx(0.06014, abs=1e-5)
    assert exact[2]["home_team_result"] == "Loss" and exact[2]["predicted_home_score"] == 3 and exact[2]["predicted_margin"] == 0
    assert exact[2]["bayes_factor"] == pytest.approx(1) and exact[3]["evidence_strength"] == "Decisive evidence"
    assert exact[3]["home_team_lose_prob"] == pytest.approx(0, abs=1e-9)
    for r in exact.values():
        assert r["home_team_win_prob"] + r["home_team_lose_prob"] + r["draw_prob"] == pytest.approx(1)
    drawn = by_game(simulate(scored.filter("game_id = 1"), 2000))[1]
    assert abs(drawn["home"] - exact[1]["home_team_win_prob"]) < 4 * (0.24 / 2000) ** 0.5


def test_equal_means_tie_and_small_chances_keep_their_digits(spark):
    means = [(1, 29.925, 29.925), (2, 0.1 + 0.2, 0.3), (3, 700.0, 700.0), (4, 40.0, 5.0), (5, 5.0, 40.0), (6, 0.0, 0.0)]
    rows = by_game(prediction_records(spark.createDataFrame(means, "game_id long, home_score_avg double, away_score_avg double")))
    for tie in (1, 3, 6):
        r = rows[tie]
        assert (r["home_team_result"], r["bayes_factor"], r["evidence_strength"]) == ("Loss", 1.0, "Anecdotal evidence") and r["home_team_win_prob"] == r["home_team_lose_prob"]
    assert rows[2]["home_team_result"] == "Win" and rows[2]["evidence_strength"] == "Anecdotal evidence"  # larger by one bit
    pmf = lambda m, k: Fraction(m) ** k / math.factorial(k)
    small = float(sum(pmf(5, a) * sum(pmf(40, h) for h in range(a)) for a in range(150))) * math.exp(-45)
    assert rows[4]["home_team_lose_prob"] == pytest.approx(small, rel=1e-11) and rows[5]["home_team_win_prob"] == pytest.approx(small, rel=1e-11)
    assert rows[4]["bayes_factor"] == pytest.approx(rows[4]["home_team_win_prob"] / small, rel=1e-11) and rows[5]["evidence_strength"] == "Negative evidence"


def test_picks_need_a_strict_edge(spark):
    rows = [(1, "a", "b", "Win", 0.5, 0.4, 2.1, 9.0), (2, "a", "b", "Win", 0.5, 0.4, 2.11, 9.0), (3, "a", "b", "Loss", 0.3, 0.5, 9.0, None), (4, "a", "b", "Loss", 0.0, 0.0, 9.0, 9.0), (5, "a", "b", "Loss", 0.2, 0.5, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "game_id long, team_home string, team_away string, home_team_result string, home_team_win_prob double, home_team_lose_prob double, odds_home double, odds_away double")
    assert {r["game_id"]: r["team"] for r in value_picks(df).collect()} == {2: "a", 5: "b"}


def test_evidence_bands_are_half_open(spark):
    ratios = [0.5, 1.0, 2.9, 3.0, 10.0, 30.0, 100.0, float("inf"), None]
    shown = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ratios)], "i int, x double").orderBy("i").select(evidence_strength(F.col("x"))).collect()]
    assert shown == ["Negative evidence", "Anecdotal evidence", "Anecdotal evidence", "Moderate evidence", "Strong evidence", "Very strong evidence", "Decisive evidence", "Decisive evidence", None]


def test_report_texts(spark):
    rows = spark.createDataFrame([(2, "c", "b", None), (1, "c", "a", 1.5)], "game_id long, competition_id string, team string, price double")
    assert report_texts(rows, ["competition_id"], PICK_LINES).first()["report"] == "Team: a\nPrice: 1.50\n\nTeam: b\nPrice: None"


def test_cutoff_of_most_agreement(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.62), (0, 0.6), (0, 0.1), (1, None), (None, 0.5)], "y int, p double")
    table = {r["cutoff_no"]: r for r in kappa_by_cutoff(rows, F.col("y"), F.col("p"), 50).collect()}
    assert (table[31]["tp"], table[31]["fp"], table[31]["kappa"]) == (2, 0, 1.0) and table[5]["kappa"] == pytest.approx(0.0) and max(table) == 45
    assert best_cutoff(rows, F.col("y"), F.col("p"), 50).first()["cutoff"] == 0.62
    assert not kappa_by_cutoff(rows.limit(0), F.col("y"), F.col("p")).count()


def test_elimination_keeps_what_matters(spark):
    df = spark.range(400).select((F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("noise"), (F.col("id") * 37 % 11).cast("double").alias("other"), F.round(F.exp(F.col("id") % 7 / 3)).alias("score"))
    assert eliminate_predictors(df, ["other", "x", "noise"], "score", 1) == ["x"]


def test_ratings_for_many_k_keep_a_row_a_game(spark, monkeypatch):
    """A row for each game and k was kept, joined and kept again, fifty times the games."""
    games = fixture_games(spark, "/root/testdata/sf0.001")
    ks, kept, keep = [21.0, 40.0, 70.0], [], session.keep

    def counted(df):
        kept.append(df.count())
        return keep(df)

    for module in (session, ratings):
        monkeypatch.setattr(module, "keep", counted, raising=False)
    swept = {r["k"]: r for r in ratings.sweep_k(games, ks).collect()}
    assert not kept
    rated = ratings.with_draws(ratings.rate_games(games, ks=ks).filter("w is not null"))
    first = games.groupBy("competition_id").agg(F.min("competition_year").alias("first"))
    later = games.join(first, "competition_id").filter("competition_year <> first").select("game_id")
    p = F.when(F.col("w") > 0.5, F.col("home_prob")).when(F.col("w") < 0.5, F.col("away_prob")).otherwise(F.col("draw_rate"))
    for r in rated.join(later, "game_id").groupBy("k").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("log_loss"), F.count(F.lit(1)).alias("games")).collect():
        assert swept[r["k"]]["games"] == r["games"] and swept[r["k"]]["log_loss"] == pytest.approx(r["log_loss"], rel=1e-12)
    together = ratings.forest_kappa(games, ks, trees=3).collect()
    assert together == ratings.forest_kappa(games, ks, trees=3, at_once=2).collect() and [r["k"] for r in together] == ks
    assert max(kept) <= games.count()
