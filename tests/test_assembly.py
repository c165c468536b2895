"""How often standings and statistics are dealt out, and standings of odd rounds."""

from pyspark.sql import functions as F

from touchline.operators import standings
from touchline.plans import registry
from touchline.plans.fixtures import games


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_standings_are_dealt_out_once(spark):
    """They were dealt out by round, then again by season."""
    assert plan(standings.ladder(games(spark, "/root/testdata/sf0.001"))).count("Exchange hashpartitioning") == 1


def test_statistics_of_unknown_teams_are_not_added_up(spark):
    """All suppliers' were added up and pivoted, of which the join then kept seventeen."""
    found = registry.competition_statistics(spark, "/root/testdata/sf0.001")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and text.index("LeftSemi") > text.index("Aggregate")


def test_rounds_of_several_games_and_without_a_number(spark):
    rows = [
        (3, 1, "a", "b", 5.0, 1.0), (1, 1, "a", "c", 2.0, 2.0), (2, 2, "b", "a", 9.0, 3.0), (4, 3, "a", "b", None, None), (5, None, "c", "a", 4.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "game_id long, round_id long, team_home string, team_away string, score_home double, score_away double")
    df = df.withColumns({"competition_id": F.lit("x"), "competition_year": F.lit(2020), "start_time": F.lit("2020-01-01").cast("timestamp_ntz")})
    found = {(r["team"], r["round_id"]): (r["wins"], r["losses"], r["draws"], r["points_for"], r["points_against"], r["recent_form"]) for r in standings.ladder(df).collect()}
    assert found == {
        ("a", None): (0, 1, 0, 0, 4, "L"), ("a", 1): (1, 1, 1, 7, 7, "LDW"), ("a", 2): (1, 2, 1, 10, 16, "LDWL"), ("a", 3): (1, 2, 1, 10, 16, "LDWL"),
        ("b", 1): (0, 1, 0, 1, 5, "L"), ("b", 2): (1, 1, 0, 10, 8, "LW"), ("b", 3): (1, 1, 0, 10, 8, "LW"),
        ("c", None): (1, 0, 0, 4, 0, "W"), ("c", 1): (1, 0, 1, 6, 2, "WD"),
    }
