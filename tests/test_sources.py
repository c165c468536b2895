import os

from pyspark.sql import functions as F

from touchline.functions.names import clean_names, suffix_join, with_clean_names
from touchline.operators.cleaning import split_by_hash
from touchline.operators.models import feature_importances, load_model, predict_scores, save_model, train_score_model
from touchline.operators.standings import ROUND, assemble, pivot_statistics
from touchline.sources import store, xml
from touchline.streaming.standings import games_per_window, live_standings, upsert_predictions

GAME = """<gameFixture gameId="{g}" gameNumber="1" gameStateName="Final" startTime="2020-03-01T18:00:00" startTimeUTC="2020-03-01T08:00:00Z" venueName="V" city="Y" crowd="900" broadcastChannel="Nine"><teams>
    <team isHomeTeam="true" team="a" teamFinalScore="12" teamHeadToHeadOdds="1.5" teamLineOdds="1.9" teamLineAmount="-4.5"/><team isHomeTeam="false" team="b" teamFinalScore=""/></teams></gameFixture>"""
LADDER = """<ladder><ladderposition position="1" teamName="a" wins="{w}" draws="0" losses="0" pointsFor="{w}0" recentForm="{form}" closeGames="x" dayRecord="1-0"/></ladder>"""
STATISTICS = """<leaderboard seasonId="2020" competitionId="7" competitionName="n" roundNumber="2"><leaderboardStats>
  <leaderboardStat ID="3" statName="Tries"><leaderboardEntry TeamID="1" TeamName="a" TeamAbbrev="A" Value="4.5" Rank="1" Appearances="2"/><leaderboardEntry TeamID="2" TeamName="b" Value="?"/></leaderboardStat></leaderboardStats></leaderboard>"""


def test_fixture_files(spark, tmp_path):
    rounds = "".join(f'<roundFixtures roundId="{r}" roundName="Round {r}">{GAME.format(g=r * 10)}</roundFixtures>' for r in (1, 2))
    one_side = '<gameFixture gameId="99"><teams><team isHomeTeam="true" team="a"/></teams></gameFixture>'
    (tmp_path / "2020.xml").write_text(f'<fixtures>{rounds}<roundFixtures roundId="3" roundName="x"></roundFixtures><roundFixtures roundId="4">{one_side}</roundFixtures></fixtures>')
    documents = xml.read_documents(spark, str(tmp_path), xml.FIXTURES_TAG, xml.FIXTURES_SCHEMA)
    games = xml.games_from_sides(xml.fixture_sides(documents))
    rows = games.orderBy("game_id").collect()
    assert [(r["game_id"], r["competition_year"], r["round_id"], r["team_home"], r["team_away"], r["team_final_score_home"], r["team_final_score_away"]) for r in rows] == [(10, 2020, 1, "a", "b", 12.0, None), (20, 2020, 2, "a", "b", 12.0, None)]
    first = rows[0]
    assert (first["start_time"].hour, first["start_time_utc"].hour, first["crowd"], first["broadcast_channel1"], first["broadcast_channel2"]) == (18, 8, 900.0, "Nine", None)
    assert (first["team_head_to_head_odds_home"], first["team_line_odds_home"], first["team_line_amount_home"], first["game_number"]) == (1.5, 1.9, -4.5, 1)
    assert {"score_home", "odds_away", "line_odds_home", "line_amount_away"} <= set(xml.panel_games(games).columns)


def test_ladder_and_statistic_files_and_their_join(spark, tmp_path):
    for name in ("fixtures", "ladders/2020", "statistics/2020"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "fixtures/2020.xml").write_text(f'<fixtures><roundFixtures roundId="2" roundName="Round 2">{GAME.format(g=1)}</roundFixtures></fixtures>')
    for r, form in ((1, "W"), (2, "WW"), (4, "WWL")):
        (tmp_path / f"ladders/2020/{r}.xml").write_text(LADDER.format(w=r, form=form))
    for r in (1, 2):
        (tmp_path / f"statistics/2020/{r}.xml").write_text(STATISTICS)
    ladder = xml.ladder_rows(xml.read_documents(spark, str(tmp_path / "ladders/2020"), xml.LADDER_TAG, xml.LADDER_SCHEMA))
    assert sorted((r["round_id"], r["competition_year"], r["team"], r["wins"], r["points_for"], r["close_games"], r["day_record"]) for r in ladder.collect()) == [(1, 2020, "a", 1.0, 10.0, None, "1-0"), (2, 2020, "a", 2.0, 20.0, None, "1-0")]
    long = xml.statistic_rows(xml.read_documents(spark, str(tmp_path / "statistics/2020"), xml.STATISTICS_TAG, xml.STATISTICS_SCHEMA.replace("leaderboardStat array", "leaderboardStats struct<leaderboardStat array") + ">").withColumn("leaderboardStat", F.col("leaderboardStats.leaderboardStat")))
    got = sorted((r["round_id"], r["stat_name"], r["stat_id"], r["team_name"], r["value"], r["rank"], r["appearances"], r["season_id"]) for r in long.filter("team_name = 'a'").collect())
    assert got == [(1, "Tries", "3", "a", 4.5, 1, 2, "2020"), (2, "Tries", "3", "a", 4.5, 1, 2, "2020")]
    wide = pivot_statistics(long.withColumns({"competition_id": F.lit("1"), "team": F.col("team_name")}), [*ROUND, "team"], ["Tries"])
    games = xml.games_from_sides(xml.fixture_sides(xml.read_documents(spark, str(tmp_path / "fixtures"), xml.FIXTURES_TAG, xml.FIXTURES_SCHEMA)))
    row = assemble(games, ladder, wide).first()
    assert (row["wins_home_ladder"], row["win_rate_home_ladder"], row["avg_points_for_home_ladder"], row["recent_form_home_ladder"], row["close_games_home_ladder"]) == (1.0, 0.5, 5.0, 1.0, 0.0)
    assert row["wins_away_ladder"] is None and row["Tries_home_performance"] == 4.5 and row["Tries_away_performance"] == 0.0


def test_rounds_stop_at_the_first_gap(spark):
    df = spark.createDataFrame([("x", r) for r in (1, 2, 2, 4, 5)] + [("y", 2)], "k string, round_id long")
    assert sorted((r["k"], r["round_id"]) for r in xml.until_gap(df, ["k"]).collect()) == [("x", 1), ("x", 2), ("x", 2)]


def test_names():
    assert clean_names(["venueName", "venue_name", "40/20 Kick", "Captain's Challenge Success %", "roundId", "A B"]) == ["venue_name", "venue_name_2", "x40_20_kick", "captains_challenge_success_percent", "round_id", "a_b"]


def test_suffixes_only_where_both_have_a_column(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 5, 6)], "k int, x int, z int")
    assert suffix_join(a, b, ["k"], ("_l", "_r")).columns == ["k", "x_l", "y", "x_r", "z"]


def test_keyed_store(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "game_id long, home_team_result string, home_team_win_prob double, home_team_lose_prob double")
    spark.sql("DROP TABLE IF EXISTS predictions_test")
    store.save_predictions(spark, "predictions_test", rows((1, "Win", 0.6, 0.3), (2, "Loss", 0.2, 0.7)))
    for _ in range(2):
        store.save_predictions(spark, "predictions_test", rows((2, "Win", 0.8, 0.1), (3, "Win", 0.9, 0.1), (3, "Win", 0.9, 0.1)))
    got = {r["game_id"]: r["home_team_win_prob"] for r in spark.table("predictions_test").collect()}
    assert got == {1: 0.6, 2: 0.8, 3: 0.9}
    spark.sql("DROP TABLE predictions_test")
    latest = store.latest(spark.createDataFrame([(1, 1), (1, 2)], "k int, t int"), "k", "t")
    assert latest.first()["t"] == 2


def test_csv_export(spark, tmp_path):
    path = store.export_csv(spark.range(3), str(tmp_path), 2024, 7)
    path = store.export_csv(spark.range(2), str(tmp_path), 2024, 7)
    files = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert path.endswith("2024/round7_2024") and len(files) == 1 and open(f"{path}/{files[0]}").read().split() == ["id", "0", "1"]


def test_score_model_round_trip(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.lit("t"), F.col("id") % 4).alias("team"), (F.col("id") % 7).cast("double").alias("x"), (5 + F.col("id") % 4 * 4).cast("double").alias("score"))
    model, deviance = train_score_model(df, ["team", "x"], "score")
    save_model(model, str(tmp_path / "m"))
    again = predict_scores(load_model(str(tmp_path / "m")), df.limit(1).withColumn("team", F.lit("never seen")), "expected").first()["expected"]
    assert deviance < 0.5 and 4 < again < 20
    assert feature_importances(model, df, 3).count() == 3


def test_standings_from_a_stream(spark, tmp_path):
    schema = "game_id long, competition_id string, competition_year long, round_id long, start_time timestamp_ntz, team_home string, team_away string, score_home double, score_away double"
    rows = spark.createDataFrame([(1, "c", 2020, 1, None, "a", "b", 3.0, 1.0), (2, "c", 2020, 2, None, "b", "a", 2.0, 2.0), (3, "c", 2020, 3, None, "b", "a", None, None)], schema)
    rows.write.parquet(str(tmp_path / "games"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "games"))
    query = live_standings(stream).writeStream.outputMode("complete").format("memory").queryName("live_table").start()
    query.processAllAvailable()
    query.stop()
    got = {r["team"]: (r["wins"], r["losses"], r["draws"], r["points_for"]) for r in spark.table("live_table").collect()}
    assert got == {"a": (1, 0, 1, 5.0), "b": (0, 1, 1, 3.0)}


def test_games_per_window_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'c' AS competition_id, timestamp_ntz'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, id) AS start_time FROM range(5)")
    rows.write.parquet(str(tmp_path / "games"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "games"))
    query = games_per_window(stream, "start_time", "2 hours", "1 day").writeStream.outputMode("complete").format("memory").queryName("windows_table").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["games"] for r in spark.table("windows_table").collect()) == [1, 2, 2]


def test_predictions_from_a_stream(spark, tmp_path):
    schema = "game_id long, home_team_result string, home_team_win_prob double, home_team_lose_prob double"
    spark.sql("DROP TABLE IF EXISTS predictions_stream")
    for i, rows in enumerate(([(1, "Win", 0.6, 0.3)], [(1, "Loss", 0.1, 0.8), (2, "Win", 0.7, 0.2)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = upsert_predictions(stream, "predictions_stream", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
    assert {r["game_id"]: r["home_team_result"] for r in spark.table("predictions_stream").collect()} == {1: "Loss", 2: "Win"}
    spark.sql("DROP TABLE predictions_stream")


def test_split_and_clean_columns(spark):
    one, other = split_by_hash(spark.range(1000), "id", 80)
    assert one.count() + other.count() == 1000 and 700 < one.count() < 900 and not one.join(other, "id").count()
    assert with_clean_names(spark.createDataFrame([(1, 2)], "teamName int, roundId int")).columns == ["team_name", "round_id"]
