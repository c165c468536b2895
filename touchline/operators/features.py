"""Features of games from the panel of teams, rounds and seasons.

A games table has game_id, competition_id, competition_year, round_id, round_name, start_time,
team_home, team_away, score_home, score_away (null while unplayed). Every function takes it and
returns one row per game; windows lie within a competition, so competitions spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import signed_result

SEASON = ["competition_id", "competition_year"]


def sides(games: DataFrame) -> DataFrame:
    """One row for each game and team: own and other team's values, from one scan."""
    side = lambda own, other, home: F.struct(
        F.col(f"team_{own}").alias("team"), F.lit(home).alias("is_home"), F.col(f"score_{own}").alias("own"), F.col(f"score_{other}").alias("other")
    )
    kept = [F.col(c) for c in ("game_id", "competition_id", "competition_year", "round_id", "start_time")]
    return games.select(*kept, F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select(*kept, "s.*")


def back_to_games(by_side: DataFrame, columns: list[str]) -> DataFrame:
    """game_id and each column as <column>_home and <column>_away."""
    pick = [F.max(F.when(F.col("is_home") == home, F.col(c))).alias(f"{c}_{name}") for c in columns for home, name in ((True, "home"), (False, "away"))]
    return by_side.groupBy("game_id").agg(*pick)


def with_previous_results(games: DataFrame) -> DataFrame:
    """Adds prev_result_home: margin of the home team's previous home game of the season;
    prev_result_away: of the away team's previous away game, still as home less away; and
    prev_result_diff, their difference, taken before missing ones become 0."""
    margin = F.col("score_home") - F.col("score_away")
    order = ["round_id", "game_id"]
    home = F.lag(margin).over(W.partitionBy(*SEASON, "team_home").orderBy(*order))
    away = F.lag(margin).over(W.partitionBy(*SEASON, "team_away").orderBy(*order))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = games.withColumns({"__h": home, "__a": away})
    return found.withColumns({"prev_result_home": zero(F.col("__h")), "prev_result_away": zero(F.col("__a")), "prev_result_diff": zero(F.col("__h") - F.col("__a"))}).drop("__h", "__a")


def previous_results(games: DataFrame) -> DataFrame:
    return with_previous_results(games).select("game_id", "prev_result_home", "prev_result_away", "prev_result_diff")


def turn_around(games: DataFrame) -> DataFrame:
    """Days since each team's game before, across seasons; the mean of all such gaps where there is
    none."""
    order = W.partitionBy("competition_id", "team").orderBy("start_time", "game_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("start_time").over(order), F.col("start_time")) / 86_400_000_000.0
    gaps = sides(games).withColumn("gap", gap)
    mean = gaps.select(F.avg("gap")).scalar()
    filled = gaps.withColumn("turn_around", F.coalesce(F.col("gap"), mean))
    return back_to_games(filled, ["turn_around"]).withColumn("turn_around_diff", F.col("turn_around_home") - F.col("turn_around_away"))


def with_matchup_form(games: DataFrame, form_games: int = 5) -> DataFrame:
    """Adds matchup_form: signed results of the last form_games meetings of the same two teams at the
    same ends."""
    last = W.partitionBy("competition_id", "team_home", "team_away").orderBy("start_time", "game_id").rowsBetween(-form_games, -1)
    form = F.sum(signed_result(F.col("score_home"), F.col("score_away"))).over(last)
    return games.withColumn("matchup_form", F.coalesce(form, F.lit(0)).cast("long"))


def matchup_form(games: DataFrame, form_games: int = 5) -> DataFrame:
    return with_matchup_form(games, form_games).select("game_id", "matchup_form")


def _strict_sum(value: Column, frame) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count(value).over(frame) == F.count(F.lit(1)).over(frame), F.sum(value).over(frame))


def season_stats(games: DataFrame) -> DataFrame:
    """Each side's record, points for and against before the game, and its last margin, this season."""
    order = W.partitionBy(*SEASON, "team").orderBy("game_id")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = sides(games).select(
        "game_id",
        "is_home",
        F.coalesce(F.sum(signed_result(F.col("own"), F.col("other"))).over(before), F.lit(0)).cast("long").alias("season_record"),
        zero(_strict_sum(F.col("own"), before)).alias("season_points_for"),
        zero(_strict_sum(F.col("other"), before)).alias("season_points_against"),
        zero(F.lag(F.col("own") - F.col("other")).over(order)).alias("season_points_diff"),
    )
    return back_to_games(found, ["season_record", "season_points_for", "season_points_against", "season_points_diff"])


def form_stats(games: DataFrame, form_games: int = 5) -> DataFrame:
    """Each side's record and points over its last form_games games of the season: points are summed
    while there are not more than that many games, and averaged from then on."""
    order = W.partitionBy(*SEASON, "team").orderBy("game_id")
    last = order.rowsBetween(-form_games, -1)
    early = F.row_number().over(order) <= form_games

    def points(value: Column) -> Column:
        total = _strict_sum(value, last)
        return F.coalesce(F.when(early, total).otherwise(total / form_games), F.lit(0.0))

    found = sides(games).select(
        "game_id",
        "is_home",
        F.coalesce(F.sum(signed_result(F.col("own"), F.col("other"))).over(last), F.lit(0)).cast("long").alias("form_record"),
        points(F.col("own")).alias("form_points_for"),
        points(F.col("other")).alias("form_points_against"),
        points(F.col("own") - F.col("other")).alias("form_points_diff"),
    )
    return back_to_games(found, ["form_record", "form_points_for", "form_points_against", "form_points_diff"])


def small_rounds(games: DataFrame, most: int = 5) -> DataFrame:
    """Per season and round: small_round is 1 for a named round of at most `most` games, after_small_round
    1 for the round that follows one."""
    rounds = games.groupBy(*SEASON, "round_id").agg((F.bool_or(F.col("round_name").contains("Round")) & (F.count(F.lit(1)) <= most)).cast("int").alias("small_round"))
    order = W.partitionBy(*SEASON).orderBy("round_id")
    return rounds.withColumn("after_small_round", F.lag("small_round", 1, 0).over(order))


def with_small_rounds(games: DataFrame, most: int = 5) -> DataFrame:
    """Adds both flags of the game's round."""
    return games.join(small_rounds(games, most), [*SEASON, "round_id"], "left")


def with_easy_columns(games: DataFrame, closed_years: tuple[int, ...] = (2020,)) -> DataFrame:
    """Adds start_hour, game_day (the weekday's name), corona_season (is the season one of
    closed_years?) and, where games have both positions, position_diff."""
    added = {"corona_season": F.col("competition_year").isin(*closed_years), "start_hour": F.hour("start_time").cast("long"), "game_day": F.date_format("start_time", "EEEE")}
    if {"position_home_ladder", "position_away_ladder"} <= set(games.columns):
        added["position_diff"] = F.col("position_home_ladder") - F.col("position_away_ladder")
    return games.withColumns(added)


def bye_flags(games: DataFrame) -> DataFrame:
    """For each game and side: did the team sit out the round before?"""
    order = W.partitionBy(*SEASON, "team").orderBy("round_id", "game_id")
    missed = F.coalesce(F.col("round_id") - F.lag("round_id").over(order) > 1, F.lit(False)).cast("int")
    return back_to_games(sides(games).withColumn("bye_before", missed), ["bye_before"])


def fixture_features(games: DataFrame) -> DataFrame:
    """games with previous results, form and round flags, added on the row itself, and turnarounds,
    which need both sides apart and come back by game."""
    return with_small_rounds(with_matchup_form(with_previous_results(games))).join(turn_around(games), "game_id")
