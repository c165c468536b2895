"""Ratings kept up to date from a stream of games that may come late and out of order."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SETTINGS, Settings
from ..functions.columns import margin_outcome

RATED = "competition_id string, game_id long, w double, elo_home double, elo_away double, elo_home_prob double"
#: What a competition's state holds: the season and ratings so far as JSON, and the games that wait as JSON.
STATE = "year long, ratings string, waiting string"
WAITING = ["start", "game_id", "competition_year", "team_home", "team_away", "advantage", "w"]


def rate_in_order(games: list[list], year: int | None, ratings: dict[str, float], settings: Settings) -> tuple[list[tuple], int | None, dict[str, float]]:
    """(game_id, w, both ratings before the game, home probability) of games (lists of WAITING) in their order, and the
    season and ratings after them."""
    out = []
    for _, game_id, season, home, away, advantage, w in games:
        if year is not None and season != year:
            ratings = {t: r + settings.carry_over * (settings.rating_start - r) for t, r in ratings.items()}
        year = season
        a, b = ratings.get(home, settings.rating_start), ratings.get(away, settings.rating_start)
        p = 1 / (1 + 10 ** ((b - (a + advantage)) / 400))
        out.append((game_id, w, a, b, p))
        if w is not None:
            ratings[home], ratings[away] = a + settings.rating_k * (w - p), b - settings.rating_k * (w - p)
    return out, year, ratings


def live_ratings(games: DataFrame, late: str, advantages: DataFrame | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """competition_id, game_id, w, elo_home, elo_away (before the game), elo_home_prob of a stream of games: those of
    operators.ratings.rate_games, each game once the watermark (`late` behind the latest start_time) has
    passed it.

    A game waits in its competition's state until then, so games that come in another order than they were played are rated
    in the order of start_time and game_id; a timer of event time ends the wait of a competition without new games.
    Games that start at or before the watermark when they come are dropped by the engine, as late rows are. Games without a
    start_time or competition are left out; of rows that repeat a waiting game_id and start_time the last counts. advantages
    (competition_id, advantage; a table) are the home advantages, 0 where there is none: a stream can't know
    the mean margin of games to come. State grows with a competition's teams and its games within `late`.
    """
    if advantages is None:
        known = games.withColumn("__advantage", F.lit(0.0))
    else:
        table = advantages.select("competition_id", F.col("advantage").cast("double").alias("__advantage"))
        known = games.join(table, "competition_id", "left")
    rows = known.select(
        "competition_id",
        F.col("start_time").cast("timestamp").alias("start_time"),
        "game_id",
        "competition_year",
        "team_home",
        "team_away",
        F.coalesce("__advantage", F.lit(0.0)).alias("advantage"),
        margin_outcome(F.col("score_home") - F.col("score_away"), settings.margin_min, settings.margin_max).alias("w"),
    ).filter("competition_id is not null and start_time is not null")

    def rate(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        year, ratings, waiting = None, {}, {}
        if state.exists:
            year, held, games_held = state.get
            ratings, waiting = json.loads(held), {(g[0], g[1]): g for g in json.loads(games_held)}
        for batch in batches:
            starts = batch["start_time"].astype("datetime64[us]").astype("int64")
            for start, g in zip(starts, batch.itertuples(index=False)):
                w = None if g.w != g.w else float(g.w)
                waiting[int(start), int(g.game_id)] = [int(start), int(g.game_id), int(g.competition_year), g.team_home, g.team_away, float(g.advantage), w]
        passed = state.getCurrentWatermarkMs() * 1000
        due = [waiting.pop(place) for place in sorted(p for p in waiting if p[0] <= passed)]
        rated, year, ratings = rate_in_order(due, year, ratings, settings)
        state.update((year, json.dumps(ratings), json.dumps(list(waiting.values()))))
        if waiting:
            # the timer fires once the watermark is past it; whole milliseconds from the first waiting game on
            state.setTimeoutTimestamp(max(min(p[0] for p in waiting) // 1000, state.getCurrentWatermarkMs()) + 1)
        if rated:
            yield pd.DataFrame([(key[0], *r) for r in rated], columns=[c.split()[0] for c in RATED.split(", ")]).astype({"w": float})

    stream = rows.withWatermark("start_time", late)
    return stream.groupBy("competition_id").applyInPandasWithState(rate, RATED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
