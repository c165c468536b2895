"""Sequential ratings of teams: each game moves both ratings, each new season draws them together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.columns import margin_outcome
from ..session import keep, release
from . import cells
from .boosting import together

RATED = "competition_id string, game_id long, k double, w double, elo_home double, elo_away double, elo_home_prob double"
#: Buckets of the home probability: twentieths.
BUCKETS = 21
#: Rows after which a task counts the cells that it holds.
TALLIED = 1 << 18


def _rateable(games: DataFrame, settings: Settings) -> DataFrame:
    """What the recurrence reads of each game. `later`: not of its competition's first season."""
    margin = F.col("score_home") - F.col("score_away")
    of_competition = games.groupBy("competition_id").agg(F.coalesce(F.avg(margin), F.lit(0.0)).alias("advantage"), F.min("competition_year").alias("__first"))
    return games.join(of_competition, "competition_id").select(
        "competition_id", "competition_year", "game_id", "start_time", "team_home", "team_away", "advantage",
        margin_outcome(margin, settings.margin_min, settings.margin_max).alias("w"),
        F.coalesce(F.col("competition_year") != F.col("__first"), F.lit(False)).alias("later"),
    )


def _along(group: pd.DataFrame, steps: np.ndarray, settings: Settings) -> tuple[pd.DataFrame, np.ndarray]:
    """A competition's games in their order, and elo_home, elo_away and elo_home_prob of each for each of steps."""
    group = group.sort_values(["start_time", "game_id"], kind="stable")
    ratings: dict[str, np.ndarray] = {}
    start, year, advantage = np.full(len(steps), settings.rating_start), None, group["advantage"].iloc[0]
    out = np.empty((3, len(group), len(steps)))
    for n, (season, home, away, w) in enumerate(zip(group["competition_year"], group["team_home"], group["team_away"], group["w"])):
        if year is not None and season != year:
            ratings = {t: r + settings.carry_over * (settings.rating_start - r) for t, r in ratings.items()}
        year = season
        a, b = ratings.get(home, start), ratings.get(away, start)
        p = 1 / (1 + 10 ** ((b - (a + advantage)) / 400))
        out[:, n] = a, b, p
        if w == w:
            ratings[home], ratings[away] = a + steps * (w - p), b - steps * (w - p)
    return group, out


def rate_games(games: DataFrame, settings: Settings = SETTINGS, ks: list[float] | None = None) -> DataFrame:
    """competition_id, game_id, k, w, elo_home, elo_away (before the game), elo_home_prob of every
    game and each k of ks (the setting's by default).

    The recurrence runs along the games of one competition, in the order of start_time and game_id, for
    all ks at once: a game is dealt out once, and each team's ratings are an array over ks. So a group is
    as large as one competition's history. Unplayed games get ratings but move none. The home advantage is
    the competition's mean margin.
    """
    rows = _rateable(games, settings)
    steps = np.array(ks or [settings.rating_k], float)

    def rate(group: pd.DataFrame) -> pd.DataFrame:
        group, out = _along(group, steps, settings)
        rated = group[["competition_id", "game_id", "w"]]
        rated = rated.loc[rated.index.repeat(len(steps))].reset_index(drop=True)
        rated["k"] = np.tile(steps, len(group))
        rated["elo_home"], rated["elo_away"], rated["elo_home_prob"] = out.reshape(3, -1)
        return rated[[c.split()[0] for c in RATED.split(", ")]]

    return rows.groupBy("competition_id").applyInPandas(rate, RATED)


def _bucket() -> Column:
    """0 to 20: the home probability in twentieths, half to even."""
    return F.bround(F.col("elo_home_prob") * (BUCKETS - 1)).cast("int").alias("prob_bucket")


def draw_rates(rated: DataFrame) -> DataFrame:
    """k, prob_bucket, draw_rate, games: the share of draws by the home probability in twentieths."""
    return rated.groupBy("k", _bucket()).agg(F.avg(F.when(F.col("w") == 0.5, 1.0).otherwise(0.0)).alias("draw_rate"), F.count(F.lit(1)).alias("games"))


def with_draws(rated: DataFrame) -> DataFrame:
    """Adds elo_diff, elo_away_prob, draw_rate and both probabilities less their share of it.

    rated is read twice, so it should be cheap to read (see session.settle).
    """
    rates = draw_rates(rated).select("k", "prob_bucket", "draw_rate")  # at most 21 rows for each k
    out = rated.withColumn("prob_bucket", _bucket()).join(F.broadcast(rates), ["k", "prob_bucket"], "left")
    home = F.col("elo_home_prob") * (1 - F.col("draw_rate"))
    away = (1 - F.col("elo_home_prob")) * (1 - F.col("draw_rate"))
    return out.select(*rated.columns, (F.col("elo_home") - F.col("elo_away")).alias("elo_diff"), "draw_rate", home.alias("home_prob"), away.alias("away_prob"), (home - away).alias("elo_prob_diff"))


def _rates_by_bucket(rows: DataFrame, steps: np.ndarray, settings: Settings) -> np.ndarray:
    """The share of draws by k and bucket of the home probability (NaN without games): a competition sends counts
    of 21 buckets a k, which Spark sums, so 21 rows a k come to the driver."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        group, (_, _, p) = _along(group, steps, settings)
        w = group["w"].to_numpy(float)
        cell = (np.arange(len(steps)) * BUCKETS + np.rint(p * (BUCKETS - 1)).astype(int))[w == w]
        n = np.bincount(cell.ravel(), minlength=len(steps) * BUCKETS)
        draws = np.bincount(cell[w[w == w] == 0.5].ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        return pd.DataFrame({"cell": at, "n": n[at], "draws": draws[at]})

    out = np.full(len(steps) * BUCKETS, np.nan)
    for r in rows.groupBy("competition_id").applyInPandas(count, "cell long, n long, draws long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("draws").alias("draws")).collect():
        out[r["cell"]] = r["draws"] / r["n"]
    return out.reshape(len(steps), BUCKETS)


def sweep_k(games: DataFrame, ks: list[float], settings: Settings = SETTINGS) -> DataFrame:
    """k, log_loss, games: how well the ratings with each k foretell home win, draw and away win of the
    played games after each competition's first season.

    Games are rated twice, for the shares of draws and for the losses; a competition sends sums by k, so
    neither a row nor a written value for each game and k is made.
    """
    steps, rows = np.array(ks, float), _rateable(games, settings)
    rates = _rates_by_bucket(rows, steps, settings)

    def lose(group: pd.DataFrame) -> pd.DataFrame:
        group, (_, _, p) = _along(group, steps, settings)
        w = group["w"].to_numpy(float)
        judged = (w == w) & group["later"].to_numpy(bool)
        p, w = p[judged], w[judged, None]
        draw = rates[np.arange(len(steps)), np.rint(p * (BUCKETS - 1)).astype(int)]
        chance = np.where(w > 0.5, p * (1 - draw), np.where(w < 0.5, (1 - p) * (1 - draw), draw))
        return pd.DataFrame({"k": steps, "loss": -np.log(np.maximum(chance, 1e-15)).sum(0), "n": len(p)}).head(len(steps) if len(p) else 0)

    lost = rows.groupBy("competition_id").applyInPandas(lose, "k double, loss double, n long")
    return lost.groupBy("k").agg((F.sum("loss") / F.sum("n")).alias("log_loss"), F.sum("n").alias("games"))


def _wide(rows: DataFrame, steps: np.ndarray, settings: Settings) -> DataFrame:
    """game_id and w of the played games after the first season, and a column elo_home_i, elo_away_i and
    elo_home_prob_i for each i of steps: what reads one k reads its columns only."""
    names = [f"{name}_{i}" for name in ("elo_home", "elo_away", "elo_home_prob") for i in range(len(steps))]

    def rate(group: pd.DataFrame) -> pd.DataFrame:
        group, out = _along(group, steps, settings)
        seen = (group["w"].notna() & group["later"]).to_numpy()
        values = pd.DataFrame(out.transpose(1, 0, 2).reshape(len(group), -1)[seen], columns=names)
        return pd.concat([group.loc[seen, ["game_id", "w"]].reset_index(drop=True), values], axis=1)

    return rows.groupBy("competition_id").applyInPandas(rate, f"game_id long, w double, {', '.join(f'{n} double' for n in names)}")


def forest_kappa(games: DataFrame, ks: list[float], trees: int = 100, settings: Settings = SETTINGS, seed: int = 42, at_once: int = 10) -> DataFrame:
    """k, kappa: agreement beyond chance of a forest on ratings and probabilities with the results of
    played games after the first season, for games that hashes of game_id keep from its training (a
    fifth). One forest for each k.

    Games are rated, and their ratings kept, for `at_once` ks at a time: a row a game, three columns a k. Forests learn from
    how many games there are in each cell of bins (see cells), which one pass counts for all of these ks; a k's cells, a bounded number,
    are one group.
    """
    rows = keep(_rateable(games, settings))
    rates = np.nan_to_num(_rates_by_bucket(rows, np.array(ks, float), settings))
    found = []
    for first in range(0, len(ks), at_once):
        some = ks[first : first + at_once]
        wide = keep(_wide(rows, np.array(some, float), settings))
        found += _kappas(wide, some, rates[first : first + at_once], trees, seed)
        release(wide)
    release(rows)
    return games.sparkSession.createDataFrame(found, "k double, kappa double")


def _predictors(i: int, home: np.ndarray, away: np.ndarray, p: np.ndarray, rates: np.ndarray) -> list[np.ndarray]:
    """Ratings, and probabilities as with_draws gives them, of the i-th k."""
    draw = rates[i][np.rint(p * (BUCKETS - 1)).astype(int)]
    return [home, away, p * (1 - draw), draw, (1 - p) * (1 - draw)]


def _kappas(wide: DataFrame, ks: list[float], rates: np.ndarray, trees: int, seed: int) -> list[tuple[float, float]]:
    """k and kappa of each k of _wide's rows."""
    rows = wide.withColumn("learned", F.pmod(F.xxhash64("game_id"), F.lit(100)) < 80)
    shares = [b / cells.BINS for b in range(1, cells.BINS)]
    # quantiles of ratings, and of the three probabilities that follow from one
    table = [F.lit([float(r) for r in of_k]) for of_k in rates]
    quantiles = []
    for i in range(len(ks)):
        p = F.col(f"elo_home_prob_{i}")
        draw = F.get(table[i], F.bround(p * (BUCKETS - 1)).cast("int"))
        values = [F.col(f"elo_home_{i}"), F.col(f"elo_away_{i}"), p * (1 - draw), draw, (1 - p) * (1 - draw)]
        quantiles += [F.percentile_approx(v, shares, 1000).alias(f"q{i}_{j}") for j, v in enumerate(values)]
    row = rows.filter("learned").agg(*quantiles).first()
    bounds = [[np.unique(np.array(row[f"q{i}_{j}"] or [], float)) for j in range(5)] for i in range(len(ks))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in ks]
        tallies = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ks]

        def tally(i: int) -> None:
            codes, n = np.unique(np.concatenate(held[i]), return_counts=True)
            both, place = np.unique(np.concatenate([tallies[i][0], codes]), return_inverse=True)
            tallies[i], held[i] = (both, np.bincount(place, np.concatenate([tallies[i][1], n]), len(both)).astype(np.int64)), []

        n = 0
        for batch in together(batches):
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            w, train = column("w"), column("learned")
            label = np.where(w > 0.5, 2, np.where(w < 0.5, 0, 1))
            for i in range(len(ks)):
                values = _predictors(i, *(column(f"{c}_{i}") for c in ("elo_home", "elo_away", "elo_home_prob")), rates)
                held[i].append(cells.pack([np.searchsorted(b, v) for b, v in zip(bounds[i], values)], label, train))
            n += batch.num_rows
            if n >= TALLIED:
                n = 0
                for i in range(len(ks)):
                    tally(i)
        for i in range(len(ks)):
            if held[i]:
                tally(i)
            codes, counts = tallies[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), i, np.int32)), pa.array(codes), pa.array(counts)], names=["i", "code", "n"])

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        i = int(group["i"].iloc[0])
        return pd.DataFrame({"i": [i], "kappa": [cells.kappa(group["code"].to_numpy(), group["n"].to_numpy(), 5, trees, seed)]})

    counted = rows.drop("game_id").mapInArrow(count, "i int, code long, n long").groupBy("i", "code").agg(F.sum("n").alias("n"))
    found = {r["i"]: r["kappa"] for r in counted.groupBy("i").applyInPandas(judge, "i int, kappa double").collect()}
    return [(float(k), found.get(i, 0.0)) for i, k in enumerate(ks)]
