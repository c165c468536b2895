"""Expected scores, outcome probabilities, prediction records and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.columns import evidence_strength, outcome_probabilities, poisson_terms, win_ratio


def expected_scores(played: DataFrame, ahead: DataFrame) -> DataFrame:
    """ahead with home_score_avg and away_score_avg: means of the home team's home scores and of the
    away team's away scores in played games of the competition (null without any)."""
    home = played.groupBy("competition_id", "team_home").agg(F.avg("score_home").alias("home_score_avg"))
    away = played.groupBy("competition_id", "team_away").agg(F.avg("score_away").alias("away_score_avg"))
    return ahead.join(home, ["competition_id", "team_home"], "left").join(away, ["competition_id", "team_away"], "left")


def prediction_records(scored: DataFrame) -> DataFrame:
    """game_id, result, three probabilities, the likeliest score and margin, and the evidence for the
    home side: the ratio of both win probabilities and its band.

    scored has game_id, home_score_avg, away_score_avg. Probabilities are those of independent
    Poisson scores, exact; the likeliest score of a mean is its whole part. The result is Win if home
    is strictly likelier, which is where its mean is larger, else Loss; equal means have ratio 1.
    """
    known = scored.filter("home_score_avg is not null and away_score_avg is not null")
    p = known.withColumn("p", outcome_probabilities(F.col("home_score_avg"), F.col("away_score_avg")))
    ratio = win_ratio(F.col("home_score_avg"), F.col("away_score_avg"), F.col("p.home"), F.col("p.away"))
    return p.select(
        "game_id",
        F.when(F.col("home_score_avg") > F.col("away_score_avg"), "Win").otherwise("Loss").alias("home_team_result"),
        F.col("p.home").alias("home_team_win_prob"),
        F.col("p.away").alias("home_team_lose_prob"),
        F.col("p.draw").alias("draw_prob"),
        "home_score_avg",
        "away_score_avg",
        F.floor("home_score_avg").alias("predicted_home_score"),
        F.floor("away_score_avg").alias("predicted_away_score"),
        (F.floor("home_score_avg") - F.floor("away_score_avg")).alias("predicted_margin"),
        ratio.alias("bayes_factor"),
        evidence_strength(ratio).alias("evidence_strength"),
    )


def simulate(scored: DataFrame, draws: int = 2_000, seed: int = 7) -> DataFrame:
    """game_id, home, away, draw: shares of simulated games, to check the exact probabilities.

    Scores are drawn by inverting the cumulative probabilities with hashes of (seed, game, draw), a
    row for each draw, so draws spread over the tasks.
    """
    def cumulative(mean: Column) -> Column:
        return F.aggregate(poisson_terms(mean), F.array(F.lit(0.0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + p)))

    def u(side: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "game_id", "draw_no", F.lit(side)), F.lit(1 << 40)).cast("double") / float(1 << 40)

    tables = scored.select("game_id", cumulative(F.col("home_score_avg")).alias("ch"), cumulative(F.col("away_score_avg")).alias("ca"))
    drawn = tables.withColumn("draw_no", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    score = lambda table, side: F.size(F.filter(table, lambda c: c <= u(side)))
    games = drawn.select("game_id", score("ch", "h").alias("h"), score("ca", "a").alias("a"))
    share = lambda c: F.avg(c.cast("double"))
    return games.groupBy("game_id").agg(share(F.col("h") > F.col("a")).alias("home"), share(F.col("h") < F.col("a")).alias("away"), share(F.col("h") == F.col("a")).alias("draw"))


def value_picks(predictions: DataFrame, edge: float = SETTINGS.edge) -> DataFrame:
    """Sides whose price beats the fair price of their probability by the edge, strictly.

    predictions has team_home, team_away, home_team_result, win and lose probabilities, odds_home,
    odds_away. A side is looked at if its win is predicted. Null prices and zero probabilities pick
    nothing.
    """
    home = F.col("home_team_result") == "Win"
    side = lambda name, p: F.struct(F.col(f"team_{name}").alias("team"), F.col(f"odds_{name}").alias("price"), F.try_divide(F.lit(1.0), F.col(p)).alias("price_min"))
    chosen = F.when(home, side("home", "home_team_win_prob")).otherwise(side("away", "home_team_lose_prob"))
    return predictions.select("game_id", chosen.alias("s")).select("game_id", "s.*").filter(F.col("price") > F.col("price_min") * edge)


# Labels of a game's text and the columns that follow them.
REPORT_LINES = (
    ("Round Name", "round_name"),
    ("Home Team Result", "home_team_result"),
    ("Home Team", "team_home"),
    ("Home Team Position", "position_home"),
    ("Home Team Head to Head Price", "odds_home"),
    ("Away Team", "team_away"),
    ("Away Team Position", "position_away"),
    ("Away Team Head to Head Price", "odds_away"),
)
PICK_LINES = (("Team", "team"), ("Price", "price"))


def report_texts(rows: DataFrame, group: list[str], lines: tuple[tuple[str, str], ...] = REPORT_LINES) -> DataFrame:
    """The columns of group, and report: a block of labelled lines for each row, in order of game_id.

    Nulls are shown as `None`, doubles with two digits. A group becomes one text, so it should be
    small, such as a competition's round.
    """
    kinds = dict(rows.dtypes)
    shown = lambda c: F.format_string("%.2f", c) if kinds[c] == "double" else F.col(c).cast("string")
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.when(F.col(c).isNull(), "None").otherwise(shown(c)))
    block = F.concat_ws("\n", *(line(label, c) for label, c in lines))
    ordered = F.array_sort(F.collect_list(F.struct("game_id", block.alias("block"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("report"))
