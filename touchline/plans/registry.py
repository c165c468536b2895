"""Names of the queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs, stages
from ..functions import columns as c
from ..operators import chained, cleaning, evaluation, features, forest, models, network, panel, prediction, ranks, ratings, standings
from ..operators.surrogate import Range
from ..session import release, settle, shared_folder, ship_package
from ..sources import keyed, store, xml
from . import oracle
from .fixtures import games, statistics, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL = oracle.ORACLE_SQL
LABELS = ["home", "away", "draw"]
STATS = ["flag_a", "flag_n", "flag_r"]
SWEPT = [float(k) for k in range(21, 71)]


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return rounded(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits (never -0.0), whole numbers as bigint, so sums in another order compare equal."""
    kinds = {"double": lambda n: (F.round(n, 6) + F.lit(0.0)).alias(n), "int": lambda n: F.col(n).cast("long").alias(n)}
    return df.select(*(kinds[kind](n) if kind in kinds else F.col(n) for n, kind in df.dtypes))


def with_positions(df: DataFrame) -> DataFrame:
    """A made-up place in the standings for each team: its number."""
    return df.withColumns({f"position_{side}_ladder": F.expr(f"CAST(substr(team_{side}, 2) AS bigint) + 1") for side in ("home", "away")})


def text_time(df: DataFrame) -> DataFrame:
    return df.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"))


# --- labels and easy columns


@query
def fixture_result_binomial(spark, sf):
    return games(spark, sf).select("game_id", c.binomial_result(F.col("score_home"), F.col("score_away")).alias("home_team_result"))


@query
def fixture_result_multiclass(spark, sf):
    return games(spark, sf).select("game_id", c.multiclass_result(F.col("score_home"), F.col("score_away")).alias("home_team_result"))


@query
def fixture_result_elo(spark, sf):
    home = c.rating_result(F.col("score_home"), F.col("score_away"))
    return games(spark, sf).select("game_id", home.alias("home_result"), (1 - home).alias("away_result"), F.abs(F.col("score_home") - F.col("score_away")).alias("margin"))


@query
def game_outcome(spark, sf):
    return games(spark, sf).select("game_id", evaluation.outcome_label(F.col("score_home"), F.col("score_away")).alias("outcome"))


@query
def easy_pickings(spark, sf):
    return features.with_easy_columns(with_positions(games(spark, sf)), closed_years=(1996, 1997)).select("game_id", "position_diff", "corona_season", "start_hour", "game_day")


# --- panel windows


@query
def prev_result(spark, sf):
    return features.previous_results(games(spark, sf))


@query
def turn_around(spark, sf):
    return features.turn_around(games(spark, sf))


@query
def matchup_form(spark, sf):
    return features.matchup_form(games(spark, sf))


@query
def season_stats(spark, sf):
    return features.season_stats(games(spark, sf))


@query
def form_stats(spark, sf):
    return features.form_stats(games(spark, sf))


@query
def state_of_origin(spark, sf):
    return features.with_small_rounds(games(spark, sf), most=9).select("game_id", "small_round", "after_small_round")


@query
def bye_flag(spark, sf):
    return features.bye_flags(games(spark, sf))


@query
def fixture_features(spark, sf):
    kept = ["game_id", "competition_id", "competition_year", "prev_result_home", "prev_result_away", "prev_result_diff", "turn_around_home", "turn_around_away", "turn_around_diff", "matchup_form", "small_round", "after_small_round"]
    found = cleaning.drop_first_season(features.fixture_features(games(spark, sf)))
    return found.select(*kept, c.binomial_result(F.col("score_home"), F.col("score_away")).alias("home_team_result"))


# --- standings and statistics


@query
def ladder_entering_round(spark, sf):
    return standings.entering_round(standings.ladder(games(spark, sf))).drop("recent_form")


@query
def ladder_rates(spark, sf):
    rated = standings.rates(standings.entering_round(standings.ladder(games(spark, sf))))
    return rated.select(*standings.ROUND, "team", *(n for n, total in standings.RATES.items() if total in standings.TOTALS))


@query
def form_string_score(spark, sf):
    return standings.with_form_score(standings.ladder(games(spark, sf))).select(*standings.ROUND, "team", "recent_form", "form_score")


@query
def home_away_ladder_join(spark, sf):
    all_games = games(spark, sf)
    before = standings.entering_round(standings.ladder(all_games)).drop("recent_form")
    joined = standings.join_both_sides(all_games, before, "ladder")
    return joined.select("game_id", *(f"{n}_{s}_ladder" for n in ("wins", "points_for") for s in ("home", "away")))


@query
def performance_pivot(spark, sf):
    return standings.pivot_statistics(statistics(spark, sf), ["season_id", "round_number", "team"], STATS)


@query
def performance_join(spark, sf):
    """Teams' statistics before the round, joined as the assembly does (teams play in one competition)."""
    wide = standings.pivot_statistics(statistics(spark, sf), ["season_id", "round_number", "team"], STATS)
    wide = wide.withColumnsRenamed({"season_id": "competition_year", "round_number": "round_id"}).withColumn("competition_id", F.lit("all"))
    all_games = games(spark, sf).select("game_id", F.lit("all").alias("competition_id"), "competition_year", "round_id", "team_home", "team_away")
    joined = standings.join_both_sides(all_games, standings.entering_round(wide), "performance")
    return joined.select("game_id", *(f"{s}_{side}_performance" for s in STATS for side in ("home", "away")))


# --- sources


def as_text(names: dict[str, str]) -> list:
    """Columns as attributes: attribute name to column."""
    return [F.col(c).cast("string").alias(f"_{name}") for name, c in names.items()]


def fixture_documents(spark, sf) -> DataFrame:
    """The games written as documents, and read again."""
    team = lambda side, home: F.struct(F.lit(home).alias("_isHomeTeam"), *as_text({"team": f"team_{side}", "teamFinalScore": f"score_{side}", "teamHeadToHeadOdds": f"odds_{side}"}))
    game = F.struct(
        *as_text({"gameId": "game_id", "gameStateName": "game_state_name", "startTime": "start_time", "venueName": "venue_name", "crowd": "crowd"}),
        F.struct(F.array(team("home", "true"), team("away", "false")).alias("team")).alias("teams"),
    )
    rounds = games(spark, sf).groupBy("competition_id", "competition_year", "round_id", "round_name").agg(F.collect_list(game).alias("gameFixture"))
    document = F.struct(*as_text({"roundId": "round_id", "roundName": "round_name"}), "gameFixture")
    texts = rounds.select("competition_id", "competition_year", xml.to_text(document, xml.FIXTURES_TAG).alias("document"))
    return xml.parse(texts, "document", xml.FIXTURES_TAG, xml.FIXTURES_SCHEMA)


def ladder_documents(spark, sf) -> DataFrame:
    place = F.struct(*as_text({"teamName": "team", "wins": "wins", "draws": "draws", "losses": "losses", "pointsFor": "points_for", "pointsAgainst": "points_against", "recentForm": "recent_form"}))
    rounds = standings.ladder(games(spark, sf)).groupBy(*standings.ROUND).agg(F.collect_list(place).alias("ladderposition"))
    texts = rounds.select("competition_id", "competition_year", F.col("round_id").alias("document_round"), xml.to_text(F.struct("ladderposition"), xml.LADDER_TAG).alias("document"))
    return xml.parse(texts, "document", xml.LADDER_TAG, xml.LADDER_SCHEMA)


@query
def xml_fixtures_roundtrip(spark, sf):
    found = xml.panel_games(xml.games_from_sides(xml.fixture_sides(fixture_documents(spark, sf))))
    return text_time(found).select(
        "competition_id", "competition_year", "round_id", "round_name", "game_id", "game_state_name", "start_time", "venue_name", "crowd",
        "team_home", "team_away", "score_home", "score_away", "odds_home", "odds_away",
    )


@query
def xml_ladder(spark, sf):
    return xml.ladder_rows(ladder_documents(spark, sf)).select(*standings.ROUND, "team", *standings.TOTALS)


@query
def xml_performance(spark, sf):
    entry = F.struct(*as_text({"TeamName": "team", "Value": "value"}))
    boards = statistics(spark, sf).groupBy("season_id", "round_number", "stat_name").agg(F.collect_list(entry).alias("leaderboardEntry"))
    stat = F.struct(*as_text({"ID": "stat_name", "statName": "stat_name"}), "leaderboardEntry")
    rounds = boards.groupBy("season_id", "round_number").agg(F.collect_list(stat).alias("leaderboardStat"))
    document = F.struct(*as_text({"seasonId": "season_id", "roundNumber": "round_number"}), "leaderboardStat")
    texts = rounds.select(xml.to_text(document, xml.STATISTICS_TAG).alias("document"))
    return xml.statistic_rows(xml.parse(texts, "document", xml.STATISTICS_TAG, xml.STATISTICS_SCHEMA)).select("season_id", "round_number", "stat_name", F.col("team_name").alias("team"), "value")


def team_statistics(spark, sf, teams: DataFrame) -> DataFrame:
    """The statistics of teams (a column team) by season, round and team."""
    # statistics of others would go in a later join; without them there is less to add up and to pivot
    known = statistics(spark, sf).join(teams.select("team").distinct(), "team", "left_semi")
    wide = standings.pivot_statistics(known, ["season_id", "round_number", "team"], STATS)
    return wide.withColumnsRenamed({"season_id": "competition_year", "round_number": "round_id"})


def competition_statistics(spark, sf) -> DataFrame:
    """The statistics as those of every competition's team of that name."""
    teams = games(spark, sf).select("competition_id", F.col("team_home").alias("team")).distinct()
    return teams.join(team_statistics(spark, sf, teams), "team")


@query
def assembled_games(spark, sf):
    found = xml.games_from_sides(xml.fixture_sides(fixture_documents(spark, sf)))
    joined = standings.assemble(found, xml.ladder_rows(ladder_documents(spark, sf)), competition_statistics(spark, sf))
    ladder = [f"{n}_{side}_ladder" for n in ("wins", "recent_form", "win_rate", "avg_points_for") for side in ("home", "away")]
    return joined.select("game_id", *ladder, *(f"{s}_{side}_performance" for s in STATS for side in ("home", "away")))


@query
def stop_at_gap(spark, sf):
    rounds = games(spark, sf).filter("NOT (competition_year = 1996 AND round_id = 4) AND NOT (competition_year = 1998 AND round_id = 1)")
    return xml.until_gap(rounds.select("competition_year", "round_id").distinct(), ["competition_year"])


@query
def schema_union(spark, sf):
    """All games twice, with different columns."""
    return xml.union_all([games(spark, sf).select("game_id", "team_home"), games(spark, sf).select("team_away", "game_id")])


# --- cleaning and splits


@query
def fct_lump_max(spark, sf):
    return cleaning.lump_levels(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 40, "max")


@query
def fct_lump_min(spark, sf):
    return cleaning.lump_levels(games(spark, sf).select("game_id", "venue_name"), "venue_name", 42, "min")


@query
def null_fill_by_type(spark, sf):
    return cleaning.fill_nulls(games(spark, sf).select("game_id", "competition_year", "round_name", "score_home", "score_away", "odds_home", "crowd"))


@query
def training_split(spark, sf):
    return cleaning.training_games(cleaning.drop_first_season(games(spark, sf)), use_odds=True).select("game_id", "competition_year", "odds_home")


@query
def inference_split(spark, sf):
    return cleaning.inference_games(games(spark, sf)).select("game_id", "competition_year", "round_id")


@query
def drop_first_season(spark, sf):
    return cleaning.drop_first_season(games(spark, sf)).groupBy("competition_id", "competition_year").agg(F.count(F.lit(1)).alias("games"))


@query
def level_vocabulary(spark, sf):
    return cleaning.known_levels(games(spark, sf), "team_home", ("T3", "Newcomers"))


@query
def predictor_filter(spark, sf):
    """The assembled predictors that remain without those of statistics, and the share of games that know each."""
    all_games = games(spark, sf)
    found = standings.assemble(all_games, standings.ladder(all_games), competition_statistics(spark, sf))
    kept = models.filter_predictors(found.columns[len(all_games.columns) :])
    return evaluation.present_shares(found, kept).withColumnsRenamed({"column": "predictor", "share": "present"})


# --- ratings


@query
def margin_outcome(spark, sf):
    return games(spark, sf).select("game_id", c.margin_outcome(F.col("score_home") - F.col("score_away"), -20.0, 20.0).alias("w"))


@query
def elo_ratings(spark, sf):
    return ratings.rate_games(games(spark, sf)).select("competition_id", "game_id", "elo_home", "elo_away", "elo_home_prob")


@query
def elo_draw_rates(spark, sf):
    return ratings.with_draws(settle(ratings.rate_games(games(spark, sf)))).select("game_id", "elo_diff", "draw_rate", "home_prob", "away_prob", "elo_prob_diff")


@query
def elo_k_sweep(spark, sf):
    return ratings.sweep_k(games(spark, sf), SWEPT)


@query
def elo_forest_kappa(spark, sf):
    return ratings.forest_kappa(games(spark, sf), SWEPT, trees=20)


# --- prediction, store, report


def predicted(spark, sf) -> DataFrame:
    all_games = games(spark, sf)
    ahead = prediction.expected_scores(cleaning.training_games(all_games), all_games.filter(F.col("game_state_name") == "Pre Game"))
    return prediction.prediction_records(ahead)


def predicted_games(spark, sf) -> DataFrame:
    found = predicted(spark, sf).join(with_positions(games(spark, sf)), "game_id")
    return found.withColumnsRenamed({"position_home_ladder": "position_home", "position_away_ladder": "position_away"})


@query
def poisson_outcome(spark, sf):
    return predicted(spark, sf).select("game_id", "home_score_avg", "away_score_avg", "home_team_win_prob", "home_team_lose_prob", "draw_prob")


@query
def bayes_evidence(spark, sf):
    return predicted(spark, sf).select("game_id", "evidence_strength", F.round(F.least("bayes_factor", F.lit(1e9)), 4).alias("bayes_factor"))


@query
def modal_scoreline(spark, sf):
    return predicted(spark, sf).select("game_id", "predicted_home_score", "predicted_away_score", "predicted_margin")


@query
def prediction_record(spark, sf):
    return predicted(spark, sf).drop("bayes_factor")


@query
def predictions_upsert(spark, sf):
    """Stored: all predictions but those of the last round ahead. New: all but those of the first, each
    twice, of which the second revision counts."""
    found = settle(predicted(spark, sf).select(*store.PREDICTION_COLUMNS).join(games(spark, sf).select("game_id", "round_id"), "game_id"))
    first, last = found.select(F.min("round_id")).scalar(), found.select(F.max("round_id")).scalar()
    existing = found.filter(F.col("round_id") < last).select(*store.PREDICTION_COLUMNS)
    revised = found.filter(F.col("round_id") > first).withColumn("revision", F.explode(F.array(F.lit(2), F.lit(1))))
    new = revised.withColumn("home_team_win_prob", F.col("home_team_win_prob") * F.col("revision") / 4).select(*store.PREDICTION_COLUMNS, "revision")
    return store.upsert(existing, new, order="revision")


@query
def predictions_keyed(spark, sf):
    """As predictions_upsert, through a keyed table of which the second batch rewrites the buckets that it touches."""
    found = settle(predicted(spark, sf).select(*store.PREDICTION_COLUMNS).join(games(spark, sf).select("game_id", "round_id"), "game_id"))
    first, last = found.select(F.min("round_id")).scalar(), found.select(F.max("round_id")).scalar()
    existing = found.filter(F.col("round_id") < last).select(*store.PREDICTION_COLUMNS)
    held = keyed.KeyedTable(spark, f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}", existing.schema, buckets=16)
    held.upsert(existing)
    revised = found.filter(F.col("round_id") > first).withColumn("revision", F.explode(F.array(F.lit(2), F.lit(1))))
    held.upsert(revised.withColumn("home_team_win_prob", F.col("home_team_win_prob") * F.col("revision") / 4), order="revision")
    return held.read()


@query
def stage_report(spark, sf):
    """Rows of each stage from games to those that models learn from, as the stage runner counted them."""
    steps = [
        ("games", lambda spark, _: games(spark, sf)),
        ("features", lambda _, df: features.fixture_features(df)),
        ("settled", lambda _, df: cleaning.drop_first_season(df)),
        ("training", lambda _, df: cleaning.training_games(df)),
    ]
    folder = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    stages.run_stages(spark, steps, folder)
    return stages.report(spark, folder).select("stage", "status", "rows")


@query
def prediction_report(spark, sf):
    statement = """
        WITH next_round AS (SELECT min(round_id) AS round_id FROM {fixtures} WHERE game_state_name = 'Pre Game')
        SELECT p.game_id, p.home_team_result, g.team_home, g.position_home_ladder AS position_home, g.odds_home,
          g.team_away, g.position_away_ladder AS position_away, g.odds_away,
          p.home_team_win_prob, p.home_team_lose_prob, g.round_id, g.competition_year, g.round_name
        FROM {predictions} p LEFT JOIN {fixtures} g ON p.game_id = g.game_id
        WHERE g.game_state_name = 'Pre Game' AND g.round_id = (SELECT round_id FROM next_round)"""
    return spark.sql(statement, predictions=predicted(spark, sf), fixtures=with_positions(games(spark, sf)))


@query
def value_picks(spark, sf):
    return prediction.value_picks(predicted_games(spark, sf))


@query
def report_text(spark, sf):
    return prediction.report_texts(predicted_games(spark, sf), standings.ROUND)


@query
def pick_text(spark, sf):
    picks = prediction.value_picks(predicted_games(spark, sf)).join(games(spark, sf).select("game_id", "competition_id"), "game_id")
    return prediction.report_texts(picks, ["competition_id"], prediction.PICK_LINES)


# --- evaluation


def judged(spark, sf) -> DataFrame:
    """Played games with the outcome, and the outcome that mean scores foretell."""
    all_games = cleaning.training_games(games(spark, sf))
    found = prediction.expected_scores(all_games, all_games)
    return found.select(
        "*",
        evaluation.outcome_label(F.col("score_home"), F.col("score_away")).alias("actual"),
        evaluation.outcome_label(F.floor("home_score_avg"), F.floor("away_score_avg")).alias("foretold"),
    )


@query
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(judged(spark, sf), "actual", "foretold", LABELS)


@query
def classification_report(spark, sf):
    return evaluation.classification_report(judged(spark, sf), "actual", "foretold", LABELS)


@query
def accuracy(spark, sf):
    return evaluation.accuracy(judged(spark, sf), "actual", "foretold")


@query
def score_source_metrics(spark, sf):
    """Errors of both sources of scores: the models' means, and the likeliest scores."""
    found = judged(spark, sf).withColumns({f"{side}_mode": F.floor(f"{side}_score_avg") for side in ("home", "away")})
    pairs = {f"{source}_{side}": (f"score_{side}", f"{side}_{column}") for source, column in (("mean", "score_avg"), ("mode", "mode")) for side in ("home", "away")}
    return evaluation.regression_metrics(found, pairs)


@query
def regression_metrics(spark, sf):
    return evaluation.regression_metrics(judged(spark, sf), {"home": ("score_home", "home_score_avg"), "away": ("score_away", "away_score_avg")})


@query
def roc_points(spark, sf):
    return evaluation.roc_points(judged(spark, sf), "actual", "foretold", LABELS)


def judged_chances(spark, sf) -> DataFrame:
    """Outcomes of played games and their probabilities ph, pa, pd."""
    found = judged(spark, sf).withColumn("p", c.outcome_probabilities(F.col("home_score_avg"), F.col("away_score_avg")))
    return found.select("actual", F.col("p.home").alias("ph"), F.col("p.away").alias("pa"), F.col("p.draw").alias("pd"))


@query
def kappa_cutoffs(spark, sf):
    return evaluation.kappa_by_cutoff(judged_chances(spark, sf), F.col("actual") == "home", F.col("ph"), 20)


def score_curve(spark, sf) -> DataFrame:
    return ranks.roc_curve(judged_chances(spark, sf), F.col("actual") == "home", F.round("ph", 6))


@query
def score_roc_curve(spark, sf):
    """The curve of the home side's probability as a score, all its cutoffs."""
    return score_curve(spark, sf)


@query
def score_auc(spark, sf):
    return ranks.area(score_curve(spark, sf))


@query
def score_best_cutoff(spark, sf):
    """The cutoff of most agreement beyond chance, of all that the scores allow."""
    return ranks.largest_kappa(score_curve(spark, sf)).select("cutoff", "tp", "fp", "kappa")


@query
def log_loss(spark, sf):
    return evaluation.log_loss(judged_chances(spark, sf), "actual", {"home": "ph", "away": "pa", "draw": "pd"})


@query
def crosstab_nulls(spark, sf):
    df = games(spark, sf).select("round_name", F.when(F.col("crowd").isNotNull(), "known").alias("crowd"))
    return evaluation.cross_table(df, "round_name", "crowd", ["known", "missing"])


@query
def profile_summary(spark, sf):
    return evaluation.profile(games(spark, sf), ["score_home", "score_away", "odds_home", "odds_away", "crowd"])


@query
def margin_histogram(spark, sf):
    return evaluation.histogram(games(spark, sf).withColumn("margin", F.col("score_home") - F.col("score_away")), "margin", -60.0, 60.0, 12)


def with_errors(spark, sf) -> DataFrame:
    return judged(spark, sf).withColumns({f"{side}_error": F.round(F.col(f"score_{side}") - F.col(f"{side}_score_avg"), 6) for side in ("home", "away")})


@query
def error_density(spark, sf):
    """The smoothed curve of both sides' score errors."""
    found = with_errors(spark, sf)
    curves = [evaluation.density(found, f"{side}_error", points=100, bins=1000).withColumn("side", F.lit(side)) for side in ("home", "away")]
    return curves[0].unionByName(curves[1])


@query
def score_scatter(spark, sf):
    """Actual by expected scores of both sides, games counted in squares of two points."""
    found = judged(spark, sf)
    squares = [evaluation.pair_counts(found, f"score_{side}", f"{side}_score_avg", 2.0).withColumn("side", F.lit(side)) for side in ("home", "away")]
    return squares[0].unionByName(squares[1])


@query
def profile_sketches(spark, sf):
    """Every column of games by sketches, in one pass."""
    found = games(spark, sf)
    return evaluation.profile_sketches(found, [c for c in found.columns if c != "start_time"])


@query
def crowd_imputation(spark, sf):
    return models.impute_crowd(games(spark, sf), (1996, 1997))


# --- models: learned, so no SQL says the same


def prepared(spark, sf) -> tuple[DataFrame, list[str]]:
    """Games with features, standings and statistics, as jobs.prepare gives them, and the predictors without statistics."""
    all_games = games(spark, sf)
    found = panel.assembled(all_games, team_statistics(spark, sf, all_games.select(F.col("team_home").alias("team"))))
    return found, models.filter_predictors(jobs.predictors_of(found))


def training_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = features.with_matchup_form(features.with_previous_results(games(spark, sf)))
    return cleaning.training_games(rows), rows.filter(F.col("game_state_name") == "Pre Game")


@query
def train_score_models(spark, sf):
    """Both jobs in turn: models of both sides' scores trained, saved, read again and applied."""
    found, predictors = prepared(spark, sf)
    rows, folder = settle(found), f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    jobs.train(rows, predictors, folder, draws=2, folds=3)
    return jobs.predict(rows, predictors, folder)


@query
def search_candidates(spark, sf):
    """Random draws of settings of both kinds of model, by their deviance."""
    found, predictors = prepared(spark, sf)
    train = jobs.played_rows(found, predictors)
    try:
        return models.candidates(train, predictors, "score_home", draws=2, boosted_draws=1, folds=2)
    finally:
        release(train)


#: Ranges that train_boosted_models searches: fewer and smaller trees than models.BOOSTED_SPACE, as a pass over the rows is a job.
SMALL_SPACE = models.BOOSTED_SPACE | {"trees": Range(4, 12, whole=True), "max_depth": Range(2, 3, whole=True), "learning_rate": Range(0.01, 0.3, log=True)}


@query
def train_boosted_models(spark, sf):
    """Both jobs with Poisson boosting: searched, fitted, saved, read again and applied to the games ahead."""
    found, predictors = prepared(spark, sf)
    rows, folder = settle(found), f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    jobs.train_boosted(rows, predictors, folder, rounds=1, batch=3, folds=3, space=SMALL_SPACE)
    return jobs.predict(rows, predictors, folder)


@query
def surrogate_trials(spark, sf):
    """Settings of Poisson boosting in the order in which a surrogate search tried them: a hundred of the whole space, by three folds."""
    found, predictors = prepared(spark, sf)
    train = jobs.played_rows(found, predictors)
    try:
        return models.boosted_trials(train, predictors, "score_home", rounds=10, batch=10, folds=3, space=models.BOOSTED_SPACE)
    finally:
        release(train)


@query
def feature_importance_top20(spark, sf):
    found, predictors = prepared(spark, sf)
    train = jobs.played_rows(found, predictors)
    try:
        model, _ = models.train_score_model(train, predictors, "score_home", draws=1, folds=2)
        return models.feature_importances(model, train.fillna(0))
    finally:
        release(train)


#: What research forests see.
RESEARCH = ["prev_result_diff", "matchup_form", "odds_home", "odds_away", "round_id", "team_home"]


def research_rows(spark, sf) -> DataFrame:
    train, _ = training_rows(spark, sf)
    return settle(train.select("game_id", *RESEARCH, (F.col("score_home") >= F.col("score_away")).cast("int").alias("won")))


@query
def forest_out_of_bag_votes(spark, sf):
    """Votes for a home win of the trees that didn't see the game."""
    rows = research_rows(spark, sf)
    return forest.fit(rows, RESEARCH, "won", "game_id", forest.Forest(trees=100, max_depth=8)).votes(rows, out_of_bag=True).select("game_id", "won", "votes", "trees")


@query
def forest_cutoff(spark, sf):
    """The share of out-of-bag votes from which calling a home win agrees most with results, and the curve's area."""
    votes = settle(forest_out_of_bag_votes(spark, sf))
    curve = settle(ranks.roc_curve(votes, F.col("won") == 1, F.col("votes")))
    return ranks.largest_kappa(curve).select("cutoff", "tp", "fp", "kappa").withColumn("auc", ranks.area(curve).select("auc").scalar())


@query
def forest_repeated_cv(spark, sf):
    """Metrics of forests by predictors tried a split, repeat and fold."""
    return forest.repeated_cv(research_rows(spark, sf), RESEARCH, "won", "game_id", tried=list(range(1, len(RESEARCH) + 1)), folds=5, repeats=2, forest=forest.Forest(trees=20, max_depth=6))


#: Seasons without crowds.
CLOSED = (1996, 1997)


@query
def crowd_forest(spark, sf):
    """Missing crowds as a forest expects them, of closed seasons 0."""
    rows = with_positions(games(spark, sf))
    return models.impute_crowd_by_forest(rows, CLOSED, ["team_home", "team_away", "position_home_ladder", "round_name", "venue_name", "competition_year"], trees=20)


def completed_games(spark, sf) -> DataFrame:
    rows = cleaning.training_games(games(spark, sf))
    return chained.complete(rows, "game_id", ["crowd", "odds_home", "odds_away", "score_home", "score_away"], ["team_home", "venue_name"], tables=2, sweeps=2)


@query
def crowd_chained(spark, sf):
    """Played games' missing crowds filled by chained equations, in two completed tables."""
    return completed_games(spark, sf)


@query
def crowd_pooled(spark, sf):
    """Mean crowd and price over the completed tables, with what their gaps add to the variance."""
    return chained.pooled_means(completed_games(spark, sf), ["crowd", "odds_home"])


@query
def network_scores(spark, sf):
    """Expected scores of games ahead by a Poisson network, the better of two sizes by its folds."""
    train, ahead = training_rows(spark, sf)
    sizes = [network.Network(hidden=h, steps=30) for h in (4, 8)]
    numbers = ["prev_result_diff", "matchup_form", "odds_home", "odds_away", "round_id"]
    for side in ("home", "away"):
        fitted, _ = network.search(train, numbers, ["team_home", "team_away"], f"score_{side}", sizes, folds=3)
        ahead = fitted.predict(ahead, f"{side}_score_avg")
    return ahead.select("game_id", "home_score_avg", "away_score_avg")


@query
def predictor_elimination(spark, sf):
    """Cross-validated deviance by how many predictors are left."""
    train, _ = training_rows(spark, sf)
    tried = models.eliminate_by_folds(train, RESEARCH, "score_home", folds=3)
    return spark.createDataFrame([(len(kept), ", ".join(kept), d) for d, kept in tried], "size int, predictors string, deviance double")


@query
def home_ground_advantage(spark, sf):
    rows = features.with_easy_columns(games(spark, sf))
    found = models.home_ground_estimates(rows, ["venue_name", "team_home", "team_away", "start_hour", "game_day", "round_id", "competition_year"], trees=20)
    return found.select("game_id", "home_ground_advantage")


@query
def research_logistic(spark, sf):
    train, _ = training_rows(spark, sf)
    return models.logistic_coefficients(train.withColumn("won", (F.col("score_home") > F.col("score_away")).cast("double")), "won ~ prev_result_diff + matchup_form + odds_away")


@query
def research_linear(spark, sf):
    train, _ = training_rows(spark, sf)
    return models.linear_coefficients(train.withColumn("margin", F.col("score_home") - F.col("score_away")), "margin ~ prev_result_diff * matchup_form")


@query
def research_forest(spark, sf):
    train, _ = training_rows(spark, sf)
    return models.forest_importances(train.withColumn("result", c.binomial_result(F.col("score_home"), F.col("score_away"))), "result ~ prev_result_diff + matchup_form + odds_away + round_id")
