"""XML documents of fixtures, standings and statistics, read with declared schemas.

The season, and for standings and statistics the round, are not in the documents but in their paths
(.../<season>.xml, .../<season>/<round>.xml); readers take them from there. All attributes are text
at the source and are cast when rows are made of them; what can't be cast is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import clean_names

FIXTURES_TAG, LADDER_TAG, STATISTICS_TAG = "roundFixtures", "ladder", "leaderboard"

# Attributes of the documents.
GAME_ATTRIBUTES = "gameId gameNumber gameStateName startTime startTimeUTC venueName city crowd broadcastChannel broadcastChannel2 broadcastChannel3".split()
TEAM_ATTRIBUTES = "team teamFinalScore isHomeTeam teamHeadToHeadOdds teamLineOdds teamLineAmount".split()
LADDER_ATTRIBUTES = (
    "position teamName wins draws losses byes competitionPoints pointsFor pointsAgainst pointsDifference homeWins homeDraws homeLosses awayWins awayDraws awayLosses "
    "recentForm seasonForm triesFor triesConceded goalsFor goalsConceded fieldGoalsFor fieldGoalsConceded playersUsed averageWinningMargin averageLosingMargin closeGames "
    "dayRecord nightRecord currentStreak"
).split()
STATISTICS_ATTRIBUTES = "seasonId competitionId competitionName roundNumber".split()
ENTRY_ATTRIBUTES = "TeamID TeamName TeamAbbrev Value Rank Appearances".split()

#: Types of columns that are not text.
KINDS = {
    "game_id": "bigint", "game_number": "bigint", "round_id": "bigint", "start_time": "timestamp_ntz", "start_time_utc": "timestamp", "crowd": "double",
    "team_final_score": "double", "team_head_to_head_odds": "double", "team_line_odds": "double", "team_line_amount": "double", "value": "double", "rank": "int", "appearances": "int",
}
LADDER_TEXTS = ["team", "recent_form", "season_form", "day_record", "night_record", "current_streak"]
#: Names of the columns of games, as panel operators use them.
PANEL_NAMES = {f"{source}_{side}": f"{name}_{side}" for side in ("home", "away") for source, name in (("team_final_score", "score"), ("team_head_to_head_odds", "odds"), ("team_line_odds", "line_odds"), ("team_line_amount", "line_amount"))}


def _fields(names: list[str]) -> str:
    return ", ".join(f"_{n} string" for n in names)


FIXTURES_SCHEMA = f"_roundId string, _roundName string, gameFixture array<struct<{_fields(GAME_ATTRIBUTES)}, teams struct<team array<struct<{_fields(TEAM_ATTRIBUTES)}>>>>>"
LADDER_SCHEMA = f"ladderposition array<struct<{_fields(LADDER_ATTRIBUTES)}>>"
STATISTICS_SCHEMA = f"{_fields(STATISTICS_ATTRIBUTES)}, leaderboardStat array<struct<_ID string, _statName string, leaderboardEntry array<struct<{_fields(ENTRY_ATTRIBUTES)}>>>>"


def read_documents(spark: SparkSession, paths: str | list[str], tag: str, schema: str, competition: str = "1") -> DataFrame:
    """All documents under paths, one row for each `tag` element, with competition_id (as given),
    competition_year and document_round (null for documents of a whole season) from the path."""
    found = spark.read.format("xml").option("rowTag", tag).schema(schema).load(paths)
    part = lambda group: F.expr(f"try_cast(regexp_extract(_metadata.file_path, '/([0-9]{{4}})(?:/([0-9]{{1,3}}))?(?:[.]xml)?$', {group}) AS bigint)")
    return found.select("*", F.lit(competition).alias("competition_id"), part(1).alias("competition_year"), part(2).alias("document_round"))


def parse(texts: DataFrame, column: str, tag: str, schema: str) -> DataFrame:
    """Documents held as text in a column; the other columns stay beside what is read."""
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.from_xml(column, schema, {"rowTag": tag}).alias("__document")).select(*others, "__document.*")


def to_text(row: Column, tag: str) -> Column:
    """A struct as an XML element; fields that begin with _ become attributes."""
    return F.to_xml(row, {"rowTag": tag, "declaration": ""})


def _typed(source: str, attributes: list[str], kinds: dict[str, str], names: dict[str, str] | None = None) -> list[Column]:
    """The attributes of a struct column as columns in snake case, cast to their kinds."""
    snake = [(names or {}).get(a, n) for a, n in zip(attributes, clean_names(attributes))]
    return [(F.expr(f"try_cast({source}._{a} AS {kinds[n]})") if n in kinds else F.col(f"{source}._{a}")).alias(n) for a, n in zip(attributes, snake)]


def fixture_sides(documents: DataFrame) -> DataFrame:
    """One row for each game and team, with all attributes of the round, game and team; rounds without
    games give none. documents has competition_id and competition_year beside what is read."""
    keys = ["competition_id", "competition_year"]
    games = documents.select(*keys, F.expr("try_cast(_roundId AS bigint)").alias("round_id"), F.col("_roundName").alias("round_name"), F.explode("gameFixture").alias("g"))
    teams = games.select("*", F.explode("g.teams.team").alias("t"))
    own = [a for a in TEAM_ATTRIBUTES if a != "isHomeTeam"]
    return teams.select(
        *keys, "round_id", "round_name", *_typed("g", GAME_ATTRIBUTES, KINDS, {"broadcastChannel": "broadcast_channel1"}), *_typed("t", own, KINDS), (F.lower("t._isHomeTeam") == "true").alias("is_home_team")
    )


def games_from_sides(by_side: DataFrame) -> DataFrame:
    """Home and away halves of each game in one row, by what they say they are; games that lack one
    go. Columns of the halves end in _home and _away."""
    halves = [n for n in clean_names(TEAM_ATTRIBUTES) if n != "is_home_team"]
    keys = [c for c in by_side.columns if c not in (*halves, "is_home_team")]
    pick = [F.any_value(F.when(F.col("is_home_team") == home, F.col(c)), ignoreNulls=True).alias(f"{c}_{side}") for c in halves for home, side in ((True, "home"), (False, "away"))]
    seen = [F.bool_or(F.col("is_home_team") == home).alias(f"__{home}") for home in (True, False)]
    # texts are gathered by sorting, which the first key alone decides where it tells games apart
    by_game = by_side.groupBy(*sorted(keys, key=lambda c: c != "game_id")).agg(*pick, *seen)
    return by_game.filter("__True AND __False").select(*keys, *(f"{c}_{side}" for c in halves for side in ("home", "away")))


def panel_games(games: DataFrame) -> DataFrame:
    """games under the names that panel operators use: score_home, odds_home and so on."""
    return games.withColumnsRenamed(PANEL_NAMES)


def ladder_rows(documents: DataFrame, last_round: int = 40) -> DataFrame:
    """One row for each team of the standings of each season and round, up to the first round without
    a document and last_round at most. documents has competition_id, competition_year and
    document_round beside what is read."""
    rows = documents.select("competition_id", "competition_year", F.col("document_round").alias("round_id"), F.explode("ladderposition").alias("l"))
    names = {"teamName": "team"}
    numbers = {n: "double" for a, n in zip(LADDER_ATTRIBUTES, clean_names(LADDER_ATTRIBUTES)) if names.get(a, n) not in LADDER_TEXTS}
    typed = rows.select("competition_id", "competition_year", "round_id", *_typed("l", LADDER_ATTRIBUTES, numbers, names))
    return until_gap(typed.filter(F.col("round_id") <= last_round), ["competition_id", "competition_year"])


def statistic_rows(documents: DataFrame) -> DataFrame:
    """Long form: one row for each statistic and team, with the attributes of the document, and
    competition_year and round_id of its path where documents has them."""
    outer = [F.col(f"_{a}").alias(n) for a, n in zip(STATISTICS_ATTRIBUTES, clean_names(STATISTICS_ATTRIBUTES))]
    placed = [F.col(c).alias(n) for c, n in (("competition_year", "competition_year"), ("document_round", "round_id")) if c in documents.columns]
    stats = documents.select(*outer, *placed, F.explode("leaderboardStat").alias("s"))
    entries = stats.select("*", F.col("s._ID").alias("stat_id"), F.col("s._statName").alias("stat_name"), F.explode("s.leaderboardEntry").alias("e"))
    return entries.drop("s").select("*", *_typed("e", ENTRY_ATTRIBUTES, KINDS)).drop("e")


def until_gap(rounds: DataFrame, keys: list[str], column: str = "round_id") -> DataFrame:
    """The rows of each group up to the first number that is missing, counted from 1."""
    order = W.partitionBy(*keys).orderBy(column)
    return rounds.withColumn("__rank", F.dense_rank().over(order)).filter(F.col(column) == F.col("__rank")).drop("__rank")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
