"""Cleaning: rare levels lumped together, nulls filled by type, seasons and states split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OTHER = "Other"


def lump_levels(df: DataFrame, column: str, n: int, ties: str = "max") -> DataFrame:
    """column with all but its n most frequent values as `Other`; null stays null.

    A value stays if its rank by frequency is at most n; values equally frequent all have the
    largest ("max") or smallest ("min") rank among them. The table of levels is small beside df.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    # levels by frequency: how many levels have each count
    steps = counts.groupBy("__n").agg(F.count(F.lit(1)).alias("__levels"))
    through = W.orderBy(F.desc("__n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = steps.withColumn("__last", F.sum("__levels").over(through)).withColumn("__first", F.col("__last") - F.col("__levels") + 1)
    kept = counts.join(ranks.filter(F.col("__last" if ties == "max" else "__first") <= n), "__n").select(column, F.lit(True).alias("__kept"))
    lumped = F.when(F.col(column).isNull() | F.col("__kept"), F.col(column)).otherwise(OTHER)
    return df.join(kept, column, "left").withColumn(column, lumped).select(*df.columns)


def known_levels(df: DataFrame, column: str, more: tuple[str, ...] = ()) -> DataFrame:
    """column, rows: its values and how often each comes, with those of `more` that never come (0 rows).
    An encoder fitted on the values alone would not know these."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    added = df.sparkSession.createDataFrame([(v, 0) for v in more], f"{column} string, rows long")
    return counts.unionByName(added).groupBy(column).agg(F.sum("rows").alias("rows"))


def fill_nulls(df: DataFrame, number: float = 0, text: str = "None") -> DataFrame:
    """Null numbers and texts replaced; other types as they are."""
    filled: list[Column] = []
    for name, kind in df.dtypes:
        value = number if kind in ("int", "bigint", "double", "float", "smallint") or kind.startswith("decimal") else text if kind == "string" else None
        filled.append(F.col(name) if value is None else F.coalesce(F.col(name), F.lit(value).cast(kind)).alias(name))
    return df.select(*filled)


def drop_first_season(games: DataFrame) -> DataFrame:
    """Games of all seasons but the earliest of each competition, which only feeds features."""
    first = games.groupBy("competition_id").agg(F.min("competition_year").alias("__first"))
    return games.join(first, "competition_id").filter(F.col("competition_year") != F.col("__first")).select(*games.columns)


def training_games(games: DataFrame, use_odds: bool = False) -> DataFrame:
    found = games.filter(F.col("game_state_name") == "Final")
    return found.filter(F.col("odds_home").isNotNull()) if use_odds else found


def inference_games(games: DataFrame, use_odds: bool = False) -> DataFrame:
    """Games yet to be played of the smallest such round number (of any season)."""
    ahead = games.filter(F.col("game_state_name") == "Pre Game")
    ahead = ahead.filter(F.col("odds_home").isNotNull()) if use_odds else ahead
    first = ahead.select(F.min("round_id")).scalar()
    return ahead.filter(F.col("round_id") == first)


def split_by_hash(df: DataFrame, key: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of percent per cent of the keys, and the others; the same in every run."""
    part = F.pmod(F.xxhash64(key), F.lit(100)) < percent
    return df.filter(part), df.filter(~part)
