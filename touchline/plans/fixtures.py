"""A deterministic table of games over the driver's `orders`, and long statistics over `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of 17 teams in each competition (a hundred customers each), seasons of twelve rounds.
    Open orders are games yet to be played."""
    ahead = F.col("o_orderstatus") == "O"
    score = lambda e: F.when(~ahead, F.expr(f"CAST(floor({e}) AS bigint) % 61").cast("double"))
    month = F.month("o_orderdate").cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.expr("concat('C', o_custkey div 100)").alias("competition_id"),
        F.year("o_orderdate").cast("long").alias("competition_year"),
        month.alias("round_id"),
        F.when(month == 12, "Final").otherwise(F.concat(F.lit("Round "), month)).alias("round_name"),
        F.col("o_orderdate").alias("start_time"),
        F.expr("concat('T', o_custkey % 17)").alias("team_home"),
        F.expr("concat('T', (o_custkey + 1 + o_orderkey % 16) % 17)").alias("team_away"),
        F.when(ahead, "Pre Game").otherwise("Final").alias("game_state_name"),
        score("o_totalprice").alias("score_home"),
        score("o_totalprice / 100").alias("score_away"),
        F.expr("CASE WHEN o_orderkey % 23 <> 0 THEN 1 + (o_orderkey % 40) / 10.0D END").alias("odds_home"),
        F.expr("1 + (o_orderkey * 7 % 40) / 10.0D").alias("odds_away"),
        F.expr("concat('Venue ', o_custkey % 53)").alias("venue_name"),
        F.expr("CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 50000 AS double) END").alias("crowd"),
    )


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statistics: for suppliers as teams, by year and month, a value for each return flag."""
    keys = [F.expr("concat('T', l_suppkey)").alias("team"), F.year("l_shipdate").cast("long").alias("season_id"), F.month("l_shipdate").cast("long").alias("round_number"), F.concat(F.lit("flag_"), F.lower("l_returnflag")).alias("stat_name")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("value"))


#: The same in DuckDB SQL, as common table expressions.
GAMES_SQL = """games AS (
  SELECT o_orderkey AS game_id, 'C' || (o_custkey // 100) AS competition_id,
    CAST(year(o_orderdate) AS BIGINT) AS competition_year, CAST(month(o_orderdate) AS BIGINT) AS round_id,
    CASE WHEN month(o_orderdate) = 12 THEN 'Final' ELSE 'Round ' || month(o_orderdate) END AS round_name,
    o_orderdate AS start_time, 'T' || (o_custkey % 17) AS team_home, 'T' || ((o_custkey + 1 + o_orderkey % 16) % 17) AS team_away,
    CASE WHEN o_orderstatus = 'O' THEN 'Pre Game' ELSE 'Final' END AS game_state_name,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 61 AS DOUBLE) END AS score_home,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(floor(o_totalprice / 100) AS BIGINT) % 61 AS DOUBLE) END AS score_away,
    CASE WHEN o_orderkey % 23 <> 0 THEN 1 + (o_orderkey % 40) / CAST(10 AS DOUBLE) END AS odds_home,
    1 + (o_orderkey * 7 % 40) / CAST(10 AS DOUBLE) AS odds_away, 'Venue ' || (o_custkey % 53) AS venue_name,
    CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 50000 AS DOUBLE) END AS crowd
  FROM orders)"""
STATISTICS_SQL = """statistics AS (
  SELECT 'T' || l_suppkey AS team, CAST(year(l_shipdate) AS BIGINT) AS season_id, CAST(month(l_shipdate) AS BIGINT) AS round_number,
    'flag_' || lower(l_returnflag) AS stat_name, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL)"""
SIDES_SQL = """sides AS (
  SELECT game_id, competition_id, competition_year, round_id, start_time, team_home AS team, TRUE AS is_home, score_home AS own, score_away AS other FROM games
  UNION ALL
  SELECT game_id, competition_id, competition_year, round_id, start_time, team_away, FALSE, score_away, score_home FROM games)"""
