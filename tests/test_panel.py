"""Assembly in one go: the same rows as by joins, and games dealt out once."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from touchline import jobs, session
from touchline.operators import panel, standings
from touchline.plans import registry


def odd_games(spark, n=300):
    """Games of two competitions: Z never plays at home in c2, some scores and times are not known."""
    rng, rows = random.Random(5), []
    for i in range(n):
        competition = rng.choice(["c1", "c2"])
        home = rng.choice(["A", "B", "Z"] if competition == "c1" else ["A", "B"])
        away = rng.choice([t for t in "ABZ" if t != home])
        year, month = rng.randint(2020, 2022), rng.randint(1, 6)
        start = datetime.datetime(year, month, rng.randint(1, 28), rng.randint(0, 23)) if i % 19 else None
        scores = [float(rng.randint(0, 3)) if rng.random() < 0.8 else None for _ in range(2)]
        rows.append((i, competition, year, month, rng.choice([f"Round {month}", "Final", None]), start, home, away, "Final" if None not in scores else "Pre Game", *scores))
    schema = "game_id long, competition_id string, competition_year long, round_id long, round_name string, start_time timestamp_ntz, team_home string, team_away string, game_state_name string, score_home double, score_away double"
    return spark.createDataFrame(rows, schema)


def rows_of(df, columns):
    shown = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(map(shown, r)) for r in df.select("game_id", *columns).collect())


def test_one_pass_gives_the_rows_of_the_joins(spark):
    games = odd_games(spark)
    wide = spark.createDataFrame([(t, y, m, float(y + m + ord(t))) for t in "ABZ" for y in (2020, 2021, 2022) for m in (1, 2, 4, 5)], "team string, competition_year long, round_id long, stat double")
    teams = games.select("competition_id", F.col("team_home").alias("team")).distinct()
    want, predictors = jobs.prepare(games, standings.ladder(games), teams.join(wide, "team"))
    found = panel.assembled(games, wide)
    assert jobs.predictors_of(found) == predictors
    columns = [c for c in found.columns if c != "game_id"]
    assert rows_of(found, columns) == rows_of(want, columns)
    z_away = found.filter("competition_id = 'c2' and team_away = 'Z'")
    assert z_away.count() and not z_away.filter("stat_away_performance is not null").count()


def test_games_are_dealt_out_once(spark):
    """Windows, standings and statistics each dealt games out again, and what they shuffled lay on disk together."""
    sf = "/root/testdata/sf0.001"
    found, _ = registry.prepared(spark, sf)
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "game_id" in line]
    assert not wide and text.count("REPARTITION_BY_COL") == 1


def test_kept_tables_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, inside = spark.conf.get(name, None), []
    with session.shuffles_freed(spark):
        inside.append(spark.conf.get(name))
    assert inside == ["true"] and spark.conf.get(name, None) == before
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    registered = lambda: held.shuffleStatuses().size()
    count = registered()
    kept = session.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and registered() <= count + 1  # the count's own
    session.release(kept)


@pytest.mark.parametrize("name", ["search_candidates", "feature_importance_top20"])
def test_finished_searches_leave_nothing_in_the_shared_folder(spark, name):
    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert set(os.listdir(folder)) == before
