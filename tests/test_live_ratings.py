"""Ratings from a stream against those of the whole table."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from touchline.operators import ratings
from touchline.plans.fixtures import games
from touchline.streaming.ratings import RATED, live_ratings

SF = "/root/testdata/sf0.001"
END = "2100-01-01"


def run(spark, tmp_path, batches, late, advantages=None, restart_after=None):
    """The stream's rows when each of batches is a file of its own, one a micro-batch."""
    source, checkpoint, out = (str(tmp_path / n) for n in ("source", "checkpoint", "out"))
    schema = batches[0].schema
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        if n == restart_after or n == len(batches) - 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            job = live_ratings(stream, late, advantages).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
            assert job.awaitTermination(240) and job.exception() is None
    return spark.read.schema(RATED).parquet(out)


def last_whistle(df):
    """A game of a far year, which moves the watermark past all others."""
    return df.limit(1).withColumns({"start_time": F.lit(END).cast(df.schema["start_time"].dataType), "competition_id": F.lit("end"), "game_id": F.lit(-1).cast("long")})


def as_dict(df):
    return {r["game_id"]: (r["competition_id"], r["w"], *(round(r[c], 9) for c in ("elo_home", "elo_away", "elo_home_prob"))) for r in df.collect()}


@pytest.mark.parametrize("restart_after", [None, 1])
def test_shuffled_micro_batches_give_the_whole_tables_ratings(spark, tmp_path, restart_after):
    whole = games(spark, SF)
    advantages = whole.groupBy("competition_id").agg(F.coalesce(F.avg(F.col("score_home") - F.col("score_away")), F.lit(0.0)).alias("advantage"))
    rows = whole.orderBy("game_id").collect()
    random.Random(4).shuffle(rows)
    size = len(rows) // 4 + 1
    batches = [spark.createDataFrame(rows[i : i + size], whole.schema) for i in range(0, len(rows), size)] + [last_whistle(whole)]
    got = run(spark, tmp_path, batches, "5000 days", advantages, restart_after)
    want = {g: (c, w, *(round(v, 9) for v in rest)) for g, (c, w, *rest) in as_dict(ratings.rate_games(whole)).items()}
    assert got.count() == len(rows) and as_dict(got) == want


def test_games_are_rated_when_the_watermark_passes_them(spark, tmp_path):
    whole = games(spark, SF)
    first = whole.filter("game_state_name = 'Final'").orderBy("start_time").first()
    late_day = first["start_time"] + timedelta(days=400)
    row = lambda **changed: tuple((first.asDict() | changed).values())
    made = lambda *some: spark.createDataFrame(list(some), whole.schema)
    batches = [
        made(row(game_id=1), row(game_id=1), row(game_id=2, competition_id=None)),
        made(row(game_id=3, start_time=late_day)),
        made(row(game_id=4, start_time=late_day + timedelta(days=1), score_home=None)),
    ]
    got = as_dict(run(spark, tmp_path, batches, "10 days"))
    assert set(got) == {1} and got[1][2:4] == (1500.0, 1500.0)
