"""Standings kept up to date from a stream of finished games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.features import SEASON, sides
from ..sources.store import save_predictions


def live_standings(games: DataFrame) -> DataFrame:
    """Wins, losses, draws and points of each team and season, of a stream (or table) of games."""
    played = sides(games).filter("own is not null and other is not null")
    return played.groupBy(*SEASON, "team").agg(
        F.count_if(F.col("own") > F.col("other")).alias("wins"),
        F.count_if(F.col("own") < F.col("other")).alias("losses"),
        F.count_if(F.col("own") == F.col("other")).alias("draws"),
        F.sum("own").alias("points_for"),
        F.sum("other").alias("points_against"),
    )


def games_per_window(events: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Games that start in each window, with late ones taken in until the watermark passes."""
    stream = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stream.groupBy(F.window(time, length), "competition_id").agg(F.count(F.lit(1)).alias("games"))


def upsert_predictions(predictions: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """A writer that upserts each batch of predictions into the keyed table."""
    return predictions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: save_predictions(batch.sparkSession, table, batch))
