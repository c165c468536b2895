"""Tables that outlive a run: overwritten, keyed and exported."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_COLUMNS = ["game_id", "home_team_result", "home_team_win_prob", "home_team_lose_prob"]


def latest(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the last by `order`, and of those that agree in it, or without an order, the
    one with the largest values, column by column."""
    whole = F.struct(*([order] if order else []), *(c for c in rows.columns if c not in (key, order)))
    return rows.groupBy(key).agg(F.max(whole).alias("__last")).select(*(c if c == key else F.col(f"__last.{c}").alias(c) for c in rows.columns))


def upsert(existing: DataFrame, new: DataFrame, key: str = "game_id", order: str | None = None) -> DataFrame:
    """existing with the rows of new, which replace those with the same key; of new rows with one key the
    last by `order` (see latest) counts."""
    last = latest(new, key, order)
    return existing.join(last.select(key), key, "left_anti").unionByName(last.select(*existing.columns))


def create_predictions(spark: SparkSession, table: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (game_id BIGINT, home_team_result STRING, home_team_win_prob DOUBLE, home_team_lose_prob DOUBLE) USING parquet")


def save_predictions(spark: SparkSession, table: str, new: DataFrame, order: str | None = None) -> None:
    """Upsert into the table. The result is written beside it and then takes its name, so the table is
    whole before and after; if a run ends in between, the older rows are left under <table>_before and
    the next run brings them back."""
    before = f"{table}_before"
    if spark.catalog.tableExists(before):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {before}")
        else:
            spark.sql(f"ALTER TABLE {before} RENAME TO {table}")
    create_predictions(spark, table)
    staged = f"{table}_{uuid.uuid4().hex[:8]}"
    columns = [*PREDICTION_COLUMNS, *([order] if order and order not in PREDICTION_COLUMNS else [])]
    upsert(spark.table(table), new.select(*columns), order=order).write.saveAsTable(staged)
    spark.sql(f"ALTER TABLE {table} RENAME TO {before}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    spark.sql(f"DROP TABLE {before}")


def read_sql(spark: SparkSession, path: str, views: dict[str, DataFrame]) -> DataFrame:
    """The rows of the query in a file, over the given tables by name. The file may be anywhere that
    Spark reads."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(spark.read.text(path, wholetext=True).first()[0].strip().rstrip(";"))


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, base: str, year: int, round_id: int) -> str:
    """A round's rows as one CSV file with a header, in a folder for the year; replaces an older one."""
    path = f"{base}/{year}/round{round_id}_{year}"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
