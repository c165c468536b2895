"""Named stages that each hand a table to the next: counted, timed, taken up again after the last good one."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .session import path_exists, release_path

#: A stage makes a table from the one before (None for the first).
Stage = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]
REPORT = "stage_no int, stage string, status string, rows long, seconds double, error string"


class StageFailed(RuntimeError):
    """Says which stage failed; what it failed of is its cause."""

    def __init__(self, stage: str) -> None:
        super().__init__(f"stage {stage} failed")
        self.stage = stage


def run_stages(spark: SparkSession, stages: list[Stage], folder: str) -> DataFrame:
    """The last stage's table. Each stage's table is Parquet in folder, and report() says how each went.

    Jobs of a stage bear the tag `stage-<name>`. A stage whose table is whole there (Spark marks it at the end of the
    write) is kept and not run, unless one before it ran; so after a failure the next run goes on with the stage that
    failed, and another folder begins anew. A stage that fails stops the run with StageFailed.
    """
    if not stages or len({name for name, _ in stages}) < len(stages):
        raise ValueError("stages need names of their own, one stage at least")
    context, before, anew = spark.sparkContext, None, False
    for number, (name, make) in enumerate(stages):
        path, begun = f"{folder}/{number:02d}_{name}", time.monotonic()
        if not anew and path_exists(spark, f"{path}/_SUCCESS"):
            before = spark.read.parquet(path)
            _note(spark, folder, number, name, "kept", before.count(), begun)
            continue
        anew, counted = True, Observation()
        context.addJobTag(f"stage-{name}")
        try:
            release_path(spark, path)
            made = make(spark, before)
            made.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            before = spark.read.schema(made.schema).parquet(path)
            _note(spark, folder, number, name, "done", counted.get.get("rows", 0), begun)
        except Exception as error:
            _note(spark, folder, number, name, "failed", None, begun, f"{type(error).__name__}: {error}"[:1000])
            raise StageFailed(name) from error
        finally:
            context.removeJobTag(f"stage-{name}")
    return before


def _note(spark: SparkSession, folder: str, number: int, name: str, status: str, rows: int | None, begun: float, error: str | None = None) -> None:
    spark.createDataFrame([(number, name, status, rows, time.monotonic() - begun, error)], REPORT).coalesce(1).write.mode("overwrite").parquet(f"{folder}/report/stage_no={number}")


def report(spark: SparkSession, folder: str) -> DataFrame:
    """stage_no, stage, status (done, kept, failed), rows, seconds, error: how each stage went when it was last come to."""
    return spark.read.schema(REPORT).parquet(f"{folder}/report/*").select("stage_no", "stage", "status", "rows", "seconds", "error")
