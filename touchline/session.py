"""Session defaults for scripts and tests."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster, submit sets the master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of a batch that goes to a Python worker: texts are long, so fewer than Spark's default.
BATCH_ROWS = "1000"
#: And bytes, as a row may hold some MB (the chunks of `llm/lm.py`): JVM and worker both hold a whole batch.
BATCH_BYTES = "8m"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once for each context, and let
    batches of rows be small, unless the session says otherwise."""
    context = spark.sparkContext
    for limit, value in ("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES):
        name = f"spark.sql.execution.arrow.{limit}"
        if not context.getConf().contains(name) and not getattr(context, "_touchline_shipped", False):
            spark.conf.set(name, value)
    if not getattr(context, "_touchline_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="touchline-")) / "touchline.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
        context._touchline_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A local session (one process)
    without one gets a temporary folder; a cluster gets an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="touchline-shared-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Files that executions shuffle inside are removed as each ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def keep(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, its lineage cut, its
    columns still pruned by what reads it. release() removes it."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):  # what is written is read from here on
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._touchline_kept = path
    return found


def release(df: DataFrame) -> None:
    """Remove what keep() wrote, once nothing reads it any more."""
    path = getattr(df, "_touchline_kept", None)
    if path:
        release_path(df.sparkSession, path)


def _there(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def release_path(spark: SparkSession, path: str) -> None:
    there, files = _there(spark, path)
    files.delete(there, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    there, files = _there(spark, path)
    return files.exists(there)


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, for what several later steps and the caller read."""
    return keep(df)
