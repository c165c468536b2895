"""A keyed table of which an upsert rewrites only the buckets that it touches, and readers see whole versions."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import _there, path_exists, release_path
from .store import latest, upsert


@dataclass(frozen=True)
class KeyedTable:
    """Rows by key in Parquet files of `buckets` hash buckets. A version is a small file that names each bucket's
    folder; it is written last, so a run that ends before leaves the version before as it was. One writer at a time: of two
    that make the same version, the later one gets an error and may try again."""

    spark: SparkSession
    folder: str
    schema: StructType
    key: str = "game_id"
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        path, files = _there(self.spark, f"{self.folder}/versions")
        found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[:-5].isdigit())

    def _folders(self, version: int | None) -> dict[str, str]:
        if version is None:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{version:010d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default. A read goes on with its version's files while newer ones are written."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        return self._rows(self._folders(version if version is not None else known[-1] if known else None))

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/data/{f}/bucket={b}" for b, f in folders.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame, order: str | None = None) -> int:
        """The number of the version that has the rows of new in place of those with their keys (of new rows with one key
        the last by `order`, see store.latest). Reads and writes the buckets of new's keys only."""
        known = self.versions()
        folders = self._folders(known[-1] if known else None)
        columns = [*self.schema.names, *([order] if order and order not in self.schema.names else [])]
        last = latest(new.select(*columns), self.key, order)
        touched = [str(r[0]) for r in last.select(self._bucket()).distinct().collect()]  # `buckets` rows at most
        existing = self._rows({b: folders[b] for b in touched if b in folders})
        written = uuid.uuid4().hex
        merged = upsert(existing, last, self.key).withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{written}")
        version = (known[-1] if known else 0) + 1
        self._publish(version, folders | {b: written for b in touched})
        return version

    def _publish(self, version: int, folders: dict[str, str]) -> None:
        """The version's file under its name: written aside, then renamed, which fails if another has the name."""
        aside, files = _there(self.spark, f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = files.create(aside)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        target = f"{self.folder}/versions/{version:010d}.json"
        if path_exists(self.spark, target) or not files.rename(aside, _there(self.spark, target)[0]):
            files.delete(aside, False)
            raise RuntimeError(f"version {version} was written by another; try again")

    def forget(self, keep: int = 2) -> None:
        """Remove all versions but the last `keep`, and folders that none of these needs. Not while a writer or a reader of
        an older version is at work."""
        known = self.versions()
        needed = {f for v in known[-max(keep, 1) :] for f in self._folders(v).values()}
        for v in known[: -max(keep, 1)]:
            release_path(self.spark, f"{self.folder}/versions/{v:010d}.json")
        path, files = _there(self.spark, f"{self.folder}/data")
        for status in files.listStatus(path) if files.exists(path) else []:
            if status.getPath().getName() not in needed:
                files.delete(status.getPath(), True)
