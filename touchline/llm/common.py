"""What the operators of this subpackage share: tables, materialised steps, row hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local
    session (one process, as in tests) gets a temporary one, and a cluster gets an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="touchline-shared-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Paths written by materialize and not yet removed, while scratch() is open.
_WRITTEN: list[list[str]] = []


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost
    executors, and lets several later steps read one result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    note_written(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._touchline_path = path
    return found


def note_written(path: str) -> None:
    for paths in _WRITTEN:
        paths.append(path)


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Remove what materialize wrote, once nothing reads it any more."""
    for w in written:
        path = w if isinstance(w, str) else getattr(w, "_touchline_path", None)
        if path:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Remove at the end all that materialize wrote inside, but for what is taken out of the list."""
    paths: list[str] = []
    _WRITTEN.append(paths)
    try:
        yield paths
    finally:
        _WRITTEN.pop()
        discard(spark, *paths)


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns of these names (in any case) under others, and how to name them back."""
    taken = {n.lower() for n in names}
    aside = {c: f"{c}__kept" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(aside), {new: old for old, new in aside.items()}


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def utf8_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words: multiply and xor-shift, three times."""
    x = x.astype(np.uint64, copy=True)
    for multiplier, shift in ((0xFF51AFD7ED558CCD, 33), (0xC4CEB9FE1A85EC53, 33), (0x9E3779B97F4A7C15, 29)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(multiplier)
    return x ^ (x >> np.uint64(32))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold only whole groups, from batches that are sorted by keys."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        columns = [now.column(k).to_numpy(zero_copy_only=False) for k in keys]
        tail = tuple(c[-1] for c in columns)
        other = np.zeros(len(now), bool)
        for c, t in zip(columns, tail):
            other |= c != t
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut or (last is not None and tail != last):
            yield pa.concat_tables([*held, now.slice(0, cut)]).combine_chunks()
            held = []
        held.append(now.slice(cut))
        last = tail
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its length at the end."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(table))


class WordCodes(dict):
    """63-bit hashes of words, remembered; forget() keeps the memory bounded."""

    MOST = 1_000_000

    def __missing__(self, word: bytes) -> int:
        self[word] = code = xxhash.xxh3_64_intdigest(word) >> 1
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)

    def forget(self) -> None:
        if len(self) > self.MOST:
            self.clear()
