"""Sharding: contiguous runs of texts' hashes, cut so that the largest shard is as small as it can be."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bytes that a document counts besides its text.
OVERHEAD = 8
#: Bits of the hash that cells begin with, and cells that one round of splitting may bring to the driver.
FIRST_BITS, CELLS = 14, 1 << 18
#: Most shards: the cuts of more are not found within CELLS.
MOST_SHARDS = 1024
#: Rows of a shard for which its slots are numbered in SLOT_BLOCKS blocks.
SLOT_ROWS, SLOT_BLOCKS = 1 << 20, 64


@dataclass(frozen=True)
class ShardPlan:
    """shards runs of hashes: shard s begins at the s-th cut (None: past all hashes, the shard is empty).
    capacity is the smallest size that the largest shard can have."""

    shards: int
    cuts: tuple[int | None, ...]
    capacity: int


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none: null) and OVERHEAD."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def text_hash(text: Column) -> Column:
    """What texts are ordered by. A null text counts as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


# --- the smallest capacity


def boundary_at_most(sums: np.ndarray, position: int) -> int:
    """Index of the last of the ascending sums that is no larger than position."""
    return int(np.searchsorted(sums, position, "right")) - 1


def fits(sums: np.ndarray, shards: int, capacity: int) -> bool:
    """Whether filling one shard after the other, each as far as capacity lets, places everything."""
    at = 0
    for _ in range(shards):
        at = boundary_at_most(sums, int(sums[at]) + capacity)
        if at == len(sums) - 1:
            return True
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity of `shards` contiguous runs of atomic sizes, by binary search."""
    if not len(sizes):
        return 0
    sums = np.concatenate([[0], np.cumsum(sizes)])
    low = max(int(sizes.max()), -(-int(sums[-1]) // shards))
    high = low + int(sizes.max())  # enough: a shard is left only when less than the largest size fits into the even share
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(sums, shards, middle) else (middle + 1, high)
    return low


def even_share(sizes: np.ndarray, shards: int) -> float:
    """The share of each of `shards` shards, where sizes above the share have shards of their own."""
    share = sizes.sum() / shards
    while (large := sizes > share).any() and large.sum() < shards:
        smaller = sizes[~large].sum() / (shards - large.sum())
        if smaller >= share:
            break
        share = smaller
    return float(share)


def even_cuts(sums: np.ndarray, shards: int, capacity: int) -> list[int]:
    """shards - 1 indices of sums: the cuts of runs none of which is larger than capacity, each as near
    to an even share of what lies before the next atom with a run of its own as that allows. No run is
    empty while atoms are left."""
    last = len(sums) - 1
    back = [last]  # back[m]: from where on the rest fits into m shards
    for _ in range(shards - 1):
        back.append(int(np.searchsorted(sums, int(sums[back[-1]]) - capacity, "left")))
    at, cuts = 0, []
    for left in range(shards - 1, 0, -1):
        sizes = np.diff(sums[at:])
        share = even_share(sizes, left + 1)
        large = np.flatnonzero(sizes > share)
        before = int(sums[at + large[0]] - sums[at]) if len(large) else int(sums[-1] - sums[at])  # up to the next group with a shard of its own
        target = int(sums[at]) + before / max(1, round(before / share)) if share else int(sums[at])
        near = boundary_at_most(sums, target)
        if near < last and sums[near + 1] - target < target - sums[near]:
            near += 1
        at = max(back[left], min(max(near, at + 1), boundary_at_most(sums, int(sums[at]) + capacity)))
        cuts.append(at)
    return cuts


def _may_be_cut(sums: np.ndarray, shards: int, low: int, high: int) -> np.ndarray:
    """For each cell, whether filling by some capacity from low to high may cut inside it."""
    inside = np.zeros(len(sums) - 1, bool)
    earliest, latest, total = 0, 0, int(sums[-1])
    for _ in range(shards - 1):
        earliest = int(sums[boundary_at_most(sums, earliest + low)])
        latest = min(total, latest + high)
        first = max(0, int(np.searchsorted(sums, earliest, "right")) - 1)
        inside[first : int(np.searchsorted(sums, latest, "left"))] = True
        if earliest == total:
            break
    return inside


def plan_shards(docs: DataFrame, shards: int, text: str = "text") -> ShardPlan:
    """The plan of `shards` shards of docs by the bytes of their texts (see text_size).

    Documents with equal texts are one atom and never parted (so are two texts that share 64 bits of
    hash). Atoms are ordered by hash, so a document's shard follows from its own text, without a join.
    The driver holds the sums of at most CELLS cells (ranges of hashes); rounds of splitting follow:
    the smallest capacity of the cells as they are, and the largest cell of several atoms, bound the
    true one, so only cells in which filling may cut are split, by a Spark job a round. The capacity is
    exact when none of them holds several atoms. Nothing depends on rows' order. An empty table has
    only empty shards.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards")
    atoms = materialize(docs.select(text_hash(F.col(text)).alias("hash"), text_size(F.col(text)).alias("size")).groupBy("hash").agg(F.sum("size").alias("size")))
    try:
        return _plan_atoms(atoms, shards)
    finally:
        discard(docs.sparkSession, atoms)


def _cells(atoms: DataFrame, bits: int) -> np.ndarray:
    """Rows (first hash, bits, size, atoms) of the cells that have atoms, in order."""
    cell = F.shiftright("hash", 64 - bits) if bits < 64 else F.col("hash")
    found = atoms.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("atoms")).toPandas()
    rows = np.empty((len(found), 4), np.int64)
    rows[:, 0] = found["cell"].to_numpy(np.int64) << (64 - bits)
    rows[:, 1], rows[:, 2], rows[:, 3] = bits, found["size"], found["atoms"]
    return rows[np.argsort(rows[:, 0])]


def _plan_atoms(atoms: DataFrame, shards: int) -> ShardPlan:
    cells = _cells(atoms, FIRST_BITS)
    low = 0
    while True:
        sums = np.concatenate([[0], np.cumsum(cells[:, 2])])
        high = smallest_capacity(cells[:, 2], shards)
        several = cells[:, 3] > 1
        if not several.any():
            break
        # cuts moved to the ends of their cells add less than one cell to a shard
        low = max(low, -(-int(sums[-1]) // shards), int(cells[~several, 2].max(initial=0)), high - int(cells[several, 2].max()))
        split = several & _may_be_cut(sums, shards, low, high)
        if not split.any():
            break
        bits = int(cells[split, 1].min())
        split &= cells[:, 1] == bits
        finer = min(64, bits + max(1, int(math.log2(CELLS / split.sum())))) if split.sum() < CELLS else bits + 1
        wanted = atoms.sparkSession.createDataFrame([(int(c) >> (64 - bits),) for c in cells[split, 0]], "cell long")
        inside = atoms.join(F.broadcast(wanted), F.shiftright("hash", 64 - bits) == F.col("cell"), "left_semi")
        cells = np.concatenate([cells[~split], _cells(inside, finer)])
        cells = cells[np.argsort(cells[:, 0])]
    cuts = even_cuts(sums, shards, high) if len(cells) else [0] * (shards - 1)
    return ShardPlan(shards, tuple(int(cells[c, 0]) if c < len(cells) else None for c in cuts), int(high))


# --- placing documents


def shard_of(plan: ShardPlan, text: Column) -> Column:
    """The shard (0, 1, ...) of a document with this text."""
    cuts = [c for c in plan.cuts if c is not None]
    if len(cuts) <= 64:
        return sum(((text_hash(text) >= c).cast("int") for c in cuts), start=F.lit(0))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= text_hash(text)))


def with_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """rows with a number in each shard, from 0 and without gaps; the same for the same rows.

    Rows that agree in all columns are counted first and numbered together, so copies weigh nothing.
    The different ones of a shard are dealt into blocks by a hash of all columns; blocks are numbered
    from the sums of those before. rows is computed once and may hold no maps.
    """
    columns = rows.columns
    held = materialize(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies")))
    most = held.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = SLOT_BLOCKS * max(1, -(-most // SLOT_ROWS))
    dealt = held.withColumn("__block", F.pmod(F.xxhash64(*columns), F.lit(blocks)))
    # a run of sums over the blocks of each shard: `blocks` rows a shard
    sums = dealt.groupBy(shard, "__block").agg(F.sum("__copies").alias("__sum"))
    before = W.partitionBy(shard).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col(shard).alias("__shard"), F.col("__block").alias("__its"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(shard, "__block").orderBy(*(c for c in columns if c != shard)).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("__first", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col(shard).eqNullSafe(F.col("__shard")) & (F.col("__block") == F.col("__its")))
    # copies, some thousands at a time
    step = 1 << 12
    runs = placed.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(step).cast("long"))))
    copies = runs.withColumn("__copy", F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + step, "__copies") - 1)))
    return copies.select(*columns, (F.col("__start") + F.col("__first") + F.col("__copy")).alias(slot))


def shard_report(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32 (of the UTF-8 bytes; 0 without text), law, shard, slot, grown_shard of
    every row of docs (doc_id, text) under the law `bytes`.

    Sizes of shards are as even as whole groups of equal texts allow: none is larger than the smallest
    possible capacity. Null and empty texts are one group. Rows that repeat a doc_id count each; a
    null doc_id is a value like others. grown_shard is null: under this law another shard moves rows
    everywhere.
    """
    plan = plan_shards(docs, shards)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), shard_of(plan, F.col("text")).alias("shard"))
    return with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, plan: ShardPlan, path: str, text: str = "text") -> None:
    """docs as Parquet, a folder shard=s for each shard (a column of that name is replaced). Rows of a
    shard are dealt to SLOT_BLOCKS tasks by all their values, so a large shard is no single task."""
    placed = docs.withColumn("shard", shard_of(plan, F.col(text)))
    kinds = dict(docs.dtypes)
    spread = F.pmod(F.xxhash64(*(c for c in docs.columns if not kinds[c].startswith("map"))), F.lit(SLOT_BLOCKS))
    placed.repartition("shard", spread).write.mode("overwrite").partitionBy("shard").parquet(path)
