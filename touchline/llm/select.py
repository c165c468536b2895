"""Ranked selection and joins with hot groups: no group is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the rank that one pass sorts rows by, and passes at most.
STEP_BITS, PASSES = 12, 4
#: Rows that may be put in order in one task; more are sorted by further bits of the rank first.
CROWD = 20_000
#: Rows from which a key counts as hot, and hot keys at most.
HOT, HOT_KEYS = 1000, 10_000


def unit_interval(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns' values only: 52 bits of xxhash64."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") + 0.5) / float(1 << 52)


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of groups, which has one row for each key and says in `count` how many of
    the `total` rows have it.

    Keys with more than HOT rows, and more than total / HOT_KEYS, are joined by broadcast: there are at
    most HOT_KEYS of them, and no task gets all rows of one. Rows without a key take no part in the
    join (with how="left" they stay). rows and groups should be cheap to read twice.
    """
    most = max(HOT, total // HOT_KEYS)
    hot = F.broadcast(groups.filter(F.col(count) > most))
    few = rows.filter(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti")
    out = rows.join(hot, key).unionByName(few.join(groups.filter(F.col(count) <= most), key, how))
    return out.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def join_group(rows: DataFrame, groups: DataFrame, names: dict[str, str], spread: str, salts: int = 64) -> DataFrame:
    """rows with the columns of groups (one row per group), where rows' column equals groups' column
    for each of names, nulls included. Each group is dealt over `salts` keys by a hash of `spread`,
    so a group that holds a third of the rows is no task of its own."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = groups.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = F.col("__salt") == F.col("__copy")
    for mine, other in names.items():
        condition &= F.col(mine).eqNullSafe(F.col(other))
    return left.join(right, condition, "left").drop("__salt", "__copy", *names.values())


def _placed(rows: DataFrame, found: DataFrame, group: list[str], spread: str) -> DataFrame:
    """rows with the columns of found, which has one row for each group (one in all without any)."""
    if group:
        return join_group(rows, found, {c: f"__g{i}" for i, c in enumerate(group)}, spread)
    row = found.first()
    return rows.withColumns({f.name: F.lit(None if row is None else row[f.name]).cast(f.dataType) for f in found.schema.fields})


def first_until(rows: DataFrame, group: list[str], rank: str, size: str, limit: DataFrame, limit_column: str, ties: list[str], out: str) -> DataFrame:
    """rows with a boolean column `out`: true for the rows of each group that come first by `rank`
    (a double in [0, 1], then `ties`) until their sizes come nearest to the group's limit.

    No group is gathered: sizes are summed by group and by the first STEP_BITS bits of the rank, and a
    running sum over at most 2**STEP_BITS sums finds the step in which the limit is reached. While a
    group has more than CROWD rows in that step, they are summed by the next bits in turn. Only the
    last step's rows are put in order; they are more than CROWD only if their ranks agree in
    STEP_BITS * PASSES bits. rows must be cheap to read several times (a written table). A null in
    group matches a null; without group columns, limit is one row.
    """
    all_bits = STEP_BITS * PASSES
    bits = F.least(F.floor(F.col(rank) * float(1 << all_bits)), F.lit((1 << all_bits) - 1)).cast("long")
    stepped = rows.withColumn("__bits", bits)
    keys = [f"__g{i}" for i in range(len(group))]
    # by group: the limit, where the limit is reached (bits so far; null: nowhere), the sum before it
    found = limit.select(*(F.col(c).alias(k) for c, k in zip(group, keys)), F.col(limit_column).cast("double").alias("__limit"))
    found = found.select("*", F.lit(0).cast("long").alias("__at"), F.lit(0.0).alias("__before"))
    running = W.partitionBy(*group).orderBy("__step").rowsBetween(W.unboundedPreceding, W.currentRow)
    sum_and_rows = F.sum(size).cast("double").alias("__sum"), F.count(F.lit(1)).alias("__rows")
    for n in range(1, PASSES + 1):
        left = all_bits - n * STEP_BITS
        bits = F.shiftright("__bits", left).alias("__step")
        if n == 1:
            sums = _placed(stepped.groupBy(*group, bits).agg(*sum_and_rows), found, group, "__step")
        else:
            near = _placed(stepped, found, group, ties[0]).filter(F.shiftright("__bits", left + STEP_BITS) == F.col("__at"))
            sums = near.groupBy(*group, bits).agg(*sum_and_rows, *(F.any_value(c).alias(c) for c in ("__limit", "__before")))
        through = F.col("__before") + F.sum("__sum").over(running)
        passed = F.when(F.col("__through") > F.col("__limit"), F.struct(F.col("__step").alias("at"), (F.col("__through") - F.col("__sum")).alias("before"), F.col("__rows").alias("rows")))
        edges = (
            sums.withColumn("__through", through)
            .groupBy(*group)
            .agg(F.any_value("__limit").alias("__limit"), F.min(passed).alias("edge"))
            .select(*(F.col(c).alias(k) for c, k in zip(group, keys)), "__limit", F.col("edge.at").alias("__at"), F.col("edge.before").alias("__before"), F.col("edge.rows").alias("__rows"))
        )
        # groups without such a step have been placed
        found = materialize(edges.unionByName(found.filter("__at is null")) if n > 1 else edges)
        if (found.agg(F.max("__rows")).first()[0] or 0) <= CROWD:
            break
    placed = _placed(stepped, found.drop("__rows"), group, ties[0])
    step = F.shiftright("__bits", left)
    edge = F.coalesce(step == F.col("__at"), F.lit(False))
    ordered = W.partitionBy(*group, "__at").orderBy(rank, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    on_edge = placed.filter(edge).withColumn("__so_far", F.col("__before") + F.sum(size).over(ordered) - F.col(size))
    on_edge = on_edge.withColumn(out, F.col("__so_far") + F.col(size) / 2.0 <= F.col("__limit"))
    others = placed.filter(~edge).withColumn(out, F.col("__limit").isNotNull() & (F.col("__at").isNull() | F.coalesce(step < F.col("__at"), F.lit(False))))
    return others.select(*rows.columns, out).unionByName(on_edge.select(*rows.columns, out))
