"""Missing numbers filled by chained equations: each incomplete column in turn is regressed on the others, and a row
takes the value of a known row whose prediction is near its own. Several completed tables, estimates pooled."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, release

#: Digits of coefficients (of scaled columns) that count, so the order in which sums were added doesn't.
DIGITS = 9
RIDGE = 1e-5
#: Completed rows of a range of predictions, one of which is filled at a time.
RANGE_ROWS = 500_000


@dataclass(frozen=True)
class Design:
    """A regression's matrix: ones, scaled numbers, and a column for each known level of each text."""

    centre: dict[str, float]
    scale: dict[str, float]
    levels: dict[str, list[str]]

    def scaled(self, rows: pd.DataFrame, column: str) -> np.ndarray:
        return (rows[column].to_numpy(float) - self.centre[column]) / self.scale[column]

    def matrix(self, rows: pd.DataFrame, target: str) -> np.ndarray:
        numbers = [self.scaled(rows, c) for c in self.centre if c != target]
        hot = [(rows[c] == level).to_numpy(float) for c, known in self.levels.items() for level in known]
        return np.column_stack([np.ones(len(rows)), *numbers, *hot])


def nearest_donors(at: np.ndarray, donors_at: np.ndarray, count: int) -> np.ndarray:
    """For each place of `at` the indices of the `count` nearest of the ascending donors_at, nearest first; -1
    where there are fewer."""
    seen = np.searchsorted(donors_at, at)[:, None] + np.arange(-count, count)
    there = (seen >= 0) & (seen < len(donors_at))
    away = np.where(there, np.abs(donors_at[np.clip(seen, 0, max(len(donors_at) - 1, 0))] - at[:, None]), np.inf)
    order = np.argsort(away, axis=1, kind="stable")[:, :count]
    return np.where(np.take_along_axis(there, order, 1), np.take_along_axis(seen, order, 1), -1)


def _coefficients(gram: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The fitted coefficients, and ones drawn from their posterior, from sums of products whose last column
    is the target's."""
    xx, xy, yy, n = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1], gram[0, 0]
    xx = xx + np.diag(RIDGE * np.diag(xx) + 1e-9)
    fitted = np.linalg.solve(xx, xy)
    spread = max(yy - fitted @ xy, 0.0) / rng.chisquare(max(n - len(xy), 1))
    lower = np.linalg.cholesky((np.linalg.inv(xx) + np.linalg.inv(xx).T) / 2 + 1e-15 * np.eye(len(xy)))
    drawn = fitted + np.sqrt(spread) * lower @ rng.standard_normal(len(xy))
    return fitted.round(DIGITS), drawn.round(DIGITS)


def _grams(rows: DataFrame, design: Design, target: str, tables: int) -> np.ndarray:
    """Sums of products over the rows that know target, for each table; what comes to the driver grows with
    the matrix's width only."""
    width = design.matrix(pd.DataFrame(columns=[*design.centre, *design.levels]), target).shape[1] + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((tables, width, width))
        for batch in batches:
            m = np.column_stack([design.matrix(batch, target), design.scaled(batch, target)])
            for t in np.unique(batch["__table"]):
                own = m[(batch["__table"] == t).to_numpy()]
                total[t] += own.T @ own
        yield pd.DataFrame({"place": np.arange(total.size), "x": total.ravel()})

    known = rows.filter(~F.col(f"__missing_{target}")).select("__table", *design.centre, *design.levels)
    out = np.zeros(tables * width * width)
    for r in known.mapInPandas(sums, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect():
        out[r["place"]] = r["x"]
    return out.reshape(tables, width, width)


def _edges(dealt: DataFrame, target: str, count: int) -> pd.DataFrame:
    """The first and the last `count` donors of each range and table: __range, __table, __at, __tie, target."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            by = held.sort_values(["__at", "__tie"], kind="stable").groupby(["__range", "__table"])
            held = held.loc[by.cumcount().lt(count) | by.cumcount(ascending=False).lt(count)].reset_index(drop=True)
        if held is not None:
            yield held

    places = dealt.filter(~F.col(f"__missing_{target}")).select("__range", "__table", "__at", "__tie", target)
    return places.mapInPandas(ends, places.schema).toPandas()


def _fill(rows: DataFrame, design: Design, target: str, tables: int, donors: int, step: int, seed: int, partitions: int) -> DataFrame:
    """rows with the missing values of target drawn anew, kept in the shared folder."""
    grams, flag = _grams(rows, design, target, tables), f"__missing_{target}"
    both = [_coefficients(grams[t], np.random.default_rng([seed, step, t])) for t in range(tables)]
    fitted, drawn = (np.array([b[i] for b in both]) for i in (0, 1))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t = batch["__table"].to_numpy()
            used = np.where(batch[flag].to_numpy(bool)[:, None], drawn[t], fitted[t])
            yield batch.assign(__at=(design.matrix(batch, target) * used).sum(axis=1))

    hashed = lambda salt: F.xxhash64("__key", "__table", F.lit(f"{seed} {step} {salt}"))
    marked = rows.withColumns({"__tie": hashed("tie"), "__draw": F.pmod(hashed("draw"), F.lit(2**31)).cast("int")})
    placed = marked.mapInPandas(predict, f"{_ddl(marked)}, __at double")
    # rows of one prediction are dealt by __tie, so many equal ones make no large range
    dealt = keep(placed.repartitionByRange(partitions, "__table", "__at", "__tie").withColumn("__range", F.spark_partition_id()))
    edges = _edges(dealt, target, donors).sort_values(["__at", "__tie"], kind="stable")  # 2 x donors a range and table
    near: dict[tuple[int, int], pd.DataFrame] = {}
    for t, of_table in edges.groupby("__table"):
        for place in range(partitions):
            near[place, int(t)] = pd.concat([of_table[of_table["__range"] < place].tail(donors), of_table[of_table["__range"] > place].head(donors)])
    columns = [*rows.columns]

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        missing = group[flag].to_numpy(bool)
        if missing.any():
            around = near.get((int(key[0]), int(key[1])))
            pool = pd.concat([group.loc[~missing, ["__at", "__tie", target]], *([] if around is None else [around[["__at", "__tie", target]]])])
            pool = pool.sort_values(["__at", "__tie"], kind="stable")
            wanted = group.loc[missing]
            found = nearest_donors(wanted["__at"].to_numpy(), pool["__at"].to_numpy(), donors)
            pick = wanted["__draw"].to_numpy() % (found >= 0).sum(axis=1)
            group.loc[missing, target] = pool[target].to_numpy()[found[np.arange(len(found)), pick]]
        return group[columns]

    filled = keep(dealt.groupBy("__range", "__table").applyInPandas(fill, rows.schema))
    release(dealt)
    return filled


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {kind}" for n, kind in df.dtypes)


def complete(df: DataFrame, key: str, numbers: list[str], texts: list[str] | None = None, tables: int = 5, sweeps: int = 5, donors: int = 5, levels: int = 30, seed: int = 69, partitions: int | None = None) -> DataFrame:
    """key, table (from 0) and numbers without nulls: `tables` completed copies of df's rows.

    A sweep goes over the incomplete columns, those with the fewest gaps first. Each is regressed on the other
    numbers (gaps as filled so far, first by the mean) and on texts (their `levels` most frequent levels; others and
    nulls are one). A row that misses the value takes that of one of the `donors` known rows whose fitted values are
    nearest to its own prediction by coefficients drawn from their posterior; a hash of key says which. Known values
    stay, so filled ones are values that occur. NaN and infinities are missing. A column without known values stays
    null and predicts nothing. Rows that repeat a key stay. Runs with one seed agree.

    All tables are filled in the same passes. A pass deals rows into ranges of predictions (equal ones by hash), and a
    range gets the nearest donors of its neighbours, so a row's donors are the nearest of all.
    """
    texts = texts or []
    spark = df.sparkSession
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    base = keep(df.select(F.col(key).alias("__key"), *(finite(c).alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in texts)))
    sums = base.agg(F.count(F.lit(1)).alias("__rows"), *(f(c).alias(f"{f.__name__}_{c}") for c in numbers for f in (F.count, F.avg, F.stddev_pop))).first()
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sums["__rows"] * tables / RANGE_ROWS))
    known = [c for c in numbers if sums[f"count_{c}"]]
    gaps = sorted((c for c in known if sums[f"count_{c}"] < sums["__rows"]), key=lambda c: (-sums[f"count_{c}"], c))
    frequent = {c: [r[c] for r in base.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(levels).collect()] for c in texts}
    design = Design({c: sums[f"avg_{c}"] for c in known}, {c: sums[f"stddev_pop_{c}"] or 1.0 for c in known}, frequent)
    rows = base.select(
        "__key",
        F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("__table"),
        *(F.coalesce(c, F.lit(sums[f"avg_{c}"])).alias(c) if c in gaps else F.col(c) for c in numbers),
        *texts,
        *(F.col(c).isNull().alias(f"__missing_{c}") for c in gaps),
    )
    step = 0
    for _ in range(sweeps):
        for target in gaps:
            filled = _fill(rows, design, target, tables, donors, step, seed, partitions)
            release(rows)
            rows, step = filled, step + 1
    return rows.select(F.col("__key").alias(key), F.col("__table").alias("table"), *numbers)


def pooled_means(completed: DataFrame, columns: list[str]) -> DataFrame:
    """column, estimate, within, between, total: each column's mean over completed tables, the mean of its squared
    standard errors, the variance of means over tables, and both together. One table alone has no between (0)."""
    cells = completed.select("table", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns))).alias("c")).select("table", "c.*")
    of_tables = cells.groupBy("column", "table").agg(F.avg("x").alias("q"), (F.var_samp("x") / F.count("x")).alias("u"))
    pooled = of_tables.groupBy("column").agg(F.avg("q").alias("estimate"), F.avg("u").alias("within"), F.coalesce(F.var_samp("q"), F.lit(0.0)).alias("between"), F.count(F.lit(1)).alias("m"))
    return pooled.select("column", "estimate", "within", "between", (F.col("within") + (1 + 1 / F.col("m")) * F.col("between")).alias("total"))
