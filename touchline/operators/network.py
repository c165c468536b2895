"""A small network of expected counts: one hidden layer, Poisson loss, trained on gradients that Spark sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, release
from .boosting import together
from .chained import Design

#: Digits of mean gradients that count, so the order in which rows were added doesn't.
DIGITS = 9
#: Logarithms of expected counts are held within this.
STEEPEST = 20.0


@dataclass(frozen=True)
class Network:
    hidden: int = 8
    steps: int = 60
    rate: float = 0.05
    l2: float = 1e-4
    seed: int = 42


def expected(weights: np.ndarray, x: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """The hidden layer's values and the logarithm of the expected count of each row of x."""
    layer = np.tanh(x @ weights[: x.shape[1] * hidden].reshape(x.shape[1], hidden))
    return layer, layer @ weights[-hidden - 1 : -1] + weights[-1]


def loss_and_gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, seen: np.ndarray | float = 1.0) -> tuple[float, np.ndarray]:
    """Sums over the rows (weighted by seen) of the Poisson loss (without its constant) and of its gradient."""
    layer, eta = expected(weights, x, hidden)
    held = np.clip(eta, -STEEPEST, STEEPEST)
    mean = np.exp(held)
    off = np.where(held == eta, mean - y, 0.0) * seen
    first = x.T @ (off[:, None] * weights[-hidden - 1 : -1] * (1 - layer**2))
    return float(((mean - y * held) * seen).sum()), np.concatenate([first.ravel(), layer.T @ off, [off.sum()]])


def prepare(df: DataFrame, numbers: list[str], texts: list[str], label: str, key: str, folds: int = 1, levels: int = 30) -> tuple[DataFrame, Design]:
    """The rows that know the label, kept in the shared folder: numbers (missing ones are the mean), texts as places of their
    levels (-1: another), made once and not in each pass, __y and __fold
    (a hash of key); and the matrix's design, with the `levels` most frequent levels of each text."""
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    rows = df.select(*(finite(c).alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in texts), finite(label).alias("__y"), F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("__fold"))
    table = keep(rows.filter("__y >= 0"))
    sums = table.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in numbers for f in (F.avg, F.stddev_pop)), F.avg("__y").alias("__y")).first()
    if sums["__y"] is None:
        raise ValueError(f"no row knows {label}")
    frequent = {c: [r[c] for r in table.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(levels).collect()] for c in texts}
    place = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, frequent[c])), F.col(c)), F.lit(0)) - 1 if frequent[c] else F.lit(-1)
    coded = keep(table.select(*numbers, *(place(c).cast("int").alias(c) for c in texts), "__y", "__fold"))
    release(table)
    return coded, Design({c: sums[f"avg_{c}"] or 0.0 for c in numbers}, {c: sums[f"stddev_pop_{c}"] or 1.0 for c in numbers}, frequent)


def _matrix(design: Design, rows: pd.DataFrame) -> np.ndarray:
    return np.nan_to_num(design.matrix(rows, ""), nan=0.0)


def _coded_matrix(design: Design, rows: pd.DataFrame) -> np.ndarray:
    """_matrix of rows of prepare's table, in which texts are the places of their levels."""
    numbers = [design.scaled(rows, c) for c in design.centre]
    hot = [(rows[c].to_numpy()[:, None] == np.arange(len(known))).astype(float) for c, known in design.levels.items()]
    return np.nan_to_num(np.column_stack([np.ones(len(rows)), *numbers, *hot]), nan=0.0)


def train(table: DataFrame, design: Design, specs: list[tuple[Network, int]]) -> list[np.ndarray]:
    """Weights of each (network, fold that it doesn't see; -1: sees all), by Adam on whole gradients. All networks take
    their steps in the same passes over the rows; only sums of gradients come to the driver."""
    width = 1 + len(design.centre) + sum(map(len, design.levels.values()))
    mean = table.agg(F.avg("__y")).first()[0]
    weights, moments, first = [], [], []
    for network, _ in specs:
        w = np.random.default_rng(network.seed).normal(0, 1 / np.sqrt(width), width * network.hidden + network.hidden + 1)
        w[-network.hidden - 1 : -1] *= 0.1
        w[-1] = np.log(max(mean, 1e-9))
        weights.append(w)
        moments.append(np.zeros_like(w))
        first.append(np.zeros_like(w))
    for step in range(max((n.steps for n, _ in specs), default=0)):
        active = [i for i, (n, _) in enumerate(specs) if step < n.steps]

        def sums(batches: Iterator[pa.RecordBatch], now=tuple(weights), active=tuple(active)) -> Iterator[pa.RecordBatch]:
            total = {i: np.zeros(len(now[i]) + 1) for i in active}
            for rows in map(pa.RecordBatch.to_pandas, together(batches)):
                x, y, fold = _coded_matrix(design, rows), rows["__y"].to_numpy(float), rows["__fold"].to_numpy()
                for i in active:
                    seen = (fold != specs[i][1]).astype(float)
                    total[i] += np.append(loss_and_gradient(now[i], x, y, specs[i][0].hidden, seen)[1], seen.sum())
            for i, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i, np.int32)), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(t)], names=["i", "place", "g"])

        found = {i: np.zeros(len(weights[i]) + 1) for i in active}
        for r in table.mapInArrow(sums, "i int, place int, g double").groupBy("i", "place").agg(F.sum("g").alias("g")).collect():
            found[r["i"]][r["place"]] = r["g"]
        for i in active:
            network = specs[i][0]
            g = (found[i][:-1] / max(found[i][-1], 1.0)).round(DIGITS) + network.l2 * np.append(weights[i][:-1], 0.0)
            first[i] = 0.9 * first[i] + 0.1 * g
            moments[i] = 0.99 * moments[i] + 0.01 * g * g
            move = first[i] / (1 - 0.9 ** (step + 1)) / (np.sqrt(moments[i] / (1 - 0.99 ** (step + 1))) + 1e-8)
            weights[i] = weights[i] - network.rate * move
    return weights


@dataclass
class FittedNetwork:
    design: Design
    network: Network
    weights: np.ndarray

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """df and the expected count as column `out`; missing numbers count as the mean, unknown levels as none."""
        own, finite = self, lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(np.exp(np.clip(expected(own.weights, _matrix(own.design, rows), own.network.hidden)[1], -STEEPEST, STEEPEST)))

        return df.withColumn(out, score(F.struct(*(finite(c).alias(c) for c in own.design.centre), *(F.col(c).cast("string").alias(c) for c in own.design.levels))))


def search(df: DataFrame, numbers: list[str], texts: list[str], label: str, candidates: list[Network], key: str = "game_id", folds: int = 3) -> tuple[FittedNetwork, list[float]]:
    """The candidate of least cross-validated Poisson deviance (the first of equals) fitted on all rows, and all candidates'
    deviances. All candidates, by folds and on all rows, are trained in the same passes."""
    table, design = prepare(df, numbers, texts, label, key, folds)
    try:
        specs = [(n, f) for n in candidates for f in range(folds)]
        weights = train(table, design, [*specs, *((n, -1) for n in candidates)])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(candidates), 2))
            for rows in map(pa.RecordBatch.to_pandas, together(batches)):
                x, y, fold = _coded_matrix(design, rows), rows["__y"].to_numpy(float), rows["__fold"].to_numpy()
                for i, (network, held) in enumerate(specs):
                    own = fold == held
                    eta = np.clip(expected(weights[i], x[own], network.hidden)[1], -STEEPEST, STEEPEST)
                    log_y = np.log(np.where(y[own] > 0, y[own], 1.0))
                    total[i // folds] += (2 * (y[own] * (log_y - eta) - y[own] + np.exp(eta))).sum(), own.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(candidates), dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["i", "d", "n"])

        found = {r["i"]: r["d"] for r in table.mapInArrow(judge, "i int, d double, n double").groupBy("i").agg((F.sum("d") / F.sum("n")).alias("d")).collect()}
        deviances = [found[i] for i in range(len(candidates))]
        best = min(range(len(candidates)), key=lambda i: (deviances[i], i))
        return FittedNetwork(design, candidates[best], weights[len(specs) + best]), deviances
    finally:
        release(table)
