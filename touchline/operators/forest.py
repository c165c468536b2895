"""Forests whose bags are known: votes of the trees that did not see a row, repeated cross-validation.

Bags and folds are hashes of (row, tree) and (row, repeat), so whether a tree saw a row is known wherever the
row is. All trees of a batch grow in step, a pass over the rows a level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import release
from .boosting import BINS, Binning, Tree, _matrix, _scramble, binned, together

#: Trees that grow in the same passes.
TREES_AT_ONCE = 100
#: Sums of rows and of ones of a batch in one number: ones count this much.
PACKED = float(1 << 26)
#: Chances that a row is up to 0, 1, ... times in a bag: a Poisson number of mean 1, as of many draws with replacement.
BAG = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Forest:
    """Settings: trees, predictors tried a split (0: the root of their number), depth, rows of a leaf; of
    folds > 1 the fold of `repeat` that is left out (-1: none)."""

    trees: int = 100
    tried: int = 0
    max_depth: int = 10
    min_rows: int = 1
    seed: int = 42
    folds: int = 1
    repeat: int = 0
    fold: int = -1


@cache
def _salted(*salt: int) -> np.uint64:
    mixed = np.zeros(1, np.uint64)
    for s in salt:
        mixed = _scramble(mixed ^ np.array([s], np.int64).view(np.uint64) + np.uint64(0x9E37))
    return mixed[0]


def _uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each key."""
    return (_scramble(_scramble(keys.view(np.uint64)) ^ _salted(*salt)) >> np.uint64(11)).astype(float) / float(1 << 53)


#: The 64-bit words from which on a row is at least 1, 2, ... times in a bag.
FROM = np.array([math.ceil(b * (1 << 53)) << 11 for b in BAG.tolist()], np.uint64)


def _bag_words(mixed: np.ndarray, forest: Forest, tree: int) -> np.ndarray:
    """What FROM is compared with, for keys scrambled once (which serves all trees)."""
    return _scramble(mixed ^ _salted(forest.seed, 1, tree))


def _times(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for bound in FROM:
        more = words >= bound
        if not more.any():
            break
        out += more
    return out


def in_bag(keys: np.ndarray, forest: Forest, tree: int) -> np.ndarray:
    """How often each row is in the tree's bag."""
    return _times(_bag_words(_scramble(keys.view(np.uint64)), forest, tree))


def fold_of(keys: np.ndarray, forest: Forest) -> np.ndarray:
    return (_uniform(keys, forest.seed, 2, forest.repeat) * forest.folds).astype(int)


@dataclass
class Growing:
    forest: Forest
    number: int
    tree: Tree = field(default_factory=Tree)
    level: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def tried(self, predictors: int) -> np.ndarray:
        """Predictors that each node of the level may use, rows by node."""
        k = min(predictors, self.forest.tried or max(1, math.isqrt(predictors)))
        return np.stack([np.random.default_rng([self.forest.seed, self.number, node]).permutation(predictors)[:k] for node in self.level])


def _best(sums: np.ndarray, text: bool, min_rows: int) -> tuple[float, int, float, float]:
    """Decrease of Gini impurity (in rows), bin, and the shares of ones on both sides, of the best split of
    one predictor with sums (rows, ones) by bin; the decrease is 0 where nothing can be split."""
    n, ones = sums.astype(float)
    left, left_ones = (n, ones) if text else (np.cumsum(n), np.cumsum(ones))
    right, right_ones = n.sum() - left, ones.sum() - left_ones
    impurity = lambda n, k: 2 * k * (n - k) / np.maximum(n, 1)
    gain = impurity(n.sum(), ones.sum()) - impurity(left, left_ones) - impurity(right, right_ones)
    gain[np.minimum(left, right) < max(1, min_rows)] = 0
    at = int(np.argmax(np.round(gain, 9)))
    return float(gain[at]), at, float(left_ones[at] / max(left[at], 1)), float(right_ones[at] / max(right[at], 1))


def _grow_level(table: DataFrame, texts: np.ndarray, trees: list[Growing]) -> None:
    """Split the nodes of all trees' levels: counts by (tree, node, predictor) are summed by key, and only
    the best split of each comes to the driver. Nodes with rows of one kind stay leaves."""
    width, bins = len(texts), BINS + 1
    key_fields = "tree int, node int, predictor int"
    tried = [t.tried(width) if t.level else np.zeros((0, 1), int) for t in trees]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, of.shape[1], len(of), bins)) for of in tried]  # rows and ones by try, node and bin
        for batch in together(batches):
            codes, y, keys = _matrix(batch, width), batch.column("y").to_numpy(), batch.column("key").to_numpy()
            mixed, flat, packed = _scramble(keys.view(np.uint64)), codes.ravel(), 1.0 + y * PACKED
            seen: dict[tuple, np.ndarray] = {}  # rows outside a fold
            for t, of, total in zip(trees, tried, sums):
                if not t.level:
                    continue
                name = (t.forest.seed, t.forest.folds, t.forest.repeat, t.forest.fold)
                if name not in seen:
                    seen[name] = np.flatnonzero(fold_of(keys, t.forest) != t.forest.fold) if t.forest.fold >= 0 else np.arange(len(keys))
                words = _bag_words(mixed[seen[name]], t.forest, t.number)
                bag = words >= FROM[0]
                rows, weight = seen[name][bag], _times(words[bag])
                place = np.full(len(t.tree.predictor), -1)
                place[t.level] = np.arange(len(t.level))
                node = place[t.tree.nodes_of(codes[rows], texts)]
                if t.depth:
                    there = node >= 0
                    rows, node, weight = rows[there], node[there], weight[there]
                weight = weight * packed[rows]
                start = rows * width
                for k in range(of.shape[1]):
                    cell = node * bins + flat.take(start + of[:, k].take(node))
                    ones, n = np.divmod(np.bincount(cell, weight, total[0, k].size), PACKED)
                    total[0, k] += n.reshape(total[0, k].shape)
                    total[1, k] += ones.reshape(total[1, k].shape)
        found = [(k, n, int(of[n, p]), total[:, p, n].astype(np.int64).tobytes()) for k, (of, total) in enumerate(zip(tried, sums)) for p, n in zip(*np.nonzero(total[0].any(-1)))]
        yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.int32()) for i in range(3)), pa.array([f[3] for f in found], pa.binary())], names=["tree", "node", "predictor", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            *key, blobs = (c.to_pylist() for c in batch.columns)
            for k, blob in zip(zip(*key), blobs):
                x = np.frombuffer(blob, np.int64).reshape(2, bins)
                sums[k] = sums[k] + x if k in sums else x
        best = [(*k, x[0].sum(), x[1].sum(), *_best(x, bool(texts[k[2]]), trees[k[0]].forest.min_rows)) for k, x in sums.items()]
        types = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.float64(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in best], t) for i, t in enumerate(types)], names=[f.split()[0] for f in out_fields.split(", ")])

    out_fields = f"{key_fields}, rows long, ones long, gain double, at int, left double, right double"
    counted = table.mapInArrow(count, f"{key_fields}, sums binary").repartition("tree", "node", "predictor")
    found: dict[tuple, tuple] = {}
    for tree, node, predictor, rows, ones, gain, at, left, right in zip(*(c.to_pylist() for c in counted.mapInArrow(choose, out_fields).toArrow().columns)):
        candidate = (round(-gain, 9), predictor, at, left, right, ones / rows)
        if (tree, node) not in found or candidate < found[tree, node]:
            found[tree, node] = candidate
    for k, t in enumerate(trees):
        following = []
        for n, node in enumerate(t.level):
            gain, predictor, at, left, right, share = found.get((k, n), (0.0, 0, 0, 0.0, 0.0, 0.0))
            if not node:
                t.tree.value[0] = share
            if gain < 0:
                children = t.tree.split(node, predictor, at)
                t.tree.value[children[0]], t.tree.value[children[1]] = left, right
                following += [c for c, s in zip(children, (left, right)) if 0 < s < 1]
        t.depth += 1
        t.level = following if t.depth < t.forest.max_depth else []


def grow(table: DataFrame, binning: Binning, forests: list[Forest], parallelism: int = 2) -> list[list[Tree]]:
    """The trees of each forest, grown on table (see boosting.binned; y is 0 or 1). Batches of TREES_AT_ONCE
    trees are jobs of their own, `parallelism` at a time, each in its scheduler pool. A leaf's value is the
    share of ones in it."""
    trees = [Growing(f, number) for f in forests for number in range(f.trees)]
    context = table.sparkSession.sparkContext

    def run(n: int) -> None:
        context.setLocalProperty("spark.scheduler.pool", f"trees-{n % parallelism}")
        some = trees[n * TREES_AT_ONCE : (n + 1) * TREES_AT_ONCE]
        while any(t.level for t in some):
            _grow_level(table, binning.texts, some)

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(inheritable_thread_target(table.sparkSession)(run), range(math.ceil(len(trees) / TREES_AT_ONCE))))
    out, at = [], 0
    for f in forests:
        out.append([t.tree for t in trees[at : at + f.trees]])
        at += f.trees
    return out


def votes_of(tree: Tree, bins: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """1 where the tree calls a row a one: more than half of its leaf are ones."""
    return (tree.values_of(bins, texts) > 0.5).astype(int)


@dataclass
class FittedForest:
    binning: Binning
    forest: Forest
    trees: list[Tree]
    key: str

    def votes(self, df: DataFrame, out_of_bag: bool = False) -> DataFrame:
        """df with `votes`, the share of trees that call the row a one, and `trees`, how many voted; only
        those whose bag didn't hold it if out_of_bag (votes null where there is none)."""
        model = self

        @pandas_udf("votes double, trees int")
        def vote(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows.pop("key").to_numpy(np.int64)
            codes = model.binning.of([pa.array(rows[c], from_pandas=True) for c in rows])
            n, yes, mixed = np.zeros(len(keys), int), np.zeros(len(keys), int), _scramble(keys.view(np.uint64))
            for number, tree in enumerate(model.trees):
                rows = np.flatnonzero(_bag_words(mixed, model.forest, number) < FROM[0]) if out_of_bag else np.arange(len(keys))
                n[rows] += 1
                yes[rows] += votes_of(tree, codes[rows], model.binning.texts)
            return pd.DataFrame({"votes": yes / np.maximum(n, 1), "trees": n.astype(np.int32)})

        voted = df.withColumn("__v", vote(F.struct(F.xxhash64(self.key).alias("key"), *self.binning.columns())))
        votes = F.when(F.col("__v.trees") > 0, F.col("__v.votes"))
        return voted.select(*df.columns, votes.alias("votes"), F.col("__v.trees").alias("trees"))


def fit(df: DataFrame, predictors: list[str], label: str, key: str, forest: Forest = Forest(), parallelism: int = 2) -> FittedForest:
    """A forest of the label (0 or 1; null: left out)."""
    table, binning = binned(df, predictors, label, key)
    try:
        return FittedForest(binning, forest, grow(table, binning, [forest], parallelism)[0], key)
    finally:
        release(table)


def repeated_cv(df: DataFrame, predictors: list[str], label: str, key: str, tried: list[int], folds: int = 5, repeats: int = 1, forest: Forest = Forest(), cutoff: float = 0.5, parallelism: int = 2) -> DataFrame:
    """tried, repeat, fold, rows, auc, sensitivity, specificity: for each number of predictors tried a split,
    repeat and fold, how a forest that didn't see the fold calls its rows. Metrics without cases are null."""
    table, binning = binned(df, predictors, label, key)
    specs = [replace(forest, tried=k, folds=folds, repeat=r, fold=f) for k in tried for r in range(repeats) for f in range(folds)]
    fitted = grow(table, binning, specs, parallelism)
    width, texts = len(predictors), binning.texts

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(specs), forest.trees + 1, 2), np.int64)
        for batch in together(batches):
            codes, y, keys = _matrix(batch, width), batch.column("y").to_numpy().astype(int), batch.column("key").to_numpy()
            folds = {spec.repeat: fold_of(keys, spec) for spec in specs}
            for s, (spec, trees) in enumerate(zip(specs, fitted)):
                at = np.flatnonzero(folds[spec.repeat] == spec.fold)
                unseen = codes[at]
                yes = sum((votes_of(t, unseen, texts) for t in trees), start=np.zeros(len(at), int))
                np.add.at(cells[s], (yes, y[at]), 1)
        s, yes, y = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(yes, pa.int32()), pa.array(y, pa.int32()), pa.array(cells[s, yes, y])], names=["spec", "yes", "y", "n"])

    counts = table.mapInArrow(judge, "spec int, yes int, y int, n long").groupBy("spec", "yes").agg(*(F.sum(F.when(F.col("y") == v, F.col("n")).otherwise(0)).alias(c) for v, c in ((1, "p"), (0, "q"))))
    above = F.sum("p").over(W.partitionBy("spec").orderBy("yes").rowsBetween(1, W.unboundedFollowing))  # trees + 1 rows a forest
    ranked = counts.withColumns({"above": F.coalesce(above, F.lit(0)), "called": F.col("yes") > cutoff * forest.trees})
    p, q = F.sum("p"), F.sum("q")
    metrics = ranked.groupBy("spec").agg(
        (p + q).alias("rows"),
        F.try_divide(F.sum(F.col("q") * (F.col("above") + F.col("p") / 2)), p.cast("double") * q).alias("auc"),
        F.try_divide(F.sum(F.when(F.col("called"), F.col("p")).otherwise(0)), p).alias("sensitivity"),
        F.try_divide(F.sum(F.when(~F.col("called"), F.col("q")).otherwise(0)), q).alias("specificity"),
    )
    found = [(specs[r["spec"]].tried, specs[r["spec"]].repeat, specs[r["spec"]].fold, *list(r)[1:]) for r in metrics.collect()]  # a row a forest
    release(table)
    return df.sparkSession.createDataFrame(found, "tried int, repeat int, fold int, rows long, auc double, sensitivity double, specificity double")
