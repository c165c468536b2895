"""Hard negatives: product-quantised scores with error bounds from residual norms, then exact integers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .select import join_counted

#: Components of a subspace, centroids of each, rounds of k-means.
WIDTH, CENTROIDS, ROUNDS = 4, 256, 6
#: Components of the vectors that codebooks are fitted on, all together, and vectors at most.
SAMPLE_COMPONENTS, SAMPLE = 1 << 21, 8192
#: Anchors of a block, rows of a segment; a table of rows is dealt into FEW_SEGMENTS where it has rows enough for them.
ANCHORS, SEGMENT, FEW_SEGMENTS, FEW_ROWS = 1 << 16, 1 << 20, 24, 1024
#: Rows and anchors that meet at once in a task.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4096, 512
#: Scores stay below this, so 95 times a score is a long.
LARGEST_SCORE = 1 << 56
#: Integers up to here are exact as doubles.
EXACT = 1 << 53


def largest_code(dim: int) -> int:
    """Codes up to this keep every score of dim components below LARGEST_SCORE."""
    return min(2**31 - 1, math.isqrt(LARGEST_SCORE // max(1, dim)))


def _coded(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, dim, vector (bytes of int32 codes floor(scale * x)) of the rows that take part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, blobs = [], [], []
            for k, v in enumerate(batch.column("embedding")):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64))
                if np.isfinite(x).all() and (np.abs(x) <= largest_code(len(x))).all():
                    at.append(k), dims.append(len(x)), blobs.append(x.astype(np.int32).tobytes())
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "label", "dim", "vector"])

    some = rows.filter("vec_id is not null and label is not null and embedding is not null")
    return some.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(read, "vec_id long, label long, dim int, vector binary")


# --- product quantisation


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(1) - 2 * x @ centroids.T, axis=1)


def fit_codebooks(sample: list[np.ndarray]) -> list[np.ndarray]:
    """For each subspace of WIDTH components (the last may have fewer), at most CENTROIDS centroids:
    k-means from evenly spaced vectors, on those of the sample that have these components."""
    books = []
    for begin in range(0, max(map(len, sample), default=0), WIDTH):
        x = [v[begin : begin + WIDTH] for v in sample if len(v) >= begin + WIDTH] or [v[begin : begin + WIDTH] for v in sample if len(v) > begin]
        width = max(map(len, x))
        x = np.stack([v for v in x if len(v) == width]).astype(float)
        centroids = np.unique(x, axis=0)
        centroids = centroids[np.linspace(0, len(centroids) - 1, min(CENTROIDS, len(centroids))).astype(int)]
        for _ in range(ROUNDS):
            near = _nearest(x, centroids)
            n = np.bincount(near, minlength=len(centroids))
            sums = np.stack([np.bincount(near, x[:, c], len(centroids)) for c in range(width)], axis=1)
            centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        books.append(centroids)
    return books


def quantise(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """uint8 codes of each subspace that the books know and these vectors have, and at least the length of
    what the centroids leave out, components beyond the books included."""
    x, dim = vectors.astype(float), vectors.shape[1]
    books = books_of(books, dim)
    codes = np.empty((len(x), len(books)), np.uint8)
    left = x.copy()
    for m, book in enumerate(books):
        part = slice(m * WIDTH, m * WIDTH + book.shape[1])
        codes[:, m] = _nearest(x[:, part], book)
        left[:, part] -= book[codes[:, m]]
    norms = np.sqrt((left * left).sum(1)) * (1 + 1e-6) + 1e-6
    return codes, np.nextafter(norms.astype(np.float32), np.float32(np.inf))


def books_of(books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The first books, whose subspaces vectors of dim components have whole."""
    return [b for m, b in enumerate(books) if m * WIDTH + b.shape[1] <= dim]


@dataclass
class Tables:
    """Lookup tables of some anchors: products with every centroid, by subspace, and what bounds need."""

    products: list[np.ndarray]
    lengths: np.ndarray  #: of the anchors
    rounding: np.ndarray  #: at least what float32 adds to a score of the tables

    @staticmethod
    def of(anchors: np.ndarray, books: list[np.ndarray]) -> Tables:
        q = anchors.astype(float)
        books = books_of(books, q.shape[1])
        products = [(b @ q[:, m * WIDTH : m * WIDTH + b.shape[1]].T).astype(np.float32) for m, b in enumerate(books)]
        largest = sum((np.abs(p).max(0).astype(float) for p in products), start=np.zeros(len(q)))
        lengths = np.sqrt((q * q).sum(1)) * (1 + 1e-6)
        return Tables(products, lengths, largest * (len(products) + 2) * 2.0**-23 + 1e-3)

    def bounds(self, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score by the tables and the largest possible error, rows x anchors: with x = c + r, the score
        a x lies within |a| |r| of a c."""
        about = np.zeros((len(codes), len(self.lengths)), np.float32)
        for m, p in enumerate(self.products):
            about += p[codes[:, m]]
        error = norms[:, None] * self.lengths.astype(np.float32)
        error *= np.float32(1 + 1e-5)
        error += (self.rounding * (1 + 1e-5)).astype(np.float32)
        return about, error


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, rows of x by rows of y, as int64."""
    if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < EXACT:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


class Best:
    """The first k rows (score descending, then id) of each slot, among those whose score lies from the
    slot's low to its high. Slots belong to anchors; a slot has arrays low and high."""

    EMPTY = np.iinfo(np.int64).min

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, anchors: int) -> None:
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.score = np.full((len(anchor), k), self.EMPTY)
        self.id = np.zeros((len(anchor), k), np.int64)
        self.slots = np.bincount(anchor, minlength=anchors)
        self.first = np.concatenate([[0], np.cumsum(self.slots)])[:-1]  # slots are ordered by anchor

    def interval(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For anchors begin to end: a row can enter some slot only with a score from .. to .."""
        need = np.maximum(self.low, self.score[:, -1])
        least, most = np.full(end - begin, np.inf), np.full(end - begin, -np.inf)
        mine = slice(*np.searchsorted(self.anchor, [begin, end]))
        np.minimum.at(least, self.anchor[mine] - begin, need[mine].astype(float))
        np.maximum.at(most, self.anchor[mine] - begin, self.high[mine].astype(float))
        return least, most

    def take(self, anchor: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Rows with their exact scores, for the anchors that they belong to."""
        n = self.slots[anchor]
        slot = np.repeat(self.first[anchor], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        score, row = np.repeat(score, n), np.repeat(row, n)
        yes = (score >= np.maximum(self.low[slot], self.score[slot, -1])) & (score <= self.high[slot])
        slot, score, row = slot[yes], score[yes], row[yes]
        touched = np.unique(slot)
        full = self.score[touched] > self.EMPTY
        slot = np.concatenate([slot, np.repeat(touched, full.sum(1))])
        score = np.concatenate([score, self.score[touched][full]])
        row = np.concatenate([row, self.id[touched][full]])
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.score[touched] = self.EMPTY
        self.score[slot[keep], rank[keep]] = score[keep]
        self.id[slot[keep], rank[keep]] = row[keep]


@dataclass
class Rows:
    """Some rows of a group: ids, labels, int codes of components, quantised codes, residual norms."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    codes: np.ndarray
    norms: np.ndarray


def meet(best: Best, anchors: Rows, rows: Rows, books: list[np.ndarray], same_label: bool) -> None:
    """Show rows to the anchors' slots. Bounds by lookup tables leave out rows that can't enter any of an
    anchor's slots; the scores of the others are computed exactly."""
    for begin in range(0, len(anchors.id), ANCHORS_AT_ONCE):
        some = slice(begin, min(begin + ANCHORS_AT_ONCE, len(anchors.id)))
        about, error = Tables.of(anchors.vector[some], books).bounds(rows.codes, rows.norms)
        least, most = best.interval(some.start, some.stop)
        # thresholds as float32, moved outwards by more than rounding
        outwards = lambda t, sign: np.where(np.isfinite(t), t + sign * (np.abs(t) * 1e-6 + 1e-3), t).astype(np.float32)
        wanted = rows.label[:, None] == anchors.label[some]
        possible = wanted if same_label else ~wanted
        possible &= rows.id[:, None] != anchors.id[some]
        possible &= about + error >= outwards(least, -1)
        about -= error
        possible &= about <= outwards(most, 1)
        i, j = np.nonzero(possible)
        if not len(i):
            continue
        if len(i) > possible.size // 32:
            scores = products(rows.vector, anchors.vector[some])[i, j]
        else:
            scores = np.einsum("ij,ij->i", rows.vector[i].astype(np.int64), anchors.vector[some][j].astype(np.int64))
        best.take(j + begin, scores, rows.id[i])


# --- blocks of anchors against segments of rows


def _parts(codes: DataFrame, of: list[Column], anchors: DataFrame, books) -> DataFrame:
    """Anchors (kind 0) and rows (kind 1) dealt into groups (part, block, segment): every anchor of a
    part meets each row of it once. The part is given by the columns of; anchors has aid, vec_id, label,
    dim, vector, low, high (arrays)."""
    part = F.concat_ws(":", *(c.cast("string") for c in of))
    rows = codes.withColumn("part", part)
    asking = anchors.withColumn("part", part)
    blocks = asking.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("blocks"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).join(blocks, "part")
    segments = F.greatest(F.ceil(F.col("rows") / SEGMENT), F.least(F.lit(FEW_SEGMENTS), F.ceil(F.col("rows") / FEW_ROWS)))
    sizes = materialize(sizes.select("part", "rows", "blocks", segments.alias("segments")), 1)
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    empty = lambda kind: F.lit(None).cast(kind)

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = t.column("dim").to_numpy()
            codes, norms = [b""] * len(t), [0.0] * len(t)
            blobs = t.column("vector").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim).tolist()
                c, n = quantise(_matrix([blobs[k] for k in at], dim), books.value)
                for k, row, norm in zip(at, c, n.tolist()):
                    codes[k], norms[k] = row.tobytes(), norm
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(norms, pa.float32())], names=[*batch.schema.names, "codes", "norm"])

    dealt_rows = join_counted(rows, sizes, "part", "rows", total).withColumn("segment", F.pmod(F.xxhash64("vec_id", "vector"), F.col("segments")))
    fields = "vec_id long, label long, dim int, vector binary, part string, blocks long, segment long"
    dealt_rows = dealt_rows.select(*(f.split()[0] for f in fields.split(", "))).mapInArrow(quantised, f"{fields}, codes binary, norm float")
    dealt_rows = dealt_rows.withColumn("block", each("blocks")).select(
        "part", "block", "segment", F.lit(1).alias("kind"), "vec_id", "label", "dim", "vector", "codes", "norm", empty("long").alias("aid"), empty("array<long>").alias("low"), empty("array<long>").alias("high")
    )
    dealt_anchors = join_counted(asking, sizes, "part", "rows", total).withColumn("block", F.pmod(F.xxhash64("aid"), F.col("blocks")))
    dealt_anchors = dealt_anchors.withColumn("segment", each("segments")).select(
        "part", "block", "segment", F.lit(0).alias("kind"), "vec_id", "label", "dim", "vector", empty("binary").alias("codes"), empty("float").alias("norm"), "aid", "low", "high"
    )
    keys = ["part", "block", "segment"]
    return dealt_rows.unionByName(dealt_anchors).repartition(*keys).sortWithinPartitions(*keys, "kind")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int32).reshape(len(blobs), dim)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.Table]]:
    """Key, kind and rows of runs of equal (part, block, segment, kind), at most ROWS_AT_ONCE at a time
    of kind 1; batches are sorted."""
    held: list[pa.Table] = []
    last = None

    def cut(t: pa.Table):
        for begin in range(0, len(t), ROWS_AT_ONCE if last[1] else len(t)):
            yield *last, t.slice(begin, ROWS_AT_ONCE if last[1] else len(t))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        keys = list(zip(*(t.column(c).to_pylist() for c in ("part", "block", "segment")), strict=True))
        names = list(zip(keys, t.column("kind").to_pylist()))
        bounds = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for begin, end in zip(bounds, bounds[1:]):
            if last is not None and (names[begin] != last or (last[1] and sum(map(len, held)) >= ROWS_AT_ONCE)):
                yield from cut(pa.concat_tables(held))
                held = []
            last = names[begin]
            held.append(t.slice(begin, end - begin))
    if held:
        yield from cut(pa.concat_tables(held))


def _best_rows(parts: DataFrame, books, k: int, same_label: bool) -> DataFrame:
    """aid, slot, id, score: for each group and slot of an anchor the first k rows of the group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = anchors = key = aid = None

        def done() -> Iterator[pa.RecordBatch]:
            slot, place = np.nonzero(best.score > Best.EMPTY)
            numbers = np.arange(len(best.anchor)) - best.first[best.anchor]
            columns = [aid[best.anchor[slot]], numbers[slot].astype(np.int32), best.id[slot, place], best.score[slot, place]]
            for at in range(0, len(slot), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["aid", "slot", "id", "score"])

        for now, kind, t in _groups(batches):
            dim = int(t.column("dim")[0].as_py())
            ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            vectors = _matrix(t.column("vector").to_pylist(), dim)
            if kind == 0:
                if best is not None:
                    yield from done()
                low, high = t.column("low").to_pylist(), t.column("high").to_pylist()
                owner = np.repeat(np.arange(len(t)), [len(x) for x in low])
                flat = lambda lists: np.array([v for x in lists for v in x], np.int64)
                best, anchors, key = Best(owner, flat(low), flat(high), k, len(t)), Rows(ids, labels, vectors, None, None), now
                aid = t.column("aid").to_numpy().astype(np.int64)
            elif now == key:
                codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(t), -1)
                meet(best, anchors, Rows(ids, labels, vectors, codes, t.column("norm").to_numpy()), books.value, same_label)
        if best is not None:
            yield from done()

    return parts.mapInArrow(scan, "aid long, slot int, id long, score long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key, with their rank. A key has at most k rows a segment."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, embedding,
    label (a whole number).

    Components x become floor(scale * x); a score is the inner product of such integers, exact. For each
    anchor (a row of which the condition `anchors` is true) and each of its first `positives` other rows
    of its label, the first `negatives` rows of another label whose score is at least low[0] / low[1] and
    at most high[0] / high[1] of the positive's. First: larger score, then smaller vec_id. Windows of
    negative positives' scores are empty.

    Vectors are quantised by subspace (codebooks fitted on at most SAMPLE vectors and SAMPLE_COMPONENTS
    components); the length of what centroids leave out is kept. Blocks of anchors meet segments of rows
    in two passes, rows of the own label for positives, then all for negatives. A task streams a segment's
    rows past a block of anchors, whose best rows so far are all it holds: score by lookup tables, plus or
    minus |anchor| |left out|, shows which rows may still enter; only those are computed. So the result
    is exact whatever the codebooks. Labels may be hot: their rows are dealt over segments.

    No part take rows with a null vec_id, label, vector or component, a component that is not finite, or
    one beyond largest_code(dim) / scale. Rows meet only rows of as many components. Rows with the
    anchor's vec_id are neither positives nor negatives of it. Rows that repeat a vec_id count each as
    candidates; equal anchor rows are one anchor. Without anchors or rows the result is empty.
    """
    spark = rows.sparkSession
    codes = materialize(_coded(rows, scale))
    most = codes.agg(F.max("dim")).first()[0] or 1
    n = max(1, min(SAMPLE, SAMPLE_COMPONENTS // max(1, most)))
    sample = codes.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(n).select("vector").collect()
    books = spark.sparkContext.broadcast(fit_codebooks([np.frombuffer(r["vector"], np.int32) for r in sample]))
    aid = F.xxhash64("vec_id", "label", "vector")
    asking = codes.filter(anchors).select(aid.alias("aid"), "vec_id", "label", "dim", "vector").distinct()
    everything = lambda v: F.array(F.lit(v).cast("long"))
    asking = materialize(asking.withColumns({"low": everything(-LARGEST_SCORE * 2), "high": everything(LARGEST_SCORE * 2)}))
    alike = _best_rows(_parts(codes, [F.col("dim"), F.col("label")], asking, books), books, positives, True)
    alike = materialize(_first(alike, ["aid"], positives).select("aid", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # windows, in order of rank; those that nothing fits are empty intervals
    floor_div = lambda x, by: F.floor(x.cast("decimal(38,0)") / by).cast("long")
    windows = alike.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("windows"))
    at_least = F.transform("windows", lambda w: -floor_div(-w["positive_score"] * low[0], low[1]))
    at_most = F.transform("windows", lambda w: floor_div(w["positive_score"] * high[0], high[1]))
    mining = materialize(asking.drop("low", "high").join(windows, "aid").select("aid", "vec_id", "label", "dim", "vector", at_least.alias("low"), at_most.alias("high")))
    other = _first(_best_rows(_parts(codes, [F.col("dim")], mining, books), books, negatives, False), ["aid", "slot"], negatives)
    out = other.join(alike, ["aid", "slot"]).join(asking.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
