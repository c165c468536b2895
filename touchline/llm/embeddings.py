"""Near-duplicate embeddings: int8 tile products with proven error bounds, then full precision."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_groups
from .graph import connected_components
from .select import join_counted

#: Vectors of a tile; a tile product looks at TILE x TILE pairs.
TILE = 4096
#: Rows of a product held at once, and pairs recomputed at once.
ROWS, PAIRS = 1024, 100_000
#: Components multiplied at once: sums of 1024 products of two int8 codes are exact in float32.
PART = 1024
#: More than rounding adds to a bound: products of codes are exact sums, so only five steps in float32 round.
ROUNDING = 2e-6


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each vector, and at least the length of what the codes leave out."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    codes = np.clip(np.rint(unit / scale[:, None].astype(float)), -127, 127).astype(np.int8)
    left_out = np.linalg.norm(unit - codes * scale[:, None].astype(float), axis=1) + 1e-9
    return codes, scale, np.nextafter(left_out.astype(np.float32), np.float32(np.inf))


def _products_of(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes: whole numbers, exact in float32 up to PART components, then float64."""
    if one.shape[1] <= PART:
        return one.astype(np.float32) @ other.astype(np.float32).T
    return sum((_products_of(one[:, at : at + PART], other[:, at : at + PART]).astype(float) for at in range(0, one.shape[1], PART)), start=0.0)


def possible_links(one: tuple, other: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of quantised unit vectors whose cosine may reach threshold; i < j if same.

    With u = s q + e and v = t r + f, the product u v differs from s t q r by |e| + |f| + |e| |f| at most,
    whatever the dimension.
    """
    (q, s, e), (r, t, f) = one, other
    for begin in range(0, len(q), ROWS):
        rows = slice(begin, begin + ROWS)
        most = _products_of(q[rows], r)
        most *= s[rows, None]
        most *= t
        most += e[rows, None] * (1 + f)
        most += f
        i, j = np.nonzero(most >= threshold - ROUNDING)
        i += begin
        yield (i[i < j], j[i < j]) if same else (i, j)


def links_between(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of x, j of y) with cosine >= threshold, some at a time; i < j if x is y.

    Pairs that the int8 bound puts below the threshold are passed over; the others are computed in
    double precision.
    """
    lx, ly = (np.linalg.norm(v, axis=1) for v in (x, y))
    for i, j in possible_links(quantise(_units(x)), quantise(_units(y)), threshold, same):
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            yes = np.einsum("ij,ij->i", x[a], y[b]) / (lx[a] * ly[b]) >= threshold
            if yes.any():
                yield a[yes], b[yes]


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (each element's root) after joining each a with its b; the smaller root stays."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]


def scaled(x: np.ndarray) -> np.ndarray:
    """x times a power of two that brings its largest component near 1: squares neither overflow nor
    vanish, and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max())[1])


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, digest, dim, vector (bytes of scaled components, float32 where that is exact) of every
    row; digest null if it can't be linked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, dims, blobs = [], [], []
            for v in batch.column("embedding"):
                values = v.values
                x = np.asarray(values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid and len(values) and not values.null_count else None
                if x is None or not np.isfinite(x).all() or not x.any():
                    digests.append(None), dims.append(None), blobs.append(None)
                else:
                    x = x + 0.0  # -0.0 is 0.0
                    small = scaled(x).astype(np.float32)
                    digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest()), dims.append(len(x))
                    blobs.append((small if (small == scaled(x)).all() else scaled(x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "digest", "dim", "vector"])

    embedding = F.col("embedding").cast("array<double>").alias("embedding")
    return rows.select("vec_id", embedding).mapInArrow(read, "vec_id long, digest binary, dim int, vector binary")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of float64."""
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in blobs]).astype(np.float64)


def _tiles(classes: DataFrame) -> DataFrame:
    """One row for each tile (dim, tile): digests, codes, scales and bounds of its classes, as bytes."""
    counts = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"), F.count(F.lit(1)).alias("rows"))
    dealt = join_counted(classes.select("dim", "digest", "vector"), counts, "dim", "rows", classes.count()).withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["dim", "tile"]):
            dim, tile = (t.column(c).to_numpy() for c in ("dim", "tile"))
            bounds = np.append(np.flatnonzero(np.diff(tile, prepend=-1) | np.diff(dim, prepend=-1)), len(t))
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                rows = t.slice(begin, end - begin)
                parts = quantise(_units(_matrix(rows.column("vector").to_pylist(), int(dim[begin]))))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c).combine_chunks()[:1] for c in ("dim", "tile", "tiles")]
                    + [pa.array([b"".join(rows.column("digest").to_pylist())], pa.binary())]
                    + [pa.array([p.tobytes()], pa.binary()) for p in parts],
                    names=["dim", "tile", "tiles", "digests", "codes", "scales", "left_out"],
                )

    dealt = dealt.select("dim", "tile", "tiles", "digest", "vector")
    return dealt.repartition("dim", "tile").sortWithinPartitions("dim", "tile").mapInArrow(pack, "dim int, tile long, tiles long, digests binary, codes binary, scales binary, left_out binary")


def _candidates(tiles: DataFrame, threshold: float) -> DataFrame:
    """dim, i, j, tile, digest: for each pair of tiles, the classes that may be linked in it."""
    other = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))).alias("p")
    blobs = ["digests", "codes", "scales", "left_out"]
    pairs = tiles.select("dim", "tile", *blobs, other).select("dim", "p.i", "p.j", "tile", *blobs)

    def parts(row: dict) -> tuple:
        return np.frombuffer(row["codes"], np.int8).reshape(-1, row["dim"]), np.frombuffer(row["scales"], np.float32), np.frombuffer(row["left_out"], np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs_of_tiles(batches):
            same = len(pair) == 1
            found = [np.zeros(len(p["scales"]) // 4, bool) for p in pair]
            for a, b in possible_links(parts(pair[0]), parts(pair[-1]), threshold, same):
                found[0][a] = True
                found[-1][b] = True
            for p, hits in zip(pair, found):
                at = np.flatnonzero(hits).tolist()
                digests = [p["digests"][16 * k : 16 * k + 16] for k in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["dim"]] * len(at), pa.int32()), *(pa.array([p[c]] * len(at), pa.int64()) for c in ("i", "j", "tile")), pa.array(digests, pa.binary())], names=["dim", "i", "j", "tile", "digest"]
                )

    dealt = pairs.repartition("dim", "i", "j").sortWithinPartitions("dim", "i", "j", "tile")
    return dealt.mapInArrow(multiply, "dim int, i long, j long, tile long, digest binary")


def _pairs_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (dim, i, j): one tile with itself, or two; pairs with an empty tile are passed over."""
    for t in whole_groups(batches, ["dim", "i", "j"]):
        held: list[dict] = []
        for k in range(len(t)):
            row = t.slice(k, 1).to_pylist()[0]
            if row["i"] == row["j"]:
                yield [row]
            elif held and all(held[0][c] == row[c] for c in ("dim", "i", "j")):
                yield [held.pop(), row]
            else:
                held = [row]


def _links(candidates: DataFrame, threshold: float) -> DataFrame:
    """For each pair of tiles and class that is linked in it: digest, n_links, root. candidates: dim, i,
    j, tile, digest, vector, n."""
    keys = ["dim", "i", "j"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            new = np.zeros(len(t), bool)
            for k in keys:
                c = t.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            new[:1] = True
            bounds = np.append(np.flatnonzero(new), len(t)).tolist()
            for begin, end in zip(bounds[:-1], bounds[1:]):
                rows = t.slice(begin, end - begin)
                names, sizes, tile = rows.column("digest").to_pylist(), rows.column("n").to_numpy().astype(np.int64), rows.column("tile").to_numpy()
                v = _matrix(rows.column("vector").to_pylist(), int(rows.column("dim")[0].as_py()))
                same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
                cut = 0 if same else int(np.searchsorted(tile, tile[0], "right"))
                n_links, parent = np.zeros(len(names), np.int64), np.arange(len(names))
                for a, b in links_between(v[: cut or None], v[cut:], threshold, same) if cut < len(names) else ():
                    b = b + cut
                    n_links += np.bincount(a, sizes[b], len(sizes)).astype(np.int64) + np.bincount(b, sizes[a], len(sizes)).astype(np.int64)
                    parent = hook(parent, a, b)
                at = np.flatnonzero(n_links)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in at], pa.binary()), pa.array(n_links[at]), pa.array([names[k] for k in parent[at]], pa.binary())], names=["digest", "n_links", "root"])

    return candidates.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, "tile").mapInArrow(link, "digest binary, n_links long, root binary")


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of rows (vec_id, embedding).

    1. Equal vectors become one class. Classes are dealt into tiles of about TILE.
    2. Every pair of tiles meets once, as int8 codes with a scale and an error bound for each vector; it
       names the classes that may reach the threshold with some other.
    3. Only those meet again in full precision, pair of tiles by pair of tiles, and links are found by
       cosines in double precision. A pair of tiles reports counts and the roots of what it joined,
       never pairs.

    All pairs are looked at, so the work grows with the square of the number of classes; memory does
    not. Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different dimension. Rows that share a vec_id count each. A null vec_id is never
    kept.
    """
    vectors = materialize(_vectors(rows))
    classes = vectors.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.any_value("dim").alias("dim"), F.any_value("vector").alias("vector"))
    classes = materialize(classes)
    candidates = _candidates(materialize(_tiles(classes)), threshold).join(classes.select("digest", "vector", "n"), "digest")
    found = materialize(_links(candidates, threshold))
    links = found.groupBy("digest").agg(F.sum("n_links").alias("others"))
    parts = connected_components(found, "digest", "root").select(F.col("node").alias("digest"), "component")
    placed = classes.select("digest", "vec_id", "n").join(links, "digest", "left").join(parts, "digest", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "digest")))
    smallest = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    placed = join_counted(placed.drop("vec_id"), smallest, "component", "classes", placed.count())
    placed = materialize(placed.select("digest", "component_id", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    out = join_counted(vectors.select("vec_id", "digest"), placed, "digest", "n", vectors.count(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
