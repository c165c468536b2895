"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize
from .select import first_until, unit_interval

#: Buckets of the character trigrams; two more count whether a word repeats the one before.
GRAMS = 1 << 15
BUCKETS = GRAMS + 2
#: Target documents that the target model is counted from, at most.
TARGET = 5000
SMOOTHING = 1.0
#: Characters that are counted at once.
PIECE = 1 << 20


def bucket_counts(text: str | None) -> np.ndarray:
    """Counts of a whole text's trigrams and of its words that do, and do not, repeat the one before."""
    counts = np.zeros(BUCKETS, np.int64)
    if text:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, max(0, len(codes) - 2), PIECE):
            c = codes[at : at + PIECE + 2].astype(np.uint64)
            h = ((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]) * np.uint64(0x9E3779B97F4A7C15)
            counts[:GRAMS] += np.bincount((h >> np.uint64(49)).astype(np.int64), minlength=GRAMS)
        words = text.split()
        counts[GRAMS] = sum(map(eq, words[1:], words))
        counts[GRAMS + 1] = max(0, len(words) - 1) - counts[GRAMS]
    return counts


def _count(docs: DataFrame) -> DataFrame:
    """bucket, raw, target: counts over all rows of docs (text, target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
                counts = bucket_counts(text)
                raw += counts
                if is_target:
                    target += counts
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return docs.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target share / raw share) of each bucket, within the trigrams and within the repeats."""
    out = np.zeros(BUCKETS)
    if target.sum():
        for part in (slice(0, GRAMS), slice(GRAMS, BUCKETS)):
            t, r = target[part] + SMOOTHING, raw[part] + SMOOTHING
            out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def fit_ratio(docs: DataFrame, labels: DataFrame, target: int = TARGET) -> tuple[np.ndarray, float]:
    """Log ratios by bucket, and the share of labelled documents that are target (1.0 without labels).

    docs (doc_id, text), all of which make the raw model; labels (doc_id, quality), quality 1 being
    target. The target model is counted from at most `target` documents, those with the smallest
    hashes of doc_id. BUCKETS sums come to the driver.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    # at most `target` ids, so this side may be broadcast
    wanted = materialize(known.filter("quality > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target).select("doc_id", F.lit(True).alias("target")))
    flagged = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left").select("text", "target")
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in _count(flagged).collect():
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["target"]
    return log_ratios(raw, good), 1.0 if share is None else share


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """All columns of docs, and log_weight double: the log of target over raw probability of the
    text. Null and empty texts weigh 0."""
    docs = docs.drop("log_weight")
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [float(bucket_counts(t) @ held.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=[*batch.schema.names, "log_weight"])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, *StructType.fromDDL("log_weight double").fields]))


def gumbel_top(weighted: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """weighted (doc_id, log_weight) with gumbel_key and kept: the k rows with the largest sums of
    log weight and Gumbel noise are a sample without replacement by weight.

    The noise is a hash of seed and doc_id. Ties go by doc_id. No step sorts all rows.
    """
    noise: Column = -F.log(-F.log(unit_interval(F.lit(seed), F.col("doc_id"))))
    keyed = materialize(weighted.withColumn("gumbel_key", F.col("log_weight") + noise))
    spread = keyed.agg(F.avg("gumbel_key").alias("mean"), F.stddev_pop("gumbel_key").alias("sd")).first()
    if spread["mean"] is None:
        return keyed.withColumn("kept", F.lit(True))
    # the arc tangent puts the largest keys first and keeps their order in (0, 1)
    rank = 0.5 - F.atan((F.col("gumbel_key") - spread["mean"]) / max(spread["sd"], 1e-9) * 4) / math.pi
    ranked = keyed.withColumn("rank", F.least(F.lit(1.0), F.greatest(F.lit(0.0), rank))).withColumn("one", F.lit(1))
    limit = weighted.sparkSession.createDataFrame([(float(k),)], "k double")
    return first_until(ranked, [], "rank", "one", limit, "k", ["doc_id"], "kept").drop("rank", "one")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 42) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept: one row per row of docs (doc_id, text).

    Keeps `share` of the documents, by default the share of target documents among those labelled.
    """
    ratios, labelled = fit_ratio(docs, labels)
    weighted = materialize(weigh(docs.select("doc_id", "text"), ratios).select("doc_id", "log_weight"))
    return gumbel_top(weighted, round(weighted.count() * (labelled if share is None else share)), seed)
