"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .select import first_until, join_group, unit_interval

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: No source and no document is taken more often than this.
MAX_COPIES = 3


def word_count(column: str) -> Column:
    """Words of a text, 0 if it is null: each word becomes one letter, and white space goes, so no list
    of words is made."""
    letters = F.regexp_replace(F.regexp_replace(column, WORD, "w"), SPACE, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size long, target double, one row per source of sizes (source, size).

    Sources in code-point order, null last, get the weights in turn. The targets share the sum of
    all sizes by weight; a target above max_copies times its source's size stops there and the
    excess is shared by weight among the others, until none is above. Only two sums come to the
    driver in each round; every round stops at least one more source. Sources without words get 0.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((order - 1) % len(weights) + 1).cast("int"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    sources = materialize(sources.withColumn("most", F.col("source_size") * float(max_copies)), 1)
    level, held = 0.0, -1
    while True:
        stopped = F.col("most") <= F.col("weight") * level
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(stopped, F.col("most")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(stopped).alias("stopped"),
        ).first()
        if row["stopped"] == held or not row["weight"]:
            break
        held, level = row["stopped"], ((row["all"] or 0) - row["fixed"]) / row["weight"]
    return sources.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_copies: int = MAX_COPIES,
    importance: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target,
    copies, taken.

    A document's expected copies are its source's target over the source's size (times its
    `importance` over the source's mean by words, where that column is given), max_copies at most.
    The whole part is taken for certain. What is left of the target is drawn: documents are ranked
    by Pareto order sampling, the odds of a random number over the odds of the fractional part, and
    taken from the front until the words come nearest to the target; those without a fractional part
    take no part in it. The random numbers are hashes
    of seed and doc_id, so reruns agree.

    Null and empty texts have size 0 and take nothing. Rows that share a doc_id are ranked by text
    size. A null source is a source of its own.
    """
    extra = [F.coalesce(F.col(importance).cast("double"), F.lit(0.0))] if importance else [F.lit(1.0)]
    sizes = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), extra[0].alias("importance")))
    targets = source_targets(sizes, weights, max_copies)
    mean = sizes.groupBy("source").agg(F.try_divide(F.sum(F.col("importance") * F.col("size")), F.sum("size").cast("double")).alias("mean"))
    targets = targets.join(mean, targets["source"].eqNullSafe(mean["source"])).drop(mean["source"]).withColumnRenamed("source", "of")
    keyed = join_group(sizes, targets, {"source": "of"}, "doc_id")
    expected = F.least(F.lit(float(max_copies)), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) * F.coalesce(F.try_divide("importance", "mean"), F.lit(0.0)))
    u = unit_interval(F.lit(seed), F.col("doc_id"))
    keyed = keyed.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.col("whole"))
    # odds of u over odds of part, put into [0, 1] by x / (1 + x), which keeps the order
    up, down = u * (1 - F.col("part")), (1 - u) * F.col("part")
    keyed = keyed.withColumn("rank", F.when(F.col("part") > 0, up / (up + down)))
    ranked = materialize(keyed.select("doc_id", "source", "size", "source_size", "target", "whole", "part", "rank"))
    left = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
    drawn = first_until(ranked.filter("part > 0"), ["source"], "rank", "size", left, "left", ["doc_id", "size"], "drawn")
    drawn = drawn.unionByName(ranked.filter("part = 0").withColumn("drawn", F.lit(False)))
    copies = F.least(F.lit(max_copies), F.col("whole") + F.col("drawn").cast("long")).cast("long")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
