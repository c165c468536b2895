"""Running totals in a global order, and what follows from them, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import keep


def running_totals(rows: DataFrame, order: str, totals: dict[str, str], descending: bool = False, partitions: int | None = None) -> DataFrame:
    """rows, one for each value of `order`, with the sum of the rows up to and with each: for each
    (name, column) of totals a column name.

    Rows are dealt into ranges of `order`; each range is summed by itself and begins at the sum of the
    ranges before it, of which there are as many as partitions.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(order).desc() if descending else F.col(order).asc()
    dealt = keep(rows.repartitionByRange(n, by).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{name}") for name, c in totals.items()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = sums.select(F.col("__range").alias("__its"), *(F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in totals))
    inside = W.partitionBy("__range").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.select("*", *(F.sum(c).over(inside).alias(f"__in_{name}") for name, c in totals.items())).join(starts, F.col("__range") == F.col("__its"))
    return placed.select(*rows.columns, *((F.col(f"__in_{name}") + F.col(f"__{name}")).alias(name) for name in totals))


def roc_curve(df: DataFrame, positive: Column, score: Column, partitions: int | None = None) -> DataFrame:
    """cutoff, positives, negatives, tp, fp, tpr, fpr: for each score, how many rows have it, and how many
    have at least it. Null scores and labels are passed over; rates without cases are null."""
    known = df.select(positive.cast("boolean").alias("y"), score.cast("double").alias("cutoff")).filter("y is not null and cutoff is not null and not isnan(cutoff)")
    counts = known.groupBy((F.col("cutoff") + F.lit(0.0)).alias("cutoff")).agg(F.count_if("y").alias("positives"), F.count_if(~F.col("y")).alias("negatives"))
    curve = running_totals(counts, "cutoff", {"tp": "positives", "fp": "negatives"}, descending=True, partitions=partitions)
    p, n = (curve.select(F.max(c)).scalar() for c in ("tp", "fp"))
    return curve.select("*", F.try_divide(F.col("tp"), p).alias("tpr"), F.try_divide(F.col("fp"), n).alias("fpr"))


def area(curve: DataFrame) -> DataFrame:
    """auc, positives, negatives of a roc_curve: the chance that a positive row's score is larger than a
    negative one's, equal scores counting half. Null without rows of both kinds."""
    below = F.sum(F.col("negatives").cast("double") * (F.col("tp") - F.col("positives") / 2))
    p, n = F.sum("positives"), F.sum("negatives")
    return curve.agg(F.try_divide(below, p.cast("double") * n).alias("auc"), F.coalesce(p, F.lit(0)).alias("positives"), F.coalesce(n, F.lit(0)).alias("negatives"))


def kappa_curve(curve: DataFrame) -> DataFrame:
    """A roc_curve with kappa, the agreement beyond chance of `score at least cutoff` with the label."""
    p, n = (curve.select(F.max(c)).scalar().cast("double") for c in ("tp", "fp"))
    tp, fp, total = F.col("tp"), F.col("fp"), p + n
    agreed = (tp + n - fp) / total
    chance = ((tp + fp) * p + (total - tp - fp) * n) / (total * total)
    return curve.select("*", F.coalesce(F.try_divide(agreed - chance, 1 - chance), F.lit(0.0)).alias("kappa"))


def largest_kappa(curve: DataFrame) -> DataFrame:
    """The row of kappa_curve with the largest kappa (to 12 digits), the smallest cutoff of equals."""
    return kappa_curve(curve).orderBy(F.round("kappa", 12).desc(), "cutoff").limit(1)
