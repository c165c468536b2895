"""How good predictions were: confusion, class reports, errors, curves, losses, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outcome_label(home: Column, away: Column) -> Column:
    """home, away or draw by the strictly larger value; null if one is missing."""
    return F.when(home > away, "home").when(home < away, "away").when(home == away, "draw")


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """actual and a count for each predicted label, for all given labels."""
    counts = df.filter(F.col(actual).isin(labels)).groupBy(F.col(actual).alias("actual")).agg(*(F.count_if(F.col(predicted) == l).alias(f"predicted_{l}") for l in labels))
    every = df.sparkSession.createDataFrame([(l,) for l in labels], "actual string")
    return every.join(counts, "actual", "left").fillna(0)


def classification_report(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """label, precision, recall, f1, support; ratios without cases are 0."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(l).alias("label"), (F.col(actual) == l).alias("a"), (F.col(predicted) == l).alias("p")) for l in labels))).alias("c")).select("c.*")
    sums = cells.groupBy("label").agg(F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if("p").alias("called"), F.count_if("a").alias("support"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = sums.withColumns({"precision": zero(F.try_divide("tp", "called")), "recall": zero(F.try_divide("tp", "support"))})
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support")


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def regression_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """target, mae, rmse, r2, poisson_deviance for each (actual, predicted) of pairs, rows with both."""
    both = [F.struct(F.lit(n).alias("target"), F.col(a).cast("double").alias("y"), F.col(p).cast("double").alias("f")) for n, (a, p) in pairs.items()]
    rows = df.select(F.explode(F.array(*both)).alias("r")).select("r.*").filter("y is not null and f is not null")
    error = F.col("y") - F.col("f")
    return rows.groupBy("target").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.sum(error * error) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"),
        poisson_deviance(F.col("y"), F.col("f")).alias("poisson_deviance"),
    )


def poisson_deviance(actual: Column, predicted: Column, floor: float = 1e-9) -> Column:
    mu = F.greatest(predicted, F.lit(floor))
    return F.avg(2 * (F.when(actual > 0, actual * F.log(actual / mu)).otherwise(0.0) - actual + mu))


def roc_points(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """label, tpr, fpr, auc of hard predictions, one label against the rest: the curve has one point
    besides the corners."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(l).alias("label"), (F.col(actual) == l).alias("a"), (F.col(predicted) == l).alias("p")) for l in labels))).alias("c")).select("c.*")
    sums = cells.groupBy("label").agg(
        F.try_divide(F.count_if(F.col("a") & F.col("p")), F.count_if("a")).alias("tpr"), F.try_divide(F.count_if(~F.col("a") & F.col("p")), F.count_if(~F.col("a"))).alias("fpr")
    )
    return sums.withColumn("auc", (1 + F.col("tpr") - F.col("fpr")) / 2)


def kappa_by_cutoff(df: DataFrame, positive: Column, score: Column, steps: int = 100) -> DataFrame:
    """cutoff_no, cutoff, tp, fp, kappa: agreement beyond chance of `positive` with score >= cutoff,
    for the cutoffs 1 / steps, 2 / steps, ... up to the largest score.

    Scores lie in [0, 1]. Rows are counted by step first, so steps + 1 rows remain at most; null
    scores and labels are passed over.
    """
    rows = df.select(positive.cast("long").alias("y"), F.floor(F.round(score, 9) * steps).alias("step")).filter("y is not null and step is not null")
    every = W.partitionBy()  # over steps + 1 rows
    counts = rows.groupBy("step").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).withColumns({"__n": F.sum("n").over(every), "__p": F.sum("y").over(every)})
    called = counts.filter("step >= 1").withColumn("cutoff_no", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("step"), F.lit(steps - 1).cast("long")))))
    found = called.groupBy("cutoff_no", "__n", "__p").agg(F.sum("y").alias("tp"), F.sum(F.col("n") - F.col("y")).alias("fp"))
    n, p, m = F.col("__n"), F.col("__p"), F.col("tp") + F.col("fp")
    agreed = (F.col("tp") + n - p - F.col("fp")) / n.cast("double")
    chance = (m * p + (n - m) * (n - p)) / (n.cast("double") * n)
    return found.select("cutoff_no", (F.col("cutoff_no") / float(steps)).alias("cutoff"), "tp", "fp", F.coalesce(F.try_divide(agreed - chance, 1 - chance), F.lit(0.0)).alias("kappa"))


def best_cutoff(df: DataFrame, positive: Column, score: Column, steps: int = 100) -> DataFrame:
    """The row of kappa_by_cutoff with the largest kappa, the smallest cutoff of equals."""
    return kappa_by_cutoff(df, positive, score, steps).orderBy(F.desc("kappa"), "cutoff_no").limit(1)


def log_loss(df: DataFrame, actual: str, probabilities: dict[str, str], floor: float = 1e-15) -> DataFrame:
    """Mean of minus the logarithm of the actual label's probability."""
    p = F.coalesce(*(F.when(F.col(actual) == label, F.col(c)) for label, c in probabilities.items()))
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(floor)))).alias("log_loss"), F.count(p).alias("games"))


def cross_table(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of each value of `columns` for each value of `rows`, nulls as `missing`."""
    shown = F.coalesce(F.col(rows).cast("string"), F.lit("missing")).alias(rows)
    return df.groupBy(shown).agg(*(F.count_if(F.coalesce(F.col(columns).cast("string"), F.lit("missing")) == v).alias(f"n_{v}") for v in values))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, present, missing, mean, sd, smallest, largest of numeric columns, in one pass."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("c")).select("c.*")
    return cells.groupBy("column").agg(
        F.count("x").alias("present"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("smallest"), F.max("x").alias("largest")
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 below low, bins + 1 from high), n."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, column: str, points: int = 200, bins: int = 2000) -> DataFrame:
    """point (from 0), x, density: a Gaussian kernel density at `points` even places from the smallest to the largest value,
    with the bandwidth sd * n ** (-1 / 5).

    Values are counted in `bins` bins first and stand at the middle of theirs (at most (largest - smallest) / 4000 off with
    2000), so what the kernel passes over does not grow with the rows. Nulls, NaN and infinities are passed over; without two
    different values there are no rows.
    """
    x = F.col(column).cast("double")
    known = df.select(x.alias("x")).filter(F.abs("x") < float("inf"))
    low, high, n, sd = (known.select(f("x")).scalar() for f in (F.min, F.max, F.count, F.stddev_samp))
    width, bandwidth = (high - low) / F.lit(float(bins)), sd * F.pow(n.cast("double"), F.lit(-0.2))
    counts = known.filter(high > low).groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    placed = counts.select("n", (low + (F.col("bin") + 0.5) * width).alias("middle"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point"))
    away = (low + F.col("point") * (high - low) / F.lit(points - 1.0) - F.col("middle")) / bandwidth
    summed = placed.groupBy("point").agg(F.sum(F.col("n") * F.exp(-0.5 * away * away)).alias("s"))
    return summed.select("point", (low + F.col("point") * (high - low) / F.lit(points - 1.0)).alias("x"), (F.col("s") / (n * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def pair_counts(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """x, y (lower ends of squares of this width), n: how many rows lie in each square, the data of a scatter plot at
    any number of rows. Rows without both numbers are passed over."""
    end = lambda c: (F.floor(F.col(c).cast("double") / width) * F.lit(width)).alias(c)
    both = df.filter((F.abs(F.col(x).cast("double")) < float("inf")) & (F.abs(F.col(y).cast("double")) < float("inf")))
    return both.select(end(x), end(y)).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def present_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, share of rows in which it isn't null, in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("__rows"), *(F.count(c).alias(c) for c in columns))
    cells = sums.select("__rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))).alias("c"))
    return cells.select("c.column", F.try_divide(F.col("c.n").cast("double"), "__rows").alias("share"))


#: Values that profile_sketches tracks for its most frequent ones: counts are exact up to this many different values.
TRACKED = 10_000


def profile_sketches(df: DataFrame, columns: list[str], top: int = 3, accuracy: int = 10_000) -> DataFrame:
    """column, present, missing, different, q25, median, q75, most_frequent (value, n): all columns in one pass by sketches
    that merge, of bounded size: different values within about 1.6 %, quartiles (of numbers) within 1 / accuracy of
    the rank, the `top` most frequent values by at most TRACKED counters. NaN counts as missing."""
    kinds, wide = dict(df.dtypes), []
    for c in columns:
        numeric = kinds[c] not in ("string", "boolean", "date", "binary") and not kinds[c].startswith(("timestamp", "array", "map", "struct"))
        value = F.when(~F.isnan(F.col(c)), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        quartiles = F.percentile_approx(value.cast("double"), [0.25, 0.5, 0.75], accuracy) if numeric else F.lit(None).cast("array<double>")
        text = value.cast("string")
        most = F.expr(f"approx_top_k(__text_{c}, {top}, {TRACKED})")
        wide.append((c, value, text, F.struct(F.lit(c).alias("column"), F.count(value).alias("present"), F.count_if(value.isNull()).alias("missing"), F.hll_sketch_estimate(F.hll_sketch_agg(text, 14)).alias("different"), quartiles.alias("q"), most.alias("most"))))
    rows = df.select(*columns, *(text.alias(f"__text_{c}") for c, _, text, _ in wide))
    sketched = rows.agg(F.array(*(cell for *_, cell in wide)).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")
    named = F.transform(F.filter("most", lambda m: m["item"].isNotNull()), lambda m: F.struct(m["item"].alias("value"), m["count"].alias("n")))
    return sketched.select("column", "present", "missing", F.coalesce("different", F.lit(0)).alias("different"), *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))), named.alias("most_frequent"))
