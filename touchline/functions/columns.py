"""Column builders: labels, probabilities, evidence, text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of the ratio of two probabilities, upper bounds excluded.
EVIDENCE_BANDS = (
    (1.0, "Negative evidence"),
    (3.0, "Anecdotal evidence"),
    (10.0, "Moderate evidence"),
    (30.0, "Strong evidence"),
    (100.0, "Very strong evidence"),
)
EVIDENCE_TOP = "Decisive evidence"

#: Standard deviations of a Poisson distribution, and terms besides, beyond its mean that are summed.
POISSON_SPREAD, POISSON_MORE = 12.0, 20


def binomial_result(home: Column, away: Column) -> Column:
    """Win or Loss of the home side; a draw is a Win, an unplayed game has none."""
    return F.when(home >= away, "Win").when(home < away, "Loss")


def multiclass_result(home: Column, away: Column) -> Column:
    return F.when(home > away, "Win").when(home < away, "Loss").when(home == away, "Draw")


def rating_result(home: Column, away: Column) -> Column:
    """1, 0 or 0.5 for the home side."""
    return F.when(home > away, 1.0).when(home < away, 0.0).when(home == away, 0.5)


def signed_result(own: Column, other: Column) -> Column:
    """1, -1 or 0 from one side's view; 0 while a score is missing."""
    return F.when(own > other, 1).when(own < other, -1).otherwise(0)


def margin_outcome(margin: Column, low: float, high: float) -> Column:
    """The margin put into [0, 1]; null stays null (least and greatest would pass it over)."""
    return F.when(margin.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (margin - low) / (high - low))))


def form_score(form: Column) -> Column:
    """Wins less losses in a string of W, L and D."""
    return F.regexp_count(form, F.lit("W")) - F.regexp_count(form, F.lit("L"))


def bayes_factor(home: Column, away: Column) -> Column:
    return F.when(away == 0, F.lit(float("inf"))).otherwise(home / away)


def win_ratio(home_mean: Column, away_mean: Column, home: Column, away: Column) -> Column:
    """The ratio of both win probabilities of Poisson scores, on the side of 1 on which their means are: the
    likelier winner is the side with the larger mean, whatever the last bit of the sums says."""
    ratio = bayes_factor(home, away)
    return F.when(home_mean > away_mean, F.greatest(ratio, F.lit(1.0))).when(home_mean < away_mean, F.least(ratio, F.lit(1.0 - 2.0**-53))).when(home_mean == away_mean, F.lit(1.0))


def evidence_strength(ratio: Column) -> Column:
    band = F.when(ratio < EVIDENCE_BANDS[0][0], EVIDENCE_BANDS[0][1])
    for bound, label in EVIDENCE_BANDS[1:]:
        band = band.when(ratio < bound, label)
    return F.when(ratio.isNotNull(), band.otherwise(EVIDENCE_TOP))


def poisson_last(mean: Column) -> Column:
    """The last term that matters of a Poisson distribution: what is left out is less than 1e-12."""
    return F.ceil(mean + POISSON_SPREAD * F.sqrt(mean) + POISSON_MORE)


def poisson_terms(mean: Column) -> Column:
    """Array of P(X = 0), P(X = 1), ..., as many as the mean needs."""
    none = F.lit(float("-inf"))
    start = F.struct(F.when(mean >= 0, -mean).alias("log"), F.array(F.exp(-mean)).alias("terms"))
    # each term from the one before, in logarithms, so that none is lost where the first ones vanish
    grown = lambda s, k: F.when(mean > 0, s["log"] + F.log(mean / k)).otherwise(none)
    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), poisson_last(mean)),
        start,
        lambda s, k: F.struct(grown(s, k).alias("log"), F.concat(s["terms"], F.array(F.exp(grown(s, k)))).alias("terms")),
        lambda s: s["terms"],
    )


def outcome_probabilities(home: Column, away: Column) -> Column:
    """struct(home, away, draw) of two independent Poisson scores with these means, from exact sums.

    The terms follow from one another, in logarithms, so that none is lost where the first ones vanish, and
    there are as many as the larger mean needs. Both sides are summed alike, term by term: equal means give
    equal probabilities to the last bit, and a small probability keeps its digits. Null means give null.
    The rows of a batch are summed together. Negative and infinite means give null.
    """
    spread, more = POISSON_SPREAD, POISSON_MORE

    @F.pandas_udf("home double, away double, draw double")
    def summed(home_means: pd.Series, away_means: pd.Series) -> pd.DataFrame:
        means = np.array([home_means.to_numpy(float), away_means.to_numpy(float)])
        out = np.full((3, means.shape[1]), np.nan)
        rows = np.flatnonzero(np.isfinite(means).all(0) & (means >= 0).all(0))
        largest = means[:, rows].max(0)
        last = np.ceil(largest + spread * np.sqrt(largest) + more)
        order = np.argsort(-last, kind="stable")  # rows that need most terms first
        rows, last = rows[order], last[order]
        mean = means[:, rows]
        term, below, wins, draw = -mean, np.exp(-mean), np.zeros_like(mean), np.exp(-mean.sum(0))
        for k in range(1, int(last.max(initial=0)) + 1):
            n = int(np.searchsorted(-last, -k, "right"))
            with np.errstate(divide="ignore"):
                term[:, :n] += np.log(mean[:, :n] / k)
            chance = np.exp(term[:, :n])
            wins[:, :n] += chance * below[::-1, :n]
            draw[:n] += np.exp(term[0, :n] + term[1, :n])
            below[:, :n] += chance
        out[:, rows] = wins[0], wins[1], draw
        return pd.DataFrame(out.T, columns=["home", "away", "draw"])

    return F.when(home.isNotNull() & away.isNotNull(), summed(home, away))
