"""Scales of evidence as column expressions: from points to likelihood ratios and back, for a prior that is a column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Posteriors at the class boundaries, the places of the classes in points, and those of the additive scale.
TARGETS = {"B": 0.01, "LB": 0.10, "LP": 0.90, "P": 0.99}
PLACES = {"B": -7.0, "LB": -1.0, "LP": 6.0, "P": 10.0}
ADDITIVE_PLACES = {"B": -6.0, "LB": 0.0, "LP": 11.0, "P": 17.0}


def log_odds(q: Column | float) -> Column:
    q = q if isinstance(q, Column) else F.lit(q)
    return F.ln(F.try_divide(q, 1 - q))


def through_knots(x: Column, xs: Sequence[Column | float], ys: Sequence[Column | float]) -> Column:
    """Linear between the knots, the outer segments go on; a segment without width has its lower end's value. xs ascend."""
    xs, ys = ([k if isinstance(k, Column) else F.lit(k) for k in ks] for ks in (xs, ys))
    segment = lambda i: F.coalesce(ys[i] + F.try_divide((x - xs[i]) * (ys[i + 1] - ys[i]), xs[i + 1] - xs[i]), ys[i])
    found = segment(0)
    for i in range(1, len(xs) - 1):
        found = F.when(x >= xs[i], segment(i)).otherwise(found)
    return F.when(x.isNotNull(), found)


def knots(prior: Column, targets: dict[str, Column | float], places: dict[str, float], neutral: bool = False) -> tuple[list[float], list[Column]]:
    """Places in points and log likelihood ratios of the class boundaries; ``neutral`` adds the place of no evidence at 0."""
    names = ["B", "LB", "LP", "P"]
    at, logs = [places[n] for n in names], [log_odds(targets[n]) - log_odds(prior) for n in names]
    return ([*at[:2], 0.0, *at[2:]], [*logs[:2], F.lit(0.0), *logs[2:]]) if neutral else (at, logs)


def log_lr(points: Column, prior: Column, targets: dict[str, Column | float] = TARGETS, places: dict[str, float] = PLACES, neutral: bool = False) -> Column:
    """Log likelihood ratio of a number of points by the knots of the classes."""
    return through_knots(points, *knots(prior, targets, places, neutral))


def display_points(log_ratio: Column, prior: Column, targets: dict[str, Column | float] = TARGETS, neutral: bool = False) -> Column:
    """Fractional points of a log likelihood ratio, the inverse of log_lr; not to be added up."""
    at, logs = knots(prior, targets, PLACES, neutral)
    return through_knots(log_ratio, logs, at)


def anchored_log_lr(points: Column, prior: Column) -> Column:
    """Two slopes through 0. The one for points from 0 puts the likely pathogenic class at its posterior whatever the prior.

    The one below 0 has the sign that is in use, not the mirrored one: it meets the likely benign posterior at a prior of 0.1 only.
    """
    up, down = (log_odds(TARGETS["LP"]) - log_odds(prior)) / PLACES["LP"], log_odds(TARGETS["LB"]) - log_odds(prior)
    return F.when(points >= 0, up * points).otherwise(down * points)


def floored(targets: dict[str, float], prior: Column) -> dict[str, Column]:
    """Targets that no evidence of the wrong direction reaches: benign ones at most the prior, pathogenic ones at least."""
    return {n: F.least(F.lit(q), prior) if n in ("B", "LB") else F.greatest(F.lit(q), prior) for n, q in targets.items()}


def class_of(posterior: Column, targets: dict[str, Column | float] = TARGETS) -> Column:
    """P, LP, VUS, LB or B; where floored targets meet, the benign classes win and the stronger one first."""
    q = {n: t if isinstance(t, Column) else F.lit(t) for n, t in targets.items()}
    return F.when(posterior <= q["B"], "B").when(posterior <= q["LB"], "LB").when(posterior >= q["P"], "P").when(posterior >= q["LP"], "LP").otherwise("VUS")


def fixed_slope(gap: float, targets: dict[str, float] = TARGETS) -> float:
    """Log likelihood ratio of one point where ``gap`` points lead from likely to certain; the same for every prior."""
    odds = lambda q: q / (1 - q)
    return math.log(odds(targets["P"]) / odds(targets["LP"])) / gap


def clean_gap(targets: dict[str, float] = TARGETS, least: int = 4, most: int = 60) -> Column:
    """The whole gap at which the place of LP falls closest below a whole number, the smallest at a tie."""
    odds = lambda q: math.log(q / (1 - q))
    share = odds(targets["LP"]) / (odds(targets["P"]) - odds(targets["LP"]))
    rated = F.transform(F.sequence(F.lit(least), F.lit(most)), lambda g: F.struct((F.ceil(g * share) - g * share).alias("miss"), g.alias("gap")))
    return F.array_min(rated)["gap"]


def prior_points(prior: Column, slope: Column | float) -> Column:
    """Points that the prior is worth against one of a half."""
    return log_odds(prior) / slope


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tier_of(ratio: Column, tiers: Column, upward: bool) -> Column:
    """Number of the highest tier that ratio reaches, and 0 where it reaches none; tiers ascend, or descend where not upward.

    A tier counts where the next one isn't reached, so of tiers out of order the first such counts.
    """
    reached = lambda t: (ratio >= t) if upward else (ratio <= t)
    last = F.size(tiers)
    hit = F.filter(F.sequence(F.lit(1), last), lambda i: reached(F.element_at(tiers, i)) & ((i == last) | ~reached(F.get(tiers, i))))
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(0))


def benign_weights(benign: Column, synonymous: Column, method: str) -> Column:
    """Weights of the benign reference by component: of the benign sample, the synonymous one, or their mean; what is missing is replaced by the other."""
    if method == "synonymous":
        return F.coalesce(synonymous, benign)
    mean = F.zip_with(benign, synonymous, lambda a, b: (a + b) / 2)
    return F.coalesce(mean, benign, synonymous) if method == "avg" else F.coalesce(benign, synonymous)


def weight_prior(pathogenic: Column, benign: Column, population: Column, component: int = 1) -> Column:
    """Share of the pathogenic class in the population, from the weights of one component; null where it can't tell."""
    w = lambda c: F.element_at(c, component + 1)
    return F.try_divide(w(population) - w(benign), w(pathogenic) - w(benign))


def proper(prior: Column) -> Column:
    """prior where it is a share between 0 and 1, else null."""
    return F.when((prior > 0) & (prior < 1), prior)


#: Eighths of a very strong line by criterion of the baseline method, those of the likely class first.
LIKELY_EIGHTHS, CERTAIN_EIGHTHS = (10, 6, 6, 6, 6, 6), (12, 12, 11, 10, 8, 10, 10, 10)
#: The largest constant of the baseline method, which counts up to a prior of 0.01, and the prior beyond which it is 1.
LARGEST, LOW_PRIOR, HIGH_PRIOR = 8573, 0.01, 0.97


def baseline_constant(prior: Column) -> Column:
    """Ratio of a very strong line for the baseline method: one less than the first whole number that meets 13 of 14 criteria; null if none does."""

    def met(c: Column) -> Column:
        post = lambda e: F.pow(c, F.lit(e / 8)) * prior / ((F.pow(c, F.lit(e / 8)) - 1) * prior + 1)
        terms = [(post(e) >= q).cast("int") for eighths, q in ((LIKELY_EIGHTHS, 0.9), (CERTAIN_EIGHTHS, 0.99)) for e in eighths]
        return reduce(Column.__add__, terms) == 13

    found = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(LARGEST)), lambda c: met(c.cast("double")))) - 1
    return F.when(prior <= LOW_PRIOR, LARGEST).when(prior > HIGH_PRIOR, 1).otherwise(found)
