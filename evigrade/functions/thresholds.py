"""Closed-form evidence thresholds as column expressions; nothing here runs in Python at query time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points and posteriors at the knots of the piecewise mapping.
KNOTS = ((-7.0, 0.01), (-1.0, 0.10), (6.0, 0.90), (10.0, 0.99))


def lr_for_posterior(q: Column, prior: Column) -> Column:
    """Likelihood ratio that takes prior to the posterior q; null where a denominator is 0."""
    return F.try_divide(q * (1 - prior), prior * (1 - q))


def posterior_from_lr(lr: Column, prior: Column) -> Column:
    return F.try_divide(lr * prior, (lr - 1) * prior + 1)


def tier_thresholds(c: Column) -> Column:
    """array<struct<points, lr_p, lr_b>>: c ** (k / 8) for the tiers 1 to 8, and the inverse."""
    return F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.struct(k.alias("points"), F.pow(c, k / 8.0).alias("lr_p"), F.pow(c, -k / 8.0).alias("lr_b")))


def piecewise_log_lr(points: Column, prior: Column) -> Column:
    """Log likelihood ratio of a number of points: linear between the knots, the outer segments go on."""
    logs = [F.ln(lr_for_posterior(F.lit(q), prior)) for _, q in KNOTS]
    segment = lambda i: logs[i] + (points - KNOTS[i][0]) * (logs[i + 1] - logs[i]) / (KNOTS[i + 1][0] - KNOTS[i][0])
    return F.when(points < KNOTS[1][0], segment(0)).when(points < KNOTS[2][0], segment(1)).otherwise(segment(2))


def continuous_class(posterior: Column) -> Column:
    return F.when(posterior >= 0.99, "P").when(posterior >= 0.90, "LP").when(posterior <= 0.01, "B").when(posterior <= 0.10, "LB").otherwise("VUS")


def first_range(score: Column, ranges: list[tuple[float, float, int]]) -> Column:
    """Points of the first closed range that holds score; 0 outside all, null for a null or NaN score."""
    found = F.lit(0)
    for lo, hi, points in reversed(ranges):
        found = F.when(score.between(lo, hi), points).otherwise(found)
    return F.when(score.isNotNull() & ~F.isnan(score), found)


def last_range(score: Column, ranges: list[tuple[float, float, int]]) -> Column:
    """As first_range, but of ranges that share a boundary the later one wins."""
    return first_range(score, list(reversed(ranges)))


def sign(points: Column) -> Column:
    return F.when(points > 0, 1).when(points < 0, -1).otherwise(0)


def band(points: Column) -> Column:
    """Strength band of a number of points: 1, 2, 4 or 8 with the sign; 0 stays."""
    a = F.abs(points)
    return sign(points) * F.when(a >= 8, 8).when(a >= 4, 4).when(a >= 2, 2).otherwise(a)


def merged_points(low: Column, high: Column) -> Column:
    """Points of one variant from several assays: the extreme if all signs agree, 0 if they conflict."""
    return F.when((low < 0) & (high > 0), 0).when(high > 0, high).otherwise(low)
