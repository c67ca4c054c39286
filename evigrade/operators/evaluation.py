"""Evaluation of calls against labels: matrices, merged assays, strata, ranks. DataFrame to DataFrame, counts with map-side sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrade.functions.labels import determinate
from evigrade.functions.thresholds import merged_points, sign


def gene_deduped(rows: DataFrame, keys: list[str], order: str, points: str, sample: str, call: str, vus: str, assay: str) -> DataFrame:
    """One row a physical variant: the first sample given, merged points, the one determinate call if there is just one, any VUS, assays.

    Rows are folded by assay first, so that counting assays needs no second copy of them.
    """
    own = F.when(F.col(sample) != "", F.struct(F.col(order).alias("o"), F.col(sample).alias("s")))
    by_assay = rows.groupBy(*keys, assay).agg(F.min(own).alias("first"), F.min(points).alias("lo"), F.max(points).alias("hi"), F.min(determinate(F.col(call))).alias("call_lo"), F.max(determinate(F.col(call))).alias("call_hi"), F.bool_or(F.coalesce(vus, F.lit(False))).alias("vus"))
    merged = by_assay.groupBy(*keys).agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("call_lo").alias("a"), F.max("call_hi").alias("b"), F.bool_or("vus").alias("is_vus"), F.count("*").alias("n_assays"))
    return merged.select(*keys, F.col("first.s").alias("sample"), merged_points(F.col("lo"), F.col("hi")).alias("points"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("call"), "is_vus", "n_assays")


def matrix(truth: dict[str, Column], value: Column, names: tuple[str, str, str] = ("normal", "ir", "abnormal")) -> list[Column]:
    """Counts by truth (a flag each) and sign of value."""
    return [F.count_if(flag & (sign(value) == s)).alias(f"{t}_{n}") for t, flag in truth.items() for s, n in zip((-1, 0, 1), names, strict=True)]


def call_sign(call: Column) -> Column:
    """-1, 0 or 1 for a call of Normal, none or Abnormal."""
    return F.when(F.upper(call) == "NORMAL", -1).when(F.upper(call) == "ABNORMAL", 1).otherwise(0)


def transposed(rows: DataFrame, keys: list[str], prefix: str, to: str) -> DataFrame:
    """Matrix of (p, i, b) x (plp, blb) as columns blb and plp of (normal, ir, abnormal)."""
    order = {"normal": "b", "ir": "i", "abnormal": "p"}
    return rows.select(*keys, *[F.col(f"{prefix}_{k}_{t}").alias(f"{to}_{t}_{n}") for t in ("blb", "plp") for n, k in order.items()])


def thresholded(points: Column, at: Column, below: Column) -> Column:
    return F.when(points >= at, 1).when(points <= below, -1).otherwise(0)


def rank_sums(rows: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    """keys, n1, n2, u and auc: how often a row of the first class has the higher value, ties by half.

    Rows are counted by value before they are ranked, so a window holds the distinct values of a key and not its rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(first).alias("a"), F.count_if(~F.col(first)).alias("b"))
    below = F.sum("b").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.select(*keys, "a", "b", F.coalesce(below, F.lit(0)).alias("below"))
    sums = ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"))
    return sums.withColumn("auc", F.try_divide("u", F.col("n1") * F.col("n2")))


def finite_percentiles(value: Column, at: list[float]) -> Column:
    """Percentiles over the finite values of a small group; infinite where there is none."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return F.coalesce(F.percentile(finite, F.array(*[F.lit(q) for q in at])), F.array(*[F.lit(float("inf")) for _ in at]))


def levels_reached(points: Column) -> dict[str, Column]:
    """Shares of rows at and beyond each level, for and against, in percent."""
    cells = {f"ge_{k}": points >= k for k in (1, 2, 4, 8)} | {f"le_{k}": points <= -k for k in (1, 2, 4, 8)} | {"any": points != 0}
    return {n: 100.0 * F.count_if(c) / F.count("*") for n, c in cells.items()}


def total(*columns: str) -> Column:
    return reduce(Column.__add__, map(F.col, columns))
