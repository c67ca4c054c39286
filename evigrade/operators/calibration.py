"""Scoresets, points, confusion matrices, merges, curves: DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrade.functions.thresholds import merged_points, sign


def scoreset(rows: DataFrame, score: Column, plp: Column, blb: Column, extra: Column, keys: list[str]) -> DataFrame:
    """Score and multi-label membership; missing, NaN and non-finite scores go, every row left is in the population."""
    flags = {"is_plp": plp, "is_blb": blb, "is_pop": F.lit(True), "is_reg": extra}
    scored = rows.select(*keys, score.alias("score"), *[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()])
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))


def confusion(rows: DataFrame, keys: list[str], truth: Column, points: Column) -> DataFrame:
    """Counts by truth (P, B) and sign of points, one row a key; a missing cell is 0."""
    cells = {"tp": (truth == "P") & (sign(points) > 0), "p_vus": (truth == "P") & (sign(points) == 0), "fn": (truth == "P") & (sign(points) < 0), "fp": (truth == "B") & (sign(points) > 0), "b_vus": (truth == "B") & (sign(points) == 0), "tn": (truth == "B") & (sign(points) < 0)}
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


def metrics(matrix: DataFrame) -> DataFrame:
    """Coverage, accuracy, sensitivity, specificity, MCC and diagnostic odds ratio; null where a denominator is 0, the ratio corrected by a half only where FP or FN is 0."""
    c = {n: F.col(n).cast("double") for n in ("tp", "p_vus", "fn", "fp", "b_vus", "tn")}
    called = c["tp"] + c["fn"] + c["fp"] + c["tn"]
    half = F.when((c["fp"] == 0) | (c["fn"] == 0), 0.5).otherwise(0.0)
    product = (c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])
    return matrix.withColumns({
        "coverage": F.round(F.try_divide(called, called + c["p_vus"] + c["b_vus"]), 6), "accuracy": F.round(F.try_divide(c["tp"] + c["tn"], called), 6),
        "sensitivity": F.round(F.try_divide(c["tp"], c["tp"] + c["fn"]), 6), "specificity": F.round(F.try_divide(c["tn"], c["tn"] + c["fp"]), 6),
        "mcc": F.round(F.try_divide(c["tp"] * c["tn"] - c["fp"] * c["fn"], F.sqrt(product)), 6), "dor": F.round(F.try_divide((c["tp"] + half) * (c["tn"] + half), (c["fp"] + half) * (c["fn"] + half)), 6),
    })


def full_metrics(matrix: DataFrame) -> DataFrame:
    """Metrics of determinate calls, and of the calls for either class against all others, uncertain ones included.

    Here a ratio without a denominator is 0, a likelihood ratio without false calls is infinite, as is an odds ratio where a
    kind of false call is missing; without determinate calls those of determinate calls are 0.
    """
    c = {n: F.col(n).cast("double") for n in ("tp", "p_vus", "fn", "fp", "b_vus", "tn")}
    zero, endless = F.lit(0.0), F.lit(float("inf"))
    share = lambda a, b: F.coalesce(F.try_divide(a, a + b), zero)
    odds = lambda tp, fn, fp, tn: F.when((fp > 0) & (fn > 0), tp * tn / (fp * fn)).otherwise(endless)

    def lr_plus(tp: Column, fn: Column, fp: Column, tn: Column) -> Column:
        specific = share(tn, fp)
        return F.when(specific < 1, share(tp, fn) / (1 - specific)).otherwise(endless)

    def lr_minus(tp: Column, fn: Column, fp: Column, tn: Column) -> Column:
        specific = share(tn, fp)
        return F.when(specific > 0, (1 - share(tp, fn)) / specific).otherwise(endless)

    called = c["tp"] + c["fn"] + c["fp"] + c["tn"]
    sure = c["tp"], c["fn"], c["fp"], c["tn"]
    first = c["tp"], c["fn"] + c["p_vus"], c["fp"], c["tn"] + c["b_vus"]
    second = c["tn"], c["fp"] + c["b_vus"], c["fn"], c["tp"] + c["p_vus"]
    root = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    of_sure = {"accuracy": share(c["tp"] + c["tn"], c["fp"] + c["fn"]), "sensitivity": share(c["tp"], c["fn"]), "specificity": share(c["tn"], c["fp"]), "mcc": F.coalesce(F.try_divide(c["tp"] * c["tn"] - c["fp"] * c["fn"], root), zero), "dor_standard": odds(*sure), "lr_plus_standard": lr_plus(*sure), "lr_minus_standard": lr_minus(*sure)}
    of_all = {"coverage": share(called, c["p_vus"] + c["b_vus"]), "lr_plus_pathogenic": lr_plus(*first), "lr_plus_benign": lr_plus(*second), "dor_pathogenic": odds(*first), "dor_benign": odds(*second)}
    rounded = lambda v: F.when(v == endless, endless).otherwise(F.round(v, 6))
    return matrix.withColumns({n: rounded(F.when(called > 0, v).otherwise(zero)) for n, v in of_sure.items()} | {n: rounded(v) for n, v in of_all.items()})


def replicate_mean(rows: DataFrame, keys: list[str], score: str, flags: list[str]) -> DataFrame:
    """One row a variant: mean of the measured scores, any() of each flag, and how many measurements there were."""
    return rows.groupBy(*keys).agg(F.avg(F.nanvl(score, F.lit(None).cast("double"))).alias("score"), F.count(score).alias("n"), *[F.bool_or(f).alias(f) for f in flags])


def merge_assays(rows: DataFrame, keys: list[str], points: str, label: str, assay: str) -> DataFrame:
    """One row a variant over its assays: merged points, the largest, the one determinate label if there is just one, and assays."""
    by_assay = rows.groupBy(*keys, assay).agg(F.min(points).alias("lo"), F.max(points).alias("hi"), F.min(label).alias("a"), F.max(label).alias("b"))
    merged = by_assay.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("a").alias("a"), F.max("b").alias("b"), F.count(assay).alias("assays"))
    most = F.when(F.col("hi") <= 0, F.col("lo")).otherwise(F.col("hi"))
    return merged.select(*keys, merged_points(F.col("lo"), F.col("hi")).alias("points"), most.alias("max_points"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("label"), "assays")


def runs(curve: DataFrame, keys: list[str], at: str, points: str) -> DataFrame:
    """Runs of equal points along a curve. A run ends at the first place of the next run, the last at the curve's end; runs of 0 points give no row."""
    w = Window.partitionBy(*keys).orderBy(at)
    starts = curve.withColumn("before", F.lag(points).over(w)).withColumn("last_at", F.max(at).over(Window.partitionBy(*keys)))
    starts = starts.where(F.col("before").isNull() | (F.col("before") != F.col(points)))
    ended = starts.withColumn("hi", F.coalesce(F.lead(at).over(w), "last_at"))
    return ended.where(F.col(points) != 0).select(*keys, F.col(at).alias("lo"), "hi", F.col(points).alias("points"))


def best_restart(fits: DataFrame, keys: list[str], likelihood: str, index: str) -> DataFrame:
    """The fit of the highest likelihood, the smaller index at a tie; NaN is a failed fit."""
    good = fits.where(F.col(likelihood).isNotNull() & ~F.isnan(likelihood))
    return good.groupBy(*keys).agg(F.max(F.struct(F.col(likelihood).alias("ll"), (-F.col(index)).alias("rev"))).alias("best")).select(*keys, F.col("best.ll").alias("ll"), (-F.col("best.rev")).alias("fit"))
