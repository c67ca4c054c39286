"""Choice between two models by paired differences over bootstraps.

Defined results: null and NaN differences and differences of 0 are left out; without any the test says nothing (p is 1);
ties share the mean of their ranks, and take the test to its normal approximation, as more than ``EXACT`` differences do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrade.operators.fits import log_normal_cdf

EXACT = 50


def subsets_reaching(n: Column, w: Column) -> Column:
    """The share of the subsets of 1..n whose sum is at least w, counted by sums: adding a number shifts and adds the counts."""
    most = (n * (n + 1) / 2).cast("int")
    none = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), most))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), none, lambda c, k: F.transform(c, lambda v, i: v / 2 + F.when(i >= k, F.get(c, i - k) / 2).otherwise(0.0)))
    return F.aggregate(F.slice(counts, F.ceil(w).cast("int") + 1, most + 1), F.lit(0.0), lambda s, v: s + v)


def signed_rank(pairs: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """keys, n, w (the sum of the ranks of positive differences) and p, the chance of so large a sum where neither model is better."""
    d = F.col(difference)
    kept = pairs.where(d.isNotNull() & ~F.isnan(d) & (d != 0)).select(*keys, d.alias("_d"), F.abs(d).alias("_a"))
    by = Window.partitionBy(*keys)
    tied = kept.groupBy(*keys, "_a").agg(F.count("*").alias("t"), F.count_if(F.col("_d") > 0).alias("up"))
    ranked = tied.withColumn("rank", F.sum("t").over(by.orderBy("_a")) - (F.col("t") - 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    exact = (F.col("n") <= EXACT) & (F.col("ties") == 0)
    p = F.when(exact, subsets_reaching(F.col("n"), F.col("w"))).otherwise(F.exp(log_normal_cdf(-z)))
    found = sums.select(*keys, "n", "w", p.alias("p"))
    return pairs.select(*keys).distinct().join(found, keys, "left").fillna({"n": 0, "w": 0.0, "p": 1.0})
