"""Queries on mixture fits, and SQL for what SQL can express of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.jobs.calibration import SCORED, _scores
from evigrade.operators import mixtures as op
from evigrade.sources.staging import once

SEEDS, POINTS, SIMULATIONS = 3, 99, 19


def _best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = once(spark, "score-counts", sf, lambda: op.counted_scores(_scores(spark, sf), "lang", SEEDS))
    return once(spark, "best-fits", sf, lambda: op.best_fits(op.mixture_fits(counts, "lang"), "lang")), counts


def mixture_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The best of the restarts for each language, bootstrap and number of components."""
    return _best(spark, sf)[0]


def density_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Prior for each language and number of components: the median over the bootstraps that kept theirs."""
    best, counts = _best(spark, sf)
    priors = op.density_priors(best, counts, "lang")
    return priors.groupBy("lang", "n_c").agg(F.percentile("prior", 0.5).alias("prior"), F.avg(F.col("prior").isNotNull().cast("double")).alias("kept"))


def component_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Whether three components beat two: the 5th percentile of the gain in likelihood over the bootstraps is above 0."""
    gain = _best(spark, sf)[0].groupBy("lang", "seed").agg((F.max(F.when(F.col("n_c") == 3, F.col("val_ll"))) - F.max(F.when(F.col("n_c") == 2, F.col("val_ll")))).alias("gain"))
    p5 = F.percentile("gain", 0.05)
    return gain.groupBy("lang").agg(p5.alias("gain_p5"), F.when(p5 > 0, 3).otherwise(2).alias("n_c"))


def constrained_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The best restart for each language and bootstrap, of two components whose density ratio stays monotone."""
    counts = once(spark, "score-counts", sf, lambda: op.counted_scores(_scores(spark, sf), "lang", SEEDS))
    return op.best_fits(op.mixture_fits(counts, "lang", (2,), constrained=True), "lang")


def ratio_test(spark: SparkSession, sf: str) -> DataFrame:
    """Three components against two for each language, by draws from the fit of two."""
    counts = once(spark, "score-counts", sf, lambda: op.counted_scores(_scores(spark, sf), "lang", SEEDS)).where("seed = 0")
    return op.likelihood_ratio_test(counts, "lang", SIMULATIONS, bins=128, max_steps=100)


def quantile_distance(spark: SparkSession, sf: str) -> DataFrame:
    return op.quantile_distance(_scores(spark, sf), "lang", POINTS).withColumn("distance", F.round("distance", 6))


QUERIES = {f.__name__: f for f in (mixture_fits, density_priors, component_choice, constrained_fits, ratio_test, quantile_distance)}
SQL = {
    "quantile_distance": f"""WITH {SCORED}, p AS (SELECT i, (i / {POINTS + 1}.0::DOUBLE)::DOUBLE AS q FROM range(1, {POINTS + 1}) r(i)),
c AS (SELECT lang, list_sort(list(score) FILTER (is_plp)) AS a, list_sort(list(score) FILTER (is_blb)) AS b FROM s GROUP BY 1),
t AS (SELECT lang, a, b, q * (len(a) - 1) AS x, q * (len(b) - 1) AS y FROM c, p),
v AS (SELECT lang, a[floor(x)::BIGINT + 1] + (x - floor(x)) * (a[ceil(x)::BIGINT + 1] - a[floor(x)::BIGINT + 1]) AS qa,
  b[floor(y)::BIGINT + 1] + (y - floor(y)) * (b[ceil(y)::BIGINT + 1] - b[floor(y)::BIGINT + 1]) AS qb FROM t)
SELECT lang, round(sqrt(avg((qa - qb) * (qa - qb))), 6) AS distance FROM v GROUP BY 1""",
}
