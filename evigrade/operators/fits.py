"""From fitted mixtures to class densities, priors, likelihood ratio curves and evidence, as column expressions.

A fit is a row: its components (skew normals) and, for each sample, the weights of the components, null where a dataset
has no such sample. Samples are, in this order, the first class, the second one, the population and a stand-in for
the second class. Densities are computed in the JVM on logarithms, at grid places or distinct scores; what grows with
the data is counted by score before, and a fit's work is in proportion to places and not to rows.

Where one class has no labelled sample its density is what is left of the population without the other class, with a
floor, and the prior is bounded by the labelled class: it can't outweigh the population anywhere.

Defined results: a fit without the samples that are needed, or with a prior that isn't inside 0 and 1, gives null
densities and no evidence; a place beyond the scores that a fit has seen is null; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrade.operators import mixtures

FIRST, SECOND, POPULATION, STAND_IN = range(4)
#: An unmixed density is at least this share of the population's.
FLOOR = 1e-10
#: From here on the tail of the normal distribution is taken from its continued fraction, nearer in from its series.
FAR, LEVELS, TERMS = 3.0, 120, 50
LOG_ROOT_TAU = math.log(2 * math.pi) / 2


def log_normal_cdf(z: Column) -> Column:
    """Log of the standard normal distribution function, to about twelve digits, for any finite z."""
    x = F.abs(z)
    fraction = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)
    log_tail = -x * x / 2 - LOG_ROOT_TAU - F.ln(fraction)
    series = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, k: 1 + z * z / (2 * k + 1) * acc)
    near = F.ln(0.5 + F.exp(-z * z / 2 - LOG_ROOT_TAU) * z * series)
    return F.when(x < FAR, near).when(z < 0, log_tail).otherwise(F.log1p(-F.exp(log_tail)))


def skew_normal_log_pdf(x: Column, component: Column) -> Column:
    d = (x - component["loc"]) / component["scale"]
    return math.log(2) - LOG_ROOT_TAU - F.ln(component["scale"]) - d * d / 2 + log_normal_cdf(component["a"] * d)


def log_mixture(logs: Column, weights: Column) -> Column:
    """Log density of a mixture from its components' log densities; null without weights."""
    parts = F.filter(F.zip_with(logs, weights, lambda l, w: F.when(w > 0, l + F.ln(w))), lambda v: v.isNotNull())  # noqa: E741
    top = F.array_max(parts)
    return F.when(weights.isNotNull(), top + F.ln(F.aggregate(parts, F.lit(0.0), lambda s, v: s + F.exp(v - top))))


def second_weights(weights: Column, method: str) -> Column:
    """Weights that stand for the second class: its own, its stand-in's, or the mean of both; where one is missing the other."""
    own, other = F.get(weights, F.lit(SECOND)), F.get(weights, F.lit(STAND_IN))
    if method == "synonymous":
        return F.coalesce(other, own)
    mean = F.zip_with(own, other, lambda a, b: (a + b) / 2)
    return F.coalesce(mean, own, other) if method == "avg" else F.coalesce(own, other)


def at_places(fits: DataFrame, places: DataFrame, dataset: list[str], method: str = "benign") -> DataFrame:
    """fits x places of their dataset: all columns of both but components and weights, and log_p, log_b and log_pop.

    places has the columns of dataset and x. Where fits have lo and hi, the ends of what they have seen, places beyond are null.
    """
    each = places.join(fits, dataset)
    inside = F.col("x").between(F.col("lo"), F.col("hi")) if {"lo", "hi"} <= set(fits.columns) else F.lit(True)
    each = each.withColumn("logs", F.when(inside, F.transform("components", lambda c: skew_normal_log_pdf(F.col("x"), c))))
    w = {"log_p": F.get("weights", F.lit(FIRST)), "log_b": second_weights(F.col("weights"), method), "log_pop": F.get("weights", F.lit(POPULATION))}
    return each.withColumns({n: log_mixture(F.col("logs"), c) for n, c in w.items()}).drop("components", "weights", "logs")


def unmixed(log_pop: Column, share: Column, log_class: Column) -> Column:
    """Log density of the population without a class that has this share of it, at least FLOOR of the population's; null if the class has none."""
    left = (1 - share * F.exp(log_class - log_pop)) / (1 - share)
    return F.when(log_class.isNotNull(), log_pop + F.ln(F.greatest(left, F.lit(FLOOR))))


def class_log_densities(log_p: Column, log_b: Column, log_pop: Column, prior: Column) -> tuple[Column, Column]:
    """Log densities of both classes; a class without a sample is unmixed from the population. Null if the prior isn't inside 0 and 1."""
    told = (prior > 0) & (prior < 1)
    return F.when(told, F.coalesce(log_p, unmixed(log_pop, 1 - prior, log_b))), F.when(told, F.coalesce(log_b, unmixed(log_pop, prior, log_p)))


def fit_priors(seen: DataFrame, keys: list[str]) -> DataFrame:
    """keys and prior, the share of the first class in the population, null where a fit's can't be told.

    seen: keys, n (rows of the population at a score) and log_p, log_b, log_pop there. With both classes the prior is the fixed
    point of the mean posterior, iterated on the counts of one fit; with one class it is one aggregate.
    """
    both = F.col("log_p").isNotNull() & F.col("log_b").isNotNull()
    kinds = {f.name: f.dataType.simpleString() for f in seen.schema if f.name in keys}

    def fixed_point(one: pd.DataFrame) -> pd.DataFrame:
        # Only the ratio counts, so both densities are scaled by the larger one.
        top = np.maximum(one.log_p, one.log_b)
        prior = mixtures.class_prior(np.exp(one.log_p - top).to_numpy(), np.exp(one.log_b - top).to_numpy(), one.n.to_numpy())
        return pd.DataFrame([{**{k: one[k].iloc[0] for k in keys}, "prior": prior}])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", prior double"
    standard = seen.where(both).select(*keys, "n", "log_p", "log_b").groupBy(*keys).applyInPandas(fixed_point, schema)
    one_class = F.coalesce("log_p", "log_b")
    bound = F.min(F.exp(F.col("log_pop") - one_class))
    single = seen.where(~both & F.col("log_pop").isNotNull()).groupBy(*keys).agg(bound.alias("bound"), F.bool_or(F.col("log_p").isNotNull()).alias("is_first"), F.count(one_class).alias("told"))
    raw = F.when(F.col("is_first"), F.col("bound")).otherwise(1 - F.col("bound"))
    kept = F.when(F.col("told") == 0, mixtures.NO_SIGNAL).when((raw >= mixtures.MOST) | (raw < 0), F.lit(None)).otherwise(F.greatest(raw, F.lit(mixtures.LEAST)))
    found = standard.unionByName(single.select(*keys, kept.alias("prior")))
    return found.withColumn("prior", F.when(~F.isnan("prior"), F.col("prior")))


#: The prior that is used where the median isn't inside 0 and 1 or no fit kept one.
FALLBACK, LEAST_KEPT = 0.1, 0.5


def dataset_priors(priors: DataFrame, dataset: list[str]) -> DataFrame:
    """dataset, prior (the median over the fits that kept theirs), kept (their share) and unstable.

    It is unstable where no fit kept its prior, and FALLBACK stands in, or where fewer than LEAST_KEPT of them did.
    """
    found = priors.groupBy(*dataset).agg(F.percentile("prior", 0.5).alias("median"), F.avg(F.col("prior").isNotNull().cast("double")).alias("kept"))
    told = (F.col("median") > 0) & (F.col("median") < 1)
    return found.select(*dataset, F.when(told, F.col("median")).otherwise(FALLBACK).alias("prior"), "kept", (F.coalesce(~told, F.lit(True)) | (F.col("kept") < LEAST_KEPT)).alias("unstable"))


def log_ratio(seen: DataFrame, priors: DataFrame, keys: list[str]) -> DataFrame:
    """seen (as at_places gives it) with the log ratio l of both classes by each fit's own prior."""
    joined = seen.join(priors, keys, "left")
    p, b = class_log_densities(F.col("log_p"), F.col("log_b"), F.col("log_pop"), F.col("prior"))
    return joined.withColumn("l", p - b).drop("prior")


def curve_percentiles(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fits (those that say anything there), and the 5th, 50th and 95th percentile of l over the fits."""
    q = F.percentile("l", F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)]))
    found = ratios.groupBy(*keys).agg(q.alias("q"), F.count("l").alias("fits"))
    return found.select(*keys, "fits", *[F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


def ratio_checks(fits: DataFrame, places: DataFrame, dataset: list[str], keys: list[str]) -> DataFrame:
    """keys, and whether the fit's density ratios and its likelihood ratio are monotone along the places (dataset, grid and x).

    ratios_fall: each component's density over that of the next one, by location, never rises where both log densities are
    above the mass that counts. lr_falls and lr_rises: the first class over the second one, null without both.
    """
    ordered = fits.withColumn("by_loc", F.array_sort(F.transform("components", lambda c: F.struct(c["loc"].alias("loc"), c.alias("c")))))
    each = places.join(ordered, dataset).withColumn("logs", F.transform("by_loc", lambda c: skew_normal_log_pdf(F.col("x"), c["c"])))
    pair = each.select(*keys, "grid", F.explode(F.sequence(F.lit(1), F.size("logs") - 1)).alias("k"), "logs").where(F.size("logs") > 1)
    a, b = F.get("logs", F.col("k") - 1), F.get("logs", F.col("k"))
    seen = pair.select(*keys, "k", "grid", (a - b).alias("r"), ((a > mixtures.MASS) & (b > mixtures.MASS)).alias("seen")).where("seen")
    steps = seen.select(*keys, (F.col("r") - F.lag("r").over(Window.partitionBy(*keys, "k").orderBy("grid"))).alias("step"))
    falls = steps.groupBy(*keys).agg(F.coalesce(~F.bool_or(F.col("step") > mixtures.SLACK), F.lit(True)).alias("ratios_fall"))
    lr = at_places(fits, places, dataset).select(*keys, (F.col("log_p") - F.col("log_b") - F.lag(F.col("log_p") - F.col("log_b")).over(Window.partitionBy(*keys).orderBy("grid"))).alias("step"))
    lr = lr.groupBy(*keys).agg(*[(~F.bool_or(sign * F.col("step") > mixtures.SLACK)).alias(n) for n, sign in (("lr_falls", 1), ("lr_rises", -1))])
    return fits.select(*keys).join(falls, keys, "left").join(lr, keys, "left").withColumn("ratios_fall", F.coalesce("ratios_fall", F.lit(True)))


def moment_component(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """The skew normal with the mean, variance and skewness that counts say; null for fewer than three rows or one single value.

    n, s1, s2 and s3 are the sums of 1, x, x**2 and x**3. A skew normal's skewness stays under 0.995, so a larger one is cut to 0.99.
    """
    mean = s1 / n
    var = s2 / n - mean * mean
    third = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    skew = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), third / F.pow(var, 1.5)))
    share = F.pow(F.abs(skew), 2 / 3)
    delta = F.signum(skew) * F.sqrt(math.pi / 2 * share / (share + ((4 - math.pi) / 2) ** (2 / 3)))
    scale = F.sqrt(var / (1 - 2 * delta * delta / math.pi))
    made = F.struct((delta / F.sqrt(1 - delta * delta)).alias("a"), (mean - scale * delta * math.sqrt(2 / math.pi)).alias("loc"), scale.alias("scale"))
    return F.when((n >= 3) & (var > 1e-9), made)


def moment_fits(counts: DataFrame, keys: list[str], rounds: int = 8) -> DataFrame:
    """A fit by moments for each of keys: one component a sample, in order of samples, and weights by expectation-maximisation with these components fixed.

    counts: keys, sample, x, n. Only fits whose samples all have a component are made; every round is one aggregation by sample.
    """
    x = F.col("x")
    sums = counts.groupBy(*keys, "sample").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * e).alias(f"s{i}") for i, e in ((1, x), (2, x * x), (3, x * x * x))], F.min(F.when(F.col("n") > 0, x)).alias("lo"), F.max(F.when(F.col("n") > 0, x)).alias("hi"))
    made = sums.select(*keys, "sample", "lo", "hi", moment_component(*[F.col(c) for c in ("n", "s1", "s2", "s3")]).alias("c"))
    of_fit = made.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "c"))), lambda v: v["c"]).alias("components"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.col("c").isNotNull()).alias("whole")).where("whole").drop("whole")
    even = F.transform("components", lambda c: 1 / F.size("components"))
    placed = counts.where("n > 0").join(of_fit, keys).withColumn("logs", F.transform("components", lambda c: skew_normal_log_pdf(x, c)))
    # A sample's counts, with their log densities, side by side: at most as many as there are bins.
    packed = placed.groupBy(*keys, "sample").agg(F.array_sort(F.collect_list(F.struct("x", "n", "logs"))).alias("bins"), F.first(even).alias("w"))
    for _ in range(rounds):
        packed = packed.withColumn("w", _reweighted(F.col("bins"), F.col("w")))
    weights = packed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sample", "w"))).alias("by_sample"))
    return of_fit.join(weights, keys).select(*keys, "lo", "hi", "components", F.array(*[F.try_element_at("by_sample", F.lit(s)) for s in range(4)]).alias("weights"))


def _reweighted(bins: Column, w: Column) -> Column:
    """Mean responsibilities of the components over the rows of bins."""

    def shares(b: Column) -> Column:
        joint = F.zip_with(b["logs"], w, lambda l, v: l + F.ln(F.greatest(v, F.lit(1e-300))))  # noqa: E741
        top = F.array_max(joint)
        parts = F.transform(joint, lambda v: F.exp(v - top))
        return F.transform(parts, lambda v: b["n"] * v / F.aggregate(parts, F.lit(0.0), lambda s, u: s + u))

    mass = F.aggregate(bins, F.transform(w, lambda v: F.lit(0.0)), lambda acc, b: F.zip_with(acc, shares(b), lambda s, v: s + v))
    rows = F.aggregate(bins, F.lit(0.0), lambda s, b: s + b["n"])
    return F.transform(mass, lambda v: v / rows)
