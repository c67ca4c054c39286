"""Rules over lines of evidence, isotonic curves, out-of-bag evidence and the choice among fits: DataFrame to DataFrame."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrade.functions.thresholds import lr_for_posterior, posterior_from_lr
from evigrade.operators.bootstrap import draws, times_drawn

#: The combining rules by class, bound on the posterior and strength in eighths of a very strong line, and how many rules have it.
RULES = {
    "P": (0.99, ((12, 2), (11, 1), (10, 5))),
    "LP": (0.90, ((6, 5), (8, 1))),
    "B": (0.01, ((-8, 1),)),
    "LB": (0.10, ((-5, 1), (-2, 1))),
}
LARGEST_CONSTANT = 100_000


def combined_class(n: dict[str, Column]) -> Column:
    """Class by counts of lines: pvs, ps, pm, pp for pathogenic, ba, bs, bm, bp for benign, from the strongest down. The first rule that holds counts."""
    pathogenic = ((n["pvs"] >= 1) & ((n["ps"] >= 1) | (n["pm"] >= 2))) | (n["ps"] >= 2) | ((n["ps"] == 1) & (n["pm"] >= 2))
    likely = ((n["pvs"] == 1) & (n["pm"] >= 1)) | ((n["ps"] == 1) & (n["pm"] == 1)) | (n["pm"] >= 3) | ((n["pm"] == 2) & (n["pp"] >= 2))
    return F.when(pathogenic, "P").when(likely, "LP").when((n["ba"] >= 1) | (n["bs"] >= 2), "B").when(((n["bs"] == 1) & (n["bp"] >= 1)) | (n["bm"] >= 2), "LB").otherwise("VUS")


def broken_rules(c: Column, prior: Column) -> Column:
    """How many combining rules miss their class's posterior when a very strong line has the likelihood ratio c."""
    missed = []
    for bound, rules in RULES.values():
        for eighths, times in rules:
            # Posteriors count in whole thousandths; round() on doubles would go through decimals, for millions of rows.
            posterior, limit = F.floor(posterior_from_lr(F.pow(c, F.lit(eighths / 8)), prior) * 1000 + 0.5), round(1000 * bound)
            missed.append(F.when(posterior < limit if eighths > 0 else posterior > limit, times).otherwise(0))
    return reduce(Column.__add__, missed)


def best_constants(priors: DataFrame, keys: list[str], prior: str, largest: int = LARGEST_CONSTANT) -> DataFrame:
    """For each row the smallest whole constant up to ``largest`` that breaks the fewest rules. priors holds a row a dataset, and a task a dataset's constants one by one."""
    tried = priors.select(*keys, prior, F.explode(F.sequence(F.lit(1), F.lit(largest))).alias("c"))
    rated = tried.select(*keys, prior, F.struct(broken_rules(F.col("c").cast("double"), F.col(prior)).alias("broken"), F.col("c").cast("long").alias("c")).alias("x"))
    return rated.groupBy(*keys, prior).agg(F.min("x").alias("x")).select(*keys, prior, "x.c", F.col("x.broken").cast("long").alias("broken"))


def combined_pair(a: Column, b: Column) -> Column:
    """Points of two assays of a variant: a missing one doesn't count, agreeing ones give the extreme, conflicting ones 0."""
    return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).when((F.least(a, b) < 0) & (F.greatest(a, b) > 0), 0).when(F.greatest(a, b) > 0, F.greatest(a, b)).otherwise(F.least(a, b))


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit of y that never falls."""
    level: list[tuple[float, float, int]] = []
    for mean, weight in zip(y.tolist(), w.tolist(), strict=True):
        pool = (mean, weight, 1)
        while level and level[-1][0] > pool[0]:
            m, v, n = level.pop()
            pool = ((m * v + pool[0] * pool[1]) / (v + pool[1]), v + pool[1], n + pool[2])
        level.append(pool)
    return np.repeat([p[0] for p in level], [p[2] for p in level]) if level else np.zeros(0)


def isotonic_curves(curves: DataFrame, key: str, at: str, y: str, weight: str) -> DataFrame:
    """key, at and fit. A group is one curve on its grid, aggregated before, so its size is the grid's and not the data's."""

    def fitted(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values(at)
        return pd.DataFrame({key: one[key], at: one[at], "fit": isotonic(one[y].to_numpy(float), one[weight].to_numpy(float))})

    types = dict(curves.dtypes)
    return curves.groupBy(key).applyInPandas(fitted, f"`{key}` {types[key]}, `{at}` {types[at]}, fit double")


def sorted_percentile(values: Column, q: float, last: Column | None = None) -> Column:
    """Percentile of a sorted array, or of as many of its last places as ``last`` says, linear between the places."""
    n = F.size(values) if last is None else last
    at, first = (n - 1) * F.lit(q), F.size(values) - n
    low, high = F.get(values, first + F.floor(at).cast("int")), F.get(values, first + F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def bootstrap_fits(rows: DataFrame, seeds: int) -> DataFrame:
    """A row a seed: two classes of equal variance fitted to the drawn rows, and the prior of the first. Fits without both classes or without variance go.

    A row's draws weigh it, so the rows are summed once, seed beside seed, and never copied.
    """
    labelled = rows.where("is_plp OR is_blb").select("score", "is_plp", *[t.alias(f"d{i}") for i, t in enumerate(draws(F.col("doc_id"), seeds))])
    x, p = F.col("score"), F.col("is_plp")
    of = lambda i: F.struct(F.lit(i).cast("long").alias("seed"), *[F.sum(F.when(c, F.col(f"d{i}") * v)).alias(n) for n, c, v in (("n1", p, F.lit(1)), ("s1", p, x), ("n0", ~p, F.lit(1)), ("s0", ~p, x), ("ss", F.lit(True), x * x))])
    sums = labelled.agg(F.array(*[of(i) for i in range(seeds)]).alias("fits")).select(F.explode("fits").alias("f")).select("f.*").where("n1 > 0 AND n0 > 0")
    n = F.col("n1") + F.col("n0")
    fits = sums.select("seed", (F.col("s1") / F.col("n1")).alias("m1"), (F.col("s0") / F.col("n0")).alias("m0"), (F.col("ss") / n - F.pow((F.col("s1") + F.col("s0")) / n, F.lit(2))).alias("v"), (F.col("n1") / n).alias("prior"))
    return fits.where("v > 0")


def out_of_bag_evidence(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Each row's evidence from the fits that didn't draw it. The fits, a row a seed, go to all tasks as one array; rows don't move."""
    packed = fits.agg(F.collect_list(F.struct("seed", "m1", "m0", "v", "prior")).alias("fits"))
    unseen = F.filter("fits", lambda f: times_drawn(F.col("doc_id"), f["seed"]) == 0)
    log_lr = F.array_sort(F.transform("unseen", lambda f: (f["m1"] - f["m0"]) * (F.col("score") - (f["m1"] + f["m0"]) / 2) / f["v"]))
    out = rows.crossJoin(F.broadcast(packed)).select("doc_id", "score", unseen.alias("unseen")).where(F.size("unseen") > 0)
    out = out.select("doc_id", log_lr.alias("lr"), F.array_sort(F.transform("unseen", lambda f: f["prior"])).alias("priors"))
    out = out.select("doc_id", F.size("lr").cast("long").alias("fits"), sorted_percentile(F.col("priors"), 0.5).alias("prior"), sorted_percentile(F.col("lr"), 0.05).alias("p5"), sorted_percentile(F.col("lr"), 0.95).alias("p95"))
    step = F.ln(lr_for_posterior(F.lit(0.99), F.col("prior"))) / 8
    points = F.when(F.col("p5") > 0, F.least(F.lit(8), F.floor(F.col("p5") / step))).when(F.col("p95") < 0, -F.least(F.lit(8), F.floor(-F.col("p95") / step))).otherwise(0)
    return out.withColumn("points", points.cast("long"))


def gaussian_criteria(rows: DataFrame, key: str, value: str, component: str) -> DataFrame:
    """One Gaussian for all rows of a key against one a component: log-likelihoods from sums, and BIC and AIC of both. Components without variance have no likelihood."""
    part = rows.groupBy(key, component).agg(F.count(value).alias("n"), F.var_pop(value).alias("v"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    ll = lambda n, v: -n / 2 * (F.ln(v) + math.log(2 * math.pi) + 1)
    both = part.where("v > 0").groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(ll(F.col("n"), F.col("v"))).alias("ll_split"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    n = F.col("n")
    both = both.withColumn("ll_one", ll(n, F.col("ss") / n - F.pow(F.col("s") / n, F.lit(2))))
    free = 3 * F.col("k") - 1
    return both.select(key, "n", "k", (2 * F.ln(n) - 2 * F.col("ll_one")).alias("bic_one"), (free * F.ln(n) - 2 * F.col("ll_split")).alias("bic_split"), (4 - 2 * F.col("ll_one")).alias("aic_one"), (2 * free - 2 * F.col("ll_split")).alias("aic_split"))
