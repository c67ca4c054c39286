"""Skew-normal mixtures with shared components and a weight for each sample and component, many fits side by side.

Scores are counted over all rows, by dataset, bootstrap seed, sample and bin, before anything is fitted; a bin stands at
the mean of its scores. A fit is a task of its own on at most samples x ``bins`` counts, whatever the number of rows, so
that datasets, seeds, numbers of components and restarts spread over the cluster.

Defined results: null and NaN scores are left out; a row in several samples counts in each; a dataset of one single score
has no fits; fits that fail have a null likelihood and are never the best; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrade.operators.bootstrap import seeds_of_blocks, with_block_draws
from evigrade.sources.staging import cut

SAMPLES = ("is_plp", "is_blb", "is_pop")
BINS, MAX_STEPS, TOLERANCE = 1024, 200, 1e-7
FIT = "n_c int, fit_idx int, steps int, train_ll double, val_ll double, components array<struct<a:double,loc:double,scale:double>>, weights array<array<double>>"
_ERFC = np.frompyfunc(math.erfc, 1, 1)


def counted_scores(rows: DataFrame, dataset: str, seeds: int, bins: int = BINS, row_id: str = "doc_id") -> DataFrame:
    """dataset, seed, sample, x, rows, n, unseen: the rows of a bin, how often the seed drew them, and how many of them it never drew.

    A row's draws are summed by blocks of eight seeds, so the plan is the same for any number of seeds.
    """
    ok = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    ends = ok.groupBy(dataset).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).where("hi > lo")
    member = F.filter(F.array(*[F.when(F.col(c), F.lit(i)) for i, c in enumerate(SAMPLES)]), lambda s: s.isNotNull())
    place = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    placed = ok.join(ends, dataset).select(dataset, "score", row_id, place.alias("bin"), member.alias("samples")).select("*", F.explode("samples").alias("sample"))
    drawn = with_block_draws(placed, row_id, seeds)
    sums = drawn.groupBy(dataset, "sample", "bin", "block").agg(F.avg("score").alias("x"), F.count("*").alias("rows"), *[c for i in range(8) for c in (F.sum(f"d{i}").alias(f"n{i}"), F.count_if(F.col(f"d{i}") == 0).alias(f"u{i}"))])
    found = seeds_of_blocks(sums, [dataset, "sample", "x", "rows"], {"n": [F.col(f"n{i}") for i in range(8)], "unseen": [F.col(f"u{i}") for i in range(8)]}, seeds)
    return found.select(dataset, "seed", "sample", "x", "rows", "n", "unseen")


def log_cdf(z: np.ndarray) -> np.ndarray:
    """Log of the standard normal distribution function; beyond -30 by its asymptote."""
    near = np.maximum(z, -30.0)
    far = np.minimum(z, -30.0)
    return np.where(z > -30, np.log(_ERFC(-near / math.sqrt(2)).astype(float) / 2), -far * far / 2 - np.log(-far) - math.log(2 * math.pi) / 2)


def component_log_pdf(x: np.ndarray, loc: np.ndarray, delta: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log densities, and first and second moments of the half-normal part, by component and place."""
    total = gamma + delta**2
    d = x[None, :] - loc[:, None]
    m, s = (delta / total)[:, None] * d, np.sqrt(gamma / total)[:, None]
    tail = log_cdf(m / s)
    hazard = np.exp(-((m / s) ** 2) / 2 - math.log(2 * math.pi) / 2 - tail)
    first = m + s * hazard
    return math.log(2) - d * d / (2 * total[:, None]) - np.log(2 * math.pi * total)[:, None] / 2 + tail, first, m * first + s * s


def start(x: np.ndarray, n: np.ndarray, k: int, fit_idx: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components from k slices of equal count; restarts differ in the signs of their skews and in shifts drawn by the key."""
    rng = np.random.default_rng(zlib.crc32(f"{seed}/{k}/{fit_idx}".encode()))
    order = np.argsort(x)
    share = np.minimum(k - 1, (np.cumsum(n[order]) - n[order] / 2) * k // n.sum()).astype(int)
    spread = math.sqrt(max(np.average((x - np.average(x, weights=n)) ** 2, weights=n), 1e-12))
    mean = np.array([np.average(x[order][share == j], weights=n[order][share == j]) if (share == j).any() else x.mean() for j in range(k)])
    sd, sign = spread / k, np.array([1 if fit_idx >> j & 1 else -1 for j in range(k)])
    return mean + rng.normal(0, 0.2 * sd, k) * (fit_idx > 0), 0.5 * sd * sign, np.full(k, sd * sd)


#: The density ratio of neighbouring components is looked at on so many places, where both log densities are above MASS.
RATIO_PLACES, MASS, HALVINGS, SLACK = 256, -7.0, 12, 1e-9


def ratio_falls(logs: list[np.ndarray]) -> bool:
    """Whether each component's log density over that of the next one never rises along the places, where both have mass."""
    for a, b in zip(logs, logs[1:], strict=False):
        seen = (a > MASS) & (b > MASS)
        if seen.sum() > 1 and (np.diff((a - b)[seen]) > SLACK).any():
            return False
    return True


class Constraint:
    """Parameters move towards what the maximisation asks for only as far as the density ratios of neighbours stay monotone.

    A parameter's conditional likelihood rises all the way to its maximum, so a part of the way never lowers it.
    """

    def __init__(self, low: float, high: float, loc: np.ndarray, delta: np.ndarray, gamma: np.ndarray) -> None:
        self.places = np.linspace(low, high, RATIO_PLACES)
        self.values = {"loc": loc, "delta": delta, "gamma": gamma}
        self.logs = [self._log(j, {}) for j in range(len(loc))]

    def _log(self, j: int, changed: dict) -> np.ndarray:
        own = [np.array([changed.get(n, v[j])]) for n, v in self.values.items()]
        return component_log_pdf(self.places, *own)[0][0]

    def moved(self, name: str, asked: np.ndarray) -> np.ndarray:
        """The parameter of that name of all components, moved towards asked one component after the other."""
        own = self.values[name] = self.values[name].copy()
        for j, to in enumerate(asked):
            low, share = 0.0, 1.0
            for _ in range(HALVINGS):
                value = own[j] + share * (to - own[j])
                logs = [*self.logs[:j], self._log(j, {name: value}), *self.logs[j + 1 :]]
                if ratio_falls(logs[max(j - 1, 0) : j + 2]):
                    low, kept = share, (value, logs)
                    if share == 1:
                        break
                    share += (high - share) / 2
                else:
                    high = share
                    share = (low + share) / 2
            if low:
                own[j], self.logs = kept
        return own


def fit_mixture(sample: np.ndarray, x: np.ndarray, n: np.ndarray, k: int, fit_idx: int, seed: int, max_steps: int = MAX_STEPS, constrained: bool = False) -> dict:
    """Expectation-maximisation on counts; log-likelihoods by step are in ``trace`` and never fall.

    A constrained fit begins with one skew and one scale for all components, whose density ratios are monotone, and keeps
    them so in every step.
    """
    s_of, samples = sample.astype(int), len(SAMPLES)
    use, n = n > 0, n.astype(float)
    s_of, x, n = s_of[use], x[use], n[use]
    loc, delta, gamma = start(x, n, k, fit_idx, seed)
    w, trace, floor = np.full((samples, k), 1 / k), [], 1e-6 * max(np.ptp(x), 1e-9) ** 2
    held = None
    if constrained:
        order = np.argsort(loc)
        loc, delta = loc[order], np.full(k, abs(delta[0]) * (-1) ** fit_idx)
        held = Constraint(x.min(), x.max(), loc, delta, gamma)
    for _ in range(max_steps):
        lp, v1, v2 = component_log_pdf(x, loc, delta, gamma)
        joint = lp + np.log(np.maximum(w[s_of].T, 1e-300))
        top = joint.max(0)
        total = top + np.log(np.exp(joint - top).sum(0))
        trace.append(float((n * total).sum()))
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) <= TOLERANCE * abs(trace[-2]):
            break
        r = np.exp(joint - total) * n
        mass = np.maximum(r.sum(1), 1e-12)
        to = lambda name, asked: held.moved(name, asked) if held else asked
        loc = to("loc", (r * (x - v1 * delta[:, None])).sum(1) / mass)
        d = x[None, :] - loc[:, None]
        delta = to("delta", (r * v1 * d).sum(1) / np.maximum((r * v2).sum(1), 1e-12))
        gamma = to("gamma", np.maximum((r * (d * d - 2 * delta[:, None] * v1 * d + delta[:, None] ** 2 * v2)).sum(1) / mass, floor))
        w = np.stack([r[:, s_of == s].sum(1) / max(n[s_of == s].sum(), 1e-12) if (s_of == s).any() else np.full(k, 1 / k) for s in range(samples)])
    # A constrained fit's components are in the order of their ratios.
    order = np.arange(k) if constrained else np.argsort(loc + delta * math.sqrt(2 / math.pi))
    return {"loc": loc[order], "delta": delta[order], "gamma": gamma[order], "w": w[:, order], "trace": trace}


def log_likelihood(sample: np.ndarray, x: np.ndarray, n: np.ndarray, m: dict) -> float:
    """Mean over the rows counted in n; NaN without rows."""
    lp = component_log_pdf(x, m["loc"], m["delta"], m["gamma"])[0]
    joint = lp + np.log(np.maximum(m["w"][sample.astype(int)].T, 1e-300))
    top = joint.max(0)
    return float((n * (top + np.log(np.exp(joint - top).sum(0)))).sum() / n.sum()) if n.sum() else math.nan


def mixture_fits(counts: DataFrame, dataset: str, components: tuple[int, ...] = (2, 3), restarts: int = 2, constrained: bool = False) -> DataFrame:
    """A row a fit: dataset, seed, n_c, fit_idx, likelihoods a row on drawn and unseen rows, components by rising mean, weights by sample."""
    spark, kind = counts.sparkSession, dict(counts.dtypes)[dataset]
    grid = spark.createDataFrame([(k, i) for k in components for i in range(restarts)], "n_c int, fit_idx int")

    def fitted(one: pd.DataFrame) -> pd.DataFrame:
        first = one.iloc[0]
        one = one.sort_values(["sample", "x"])
        s, x, n, unseen = (one[c].to_numpy() for c in ("sample", "x", "n", "unseen"))
        k, i = int(first.n_c), int(first.fit_idx)
        if n.sum() == 0 or np.ptp(x[n > 0]) == 0:
            return pd.DataFrame()
        m = fit_mixture(s, x, n, k, i, int(first.seed), constrained=constrained)
        parts = [{"a": float(d / math.sqrt(g)), "loc": float(c), "scale": math.sqrt(g + d * d)} for c, d, g in zip(m["loc"], m["delta"], m["gamma"], strict=True)]
        return pd.DataFrame([{dataset: first[dataset], "seed": first.seed, "n_c": k, "fit_idx": i, "steps": len(m["trace"]), "train_ll": log_likelihood(s, x, n, m), "val_ll": log_likelihood(s, x, unseen, m), "components": parts, "weights": m["w"].tolist()}])

    fits = counts.crossJoin(F.broadcast(grid)).groupBy(dataset, "seed", "n_c", "fit_idx").applyInPandas(fitted, f"`{dataset}` {kind}, seed long, {FIT}")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return fits.select(*[finite(c) if c in ("train_ll", "val_ll") else c for c in fits.columns])


def best_fits(fits: DataFrame, dataset: str) -> DataFrame:
    """Of the restarts that of the highest likelihood on unseen rows, then of the smallest number; failed fits never."""
    row = F.struct(*[c for c in fits.columns if c not in (dataset, "seed", "n_c")])
    best = fits.where("val_ll IS NOT NULL").groupBy(dataset, "seed", "n_c").agg(F.max_by(row, F.struct("val_ll", -F.col("fit_idx"))).alias("fit"))
    return best.select(dataset, "seed", "n_c", "fit.*")


def best_of(sample: np.ndarray, x: np.ndarray, n: np.ndarray, k: int, restarts: int, seed: int, **options) -> tuple[float, dict]:
    """The summed log-likelihood and the fit of the best of the restarts."""
    fits = [fit_mixture(sample, x, n, k, i, seed, **options) for i in range(restarts)]
    lls = [log_likelihood(sample, x, n, m) * n.sum() for m in fits]
    return max(lls), fits[int(np.argmax(lls))]


def simulated_counts(m: dict, sizes: list[int], low: float, high: float, bins: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sample, x and n of as many draws from the mixture as each sample has rows, counted by bin at once: no draw is ever a row."""
    x = low + (np.arange(bins) + 0.5) * (high - low) / bins
    pdf = np.exp(component_log_pdf(x, m["loc"], m["delta"], m["gamma"])[0])
    n = [rng.multinomial(size, (p := w @ pdf) / p.sum()) if size else np.zeros(bins, int) for w, size in zip(m["w"], sizes, strict=True)]
    return np.repeat(np.arange(len(sizes)), bins), np.tile(x, len(sizes)), np.concatenate(n)


def likelihood_ratio_test(counts: DataFrame, dataset: str, simulations: int = 19, small: int = 2, large: int = 3, restarts: int = 2, bins: int = BINS, **options) -> DataFrame:
    """dataset, statistic and p: whether the larger mixture is likelier than chance makes it where the smaller one is true.

    Both are fitted to the counts (dataset, sample, x, rows) and to ``simulations`` draws of the same size from the smaller fit, each in a
    task of its own; p is one more than the simulations that reach the statistic, over one more than all of them. Datasets of one value have no row.
    """
    kind = dict(counts.dtypes)[dataset]
    model = "loc array<double>, delta array<double>, gamma array<double>, w array<array<double>>, sizes array<long>, low double, high double"

    def observed(one: pd.DataFrame) -> pd.DataFrame:
        s, x, n = (one[c].to_numpy() for c in ("sample", "x", "rows"))
        if not len(x) or np.ptp(x) == 0:
            return pd.DataFrame()
        (ll, m), (more, _) = (best_of(s, x, n, k, restarts, 0, **options) for k in (small, large))
        sizes = [int(n[s == i].sum()) for i in range(len(SAMPLES))]
        return pd.DataFrame([{dataset: one[dataset].iloc[0], "statistic": 2 * (more - ll), **{c: m[c].tolist() for c in ("loc", "delta", "gamma", "w")}, "sizes": sizes, "low": x.min(), "high": x.max()}])

    def again(one: pd.DataFrame) -> pd.DataFrame:
        r = one.iloc[0]
        m = {c: np.array(list(r[c]), float) for c in ("loc", "delta", "gamma")} | {"w": np.stack(list(r.w))}
        rng = np.random.default_rng(zlib.crc32(f"{r[dataset]}/{r.simulation}".encode()))
        s, x, n = simulated_counts(m, list(r.sizes), r.low, r.high, bins, rng)
        ll, more = (best_of(s, x, n, k, restarts, 0, **options)[0] for k in (small, large))
        return pd.DataFrame([{dataset: r[dataset], "simulated": 2 * (more - ll)}])

    found = cut(counts.select(dataset, "sample", "x", "rows").groupBy(dataset).applyInPandas(observed, f"`{dataset}` {kind}, statistic double, {model}"), "ratio-observed")
    each = found.withColumn("simulation", F.explode(F.sequence(F.lit(1), F.lit(simulations)))).drop("statistic")
    drawn = each.groupBy(dataset, "simulation").applyInPandas(again, f"`{dataset}` {kind}, simulated double")
    reached = found.select(dataset, "statistic").join(drawn, dataset).groupBy(dataset, "statistic").agg(F.count_if(F.col("simulated") >= F.col("statistic")).alias("reached"))
    return reached.select(dataset, "statistic", ((1 + F.col("reached")) / (1 + simulations)).alias("p"))


def class_prior(f1: np.ndarray, f2: np.ndarray, n: np.ndarray, steps: int = 10_000, tolerance: float = 1e-6) -> float:
    """Share of the first class in the population: fixed point from 0.5; NaN if it ends within a thousandth of 0 or 1. Places where both densities are 0 say nothing."""
    seen = (f1 > 0) | (f2 > 0)
    f1, f2, n = f1[seen], f2[seen], n[seen]
    if not n.sum():
        return math.nan
    prior = 0.5
    for _ in range(steps):
        after = float(np.average(prior * f1 / (prior * f1 + (1 - prior) * f2), weights=n))
        done, prior = abs(after - prior) < tolerance, after
        if done or not 0 < prior < 1:
            break
    return prior if 0.001 < prior < 0.999 else math.nan


#: Priors where one class has no sample: without any place to judge by, the least one that is told, and from where on it isn't.
NO_SIGNAL, LEAST, MOST = 0.1, 0.01, 0.99


def one_class_prior(labelled: np.ndarray, population: np.ndarray, pathogenic: bool) -> float:
    """Share of the pathogenic class from the density of one labelled class and of the population: the labelled class can't outweigh the population anywhere."""
    at = labelled > 0
    if not at.any():
        return NO_SIGNAL
    bound = float((population[at] / labelled[at]).min())
    prior = bound if pathogenic else 1 - bound
    return math.nan if prior >= MOST or prior < 0 else max(prior, LEAST)


def density_priors(best: DataFrame, counts: DataFrame, dataset: str) -> DataFrame:
    """dataset, seed, n_c, prior: class densities of each best fit at the population's scores; discarded priors are null."""
    kind = dict(best.dtypes)[dataset]
    pop = counts.where(F.col("sample") == SAMPLES.index("is_pop")).select(dataset, "seed", "x", "rows")
    keyed = pop.join(best.select(dataset, "seed", "n_c", "components", "weights"), [dataset, "seed"])

    def prior(one: pd.DataFrame) -> pd.DataFrame:
        first = one.iloc[0]
        a, loc, scale = (np.array([p[c] for p in first.components]) for c in ("a", "loc", "scale"))
        pdf = np.exp(component_log_pdf(one.x.to_numpy(), loc, scale * a / np.sqrt(1 + a * a), scale**2 / (1 + a * a))[0])
        w = np.stack(list(first.weights))
        return pd.DataFrame([{dataset: first[dataset], "seed": first.seed, "n_c": first.n_c, "prior": class_prior(w[0] @ pdf, w[1] @ pdf, one.rows.to_numpy())}])

    found = keyed.groupBy(dataset, "seed", "n_c").applyInPandas(prior, f"`{dataset}` {kind}, seed long, n_c int, prior double")
    return found.withColumn("prior", F.when(~F.isnan("prior"), F.col("prior")))


def quantile_distance(rows: DataFrame, key: str, points: int = 99) -> DataFrame:
    """key and distance: root mean square between the quantile functions of the first two samples; null where one is missing."""
    at = F.array(*[F.lit((i + 1) / (points + 1)) for i in range(points)])
    both = rows.groupBy(key).agg(*[F.percentile(F.when(F.col(c) & ~F.isnan("score"), F.col("score")), at).alias(c) for c in SAMPLES[:2]])
    squares = F.zip_with(SAMPLES[0], SAMPLES[1], lambda p, b: (p - b) * (p - b))
    return both.select(key, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / points).alias("distance"))
