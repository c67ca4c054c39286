"""Mixtures of multivariate skew normals on scores with gaps: densities, fits, priors and ratios by pattern of what is there.

A component is mu + delta T + noise of covariance gamma, T half-normal, one factor for the fits and one or two for
densities. What a row lacks is left out of its density, which is the component's own marginal, and expected given what it
has in the fits. Rows are worked in Arrow batches, grouped by pattern; factors of a pattern's matrices are made once a batch.

A step of expectation-maximisation is one pass over all rows for all fits at once: each task adds up a fixed number of
sums a fit, these are added by fit and place in Spark, and the driver solves for the parameters, at most fits x components x
dimensions squared numbers. So a fit needs no row in one place, and bootstraps and restarts share the pass.

Defined results: a row without any value says nothing (its density is 1) and is left out of fits; a row in several samples
counts in each; NaN is a gap; a component that loses all its rows keeps its parameters; fits that start from fewer than
two rows a sample and dimension take the whole table's moments there; empty tables have no fits and no ratios.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrade.operators import mixtures, patterns
from evigrade.sources.staging import cut

LOG_TAU = math.log(2 * math.pi)
#: Nodes of the quadrature of the bivariate normal distribution.
NODES = 64
MODES = ("gate", "trust_global", "project", "local_unmixing")


def by_pattern(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimensions that are there, rows) of each pattern in x, NaN being a gap."""
    seen = ~np.isnan(x)
    kinds, of = np.unique(seen, axis=0, return_inverse=True)
    for i, kind in enumerate(kinds):
        yield np.flatnonzero(kind), np.flatnonzero(of.ravel() == i)


def log_cdf_2(h: np.ndarray, k: np.ndarray, rho: float) -> np.ndarray:
    """Log of the bivariate normal distribution function with unit variances and correlation rho, by Gauss-Legendre on the angle."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    top = math.asin(max(-1.0, min(1.0, rho)))
    theta = top * (nodes + 1) / 2
    s, c2 = np.sin(theta), np.cos(theta) ** 2
    inner = np.exp(-(h[:, None] ** 2 + k[:, None] ** 2 - 2 * h[:, None] * k[:, None] * s) / (2 * c2))
    both = np.exp(mixtures.log_cdf(h) + mixtures.log_cdf(k)) + inner @ weights * top / (4 * math.pi)
    return np.log(np.maximum(both, 1e-300))


def log_density(x: np.ndarray, mu: np.ndarray, delta: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Log density of one component at the rows of x; delta has a column a factor, at most two. Rows without values have 0."""
    delta = delta.reshape(len(mu), -1)
    if delta.shape[1] > 2:
        raise ValueError("more than two factors")
    out = np.zeros(len(x))
    for dims, rows in by_pattern(x):
        if not len(dims):
            continue
        d, r = delta[dims], x[np.ix_(rows, dims)] - mu[dims]
        omega = gamma[np.ix_(dims, dims)] + d @ d.T
        inverse, (_, log_det) = np.linalg.inv(omega), np.linalg.slogdet(omega)
        eta, left = r @ inverse @ d, np.eye(d.shape[1]) - d.T @ inverse @ d
        sd = np.sqrt(np.maximum(np.diag(left), 1e-12))
        tail = mixtures.log_cdf(eta[:, 0] / sd[0]) if d.shape[1] == 1 else log_cdf_2(eta[:, 0] / sd[0], eta[:, 1] / sd[1], left[0, 1] / (sd[0] * sd[1]))
        out[rows] = d.shape[1] * math.log(2) - (len(dims) * LOG_TAU + log_det + np.einsum("ni,ij,nj->n", r, inverse, r)) / 2 + tail
    return out


def log_mixture(logs: np.ndarray, w: np.ndarray) -> np.ndarray:
    joint = logs + np.log(np.maximum(w, 1e-300))[:, None]
    top = joint.max(0)
    return top + np.log(np.exp(joint - top).sum(0))


def statistics(x: np.ndarray, mu: np.ndarray, delta: np.ndarray, gamma: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sums over rows, weighted by r, of 1, T, T**2, x, x T and x x', given what the rows have: 3 + 2 d + d**2 numbers."""
    d = len(mu)
    out = np.zeros(3 + 2 * d + d * d)
    for dims, rows in by_pattern(x):
        if not len(dims):
            continue
        rest = np.setdiff1d(np.arange(d), dims)
        ds, res, weight = delta[dims], x[np.ix_(rows, dims)] - mu[dims], r[rows]
        solved = np.linalg.solve(gamma[np.ix_(dims, dims)] + np.outer(ds, ds), ds)
        m, s = res @ solved, math.sqrt(max(1 - ds @ solved, 1e-12))
        hazard = np.exp(-((m / s) ** 2) / 2 - LOG_TAU / 2 - mixtures.log_cdf(m / s))
        v = m + s * hazard
        w = m * v + s * s
        full = np.empty((len(rows), d))
        slope = np.zeros(d)  # of what is expected in T
        full[:, dims] = x[np.ix_(rows, dims)]
        extra = np.zeros((d, d))
        if len(rest):
            b = gamma[np.ix_(rest, dims)] @ np.linalg.inv(gamma[np.ix_(dims, dims)])
            slope[rest] = delta[rest] - b @ ds
            full[:, rest] = mu[rest] + res @ b.T
            extra[np.ix_(rest, rest)] = gamma[np.ix_(rest, rest)] - b @ gamma[np.ix_(dims, rest)]
        ex, ext = full + np.outer(v, slope), full * v[:, None] + np.outer(w, slope)
        cross = np.outer((weight * v) @ full, slope)
        exx = (full * weight[:, None]).T @ full + cross + cross.T + (weight @ w) * np.outer(slope, slope) + weight.sum() * extra
        out += np.concatenate([[weight.sum(), weight @ v, weight @ w], weight @ ex, weight @ ext, exx.ravel()])
    return out


def maximised(sums: np.ndarray, old: tuple[np.ndarray, np.ndarray, np.ndarray], floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mu, delta and gamma from the sums of one component; the eigenvalues of gamma are at least floor."""
    d = len(old[0])
    n, v, w = sums[:3]
    if n < 1e-9:
        return old
    sx, sxt, sxx = sums[3 : 3 + d], sums[3 + d : 3 + 2 * d], sums[3 + 2 * d :].reshape(d, d)
    mu, delta = np.linalg.solve(np.array([[n, v], [v, w]]), np.stack([sx, sxt]))
    gamma = (sxx - np.outer(mu, sx) - np.outer(delta, sxt)) / n
    values, vectors = np.linalg.eigh((gamma + gamma.T) / 2)
    return mu, delta, vectors * np.maximum(values, floor) @ vectors.T


def gap_moments(rows: DataFrame, dims: list[str]) -> DataFrame:
    """sample, i, j, n, si, sj, sij, and for i = j also the sums of squares and cubes: sums over the rows that have both dimensions, one pass."""
    pairs = [(i, j) for i in range(len(dims)) for j in range(i, len(dims))]
    both = F.explode(F.array(*[F.when(F.col(dims[i]).isNotNull() & F.col(dims[j]).isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(dims[i]).alias("x"), F.col(dims[j]).alias("y"))) for i, j in pairs])).alias("p")
    each = rows.select(F.explode("samples").alias("sample"), both).where("p IS NOT NULL").select("sample", "p.*")
    x, y = F.col("x"), F.col("y")
    return each.groupBy("sample", "i", "j").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x * x).alias("sx3"))


def skew_weight(n: float, skew: float) -> float:
    """How far a skewness is to be believed: one less its squared standard error over its square, not below 0; 0 for fewer than eight rows."""
    if n < 8 or not skew:
        return 0.0
    error = 6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))
    return max(0.0, 1 - error / (skew * skew))


def start(moments: list, samples: int, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components anchored at the samples, the first k of them: means, covariances of pairs that are there, and skews as far as they are to be believed.

    A covariance that isn't positive is mended by its eigenvalues. A dimension that a sample lacks takes all samples' moments.
    """
    by, whole = {}, {}
    for r in moments:
        at = np.array([r["n"], r["sx"], r["sy"], r["sxy"], r["sx3"]], float)
        by[r["sample"], r["i"], r["j"]] = at
        whole[r["i"], r["j"]] = whole.get((r["i"], r["j"]), 0) + at
    mu, delta, gamma = np.zeros((k, d)), np.zeros((k, d)), np.zeros((k, d, d))
    for c in range(k):
        of = lambda i, j: by[c, i, j] if by.get((c, i, j), [0])[0] >= 2 else whole.get((i, j), np.zeros(5))  # noqa: B023, E731
        sd = np.ones(d)
        for i in range(d):
            n, sx, _, sxx, sx3 = of(i, i)
            if n >= 2:
                mean, var = sx / n, max(sxx / n - (sx / n) ** 2, 1e-9)
                sd[i] = math.sqrt(var)
                skew = (sx3 / n - 3 * mean * sxx / n + 2 * mean**3) / var**1.5
                share = (skew_weight(n, skew) * min(abs(skew), 0.99)) ** (2 / 3)
                bent = math.copysign(math.sqrt(math.pi / 2 * share / (share + ((4 - math.pi) / 2) ** (2 / 3))), skew)
                scale = sd[i] / math.sqrt(1 - 2 * bent * bent / math.pi)
                # Never symmetric altogether: a delta of 0 would stay there.
                delta[c, i] = scale * (bent or 0.1)
                mu[c, i] = mean - delta[c, i] * math.sqrt(2 / math.pi)
        for i in range(d):
            for j in range(i, d):
                n, sx, sy, sxy, _ = of(i, j)
                cov = sxy / n - sx * sy / (n * n) if n >= 2 else 0.0
                gamma[c, i, j] = gamma[c, j, i] = cov + 2 / math.pi * delta[c, i] * delta[c, j]
        gamma[c] -= np.outer(delta[c], delta[c])
        values, vectors = np.linalg.eigh(gamma[c])
        gamma[c] = vectors * np.maximum(values, 0.05 * (sd**2).min()) @ vectors.T
    return mu, delta, gamma


def _matrix(b: pa.RecordBatch, dims: list[str]) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in dims]) if b.num_rows else np.zeros((0, len(dims)))


def fit(rows: DataFrame, dims: list[str], samples: int, k: int, seeds: int = 1, steps: int = 40, tolerance: float = 1e-7) -> list[dict]:
    """A fit for each seed: seed, mu, delta, gamma, w (samples x k) and trace, the mean log-likelihoods by step.

    rows: dims, samples (the indices of a row's samples) and times (how often each seed draws the row). k is at most samples.
    """
    d, size = len(dims), 3 + 2 * len(dims) + len(dims) ** 2
    kept = rows.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in dims])).select(*[F.when(~F.isnan(c), F.col(c)).cast("double").alias(c) for c in dims], "samples", "times")
    moments = gap_moments(kept, dims).collect()
    if not moments:
        return []
    begun = start(moments, samples, d, k)
    floor = 1e-4 * min(max(r["sxy"] / r["n"] - (r["sx"] / r["n"]) ** 2, 1e-9) for r in moments if r["i"] == r["j"])
    fits = [{"seed": s, "mu": begun[0], "delta": begun[1], "gamma": begun[2], "w": np.full((samples, k), 1 / k), "trace": []} for s in range(seeds)]
    spark = rows.sparkSession
    for _ in range(steps):
        going = [f for f in fits if len(f["trace"]) < 2 or abs(f["trace"][-1] - f["trace"][-2]) > tolerance * abs(f["trace"][-2])]
        if not going:
            break
        sent = spark.sparkContext.broadcast([{n: f[n] for n in ("seed", "mu", "delta", "gamma", "w")} for f in going])

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(sent.value), k * size + samples * k + 2))
            for b in batches:
                x, times = _matrix(b, dims), np.array(b.column("times").to_pylist()).reshape(b.num_rows, -1)
                member = np.zeros((samples, b.num_rows))
                for i, own in enumerate(b.column("samples").to_pylist()):
                    member[own or [], i] = 1
                for f, out in zip(sent.value, sums, strict=True):
                    n = times[:, f["seed"]].astype(float)
                    logs = np.stack([log_density(x, f["mu"][c], f["delta"][c], f["gamma"][c]) for c in range(k)])
                    r_all = np.zeros((k, b.num_rows))
                    for s in range(samples):
                        total = log_mixture(logs, f["w"][s])
                        r = np.exp(logs + np.log(np.maximum(f["w"][s], 1e-300))[:, None] - total) * (n * member[s])
                        r_all += r
                        out[k * size + s * k : k * size + (s + 1) * k] += r.sum(1)
                        out[-2:] += (n * member[s] * total).sum(), (n * member[s]).sum()
                    for c in range(k):
                        out[c * size : (c + 1) * size] += statistics(x, f["mu"][c], f["delta"][c], f["gamma"][c], r_all[c])
            yield pa.RecordBatch.from_arrays([pa.array([f["seed"] for f in sent.value], pa.int64()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["seed", "sums"])

        parts = kept.mapInArrow(step, "seed long, sums array<double>").select("seed", F.posexplode("sums").alias("place", "v"))
        added = {(r["seed"], r["place"]): r["v"] for r in parts.groupBy("seed", "place").agg(F.sum("v").alias("v")).collect()}
        for f in going:
            sums = np.array([added[f["seed"], i] for i in range(k * size + samples * k + 2)])
            f["trace"].append(sums[-2] / max(sums[-1], 1e-12))
            new = [maximised(sums[c * size : (c + 1) * size], (f["mu"][c], f["delta"][c], f["gamma"][c]), floor) for c in range(k)]
            f["mu"], f["delta"], f["gamma"] = (np.stack([p[i] for p in new]) for i in range(3))
            counts = sums[k * size : -2].reshape(samples, k)
            f["w"] = np.where(counts.sum(1, keepdims=True) > 0, counts / np.maximum(counts.sum(1, keepdims=True), 1e-12), f["w"])
    return fits


def class_densities(rows: DataFrame, dims: list[str], model: dict, mask: str | None = None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """keep and log_p, log_b, log_pop at each row, from the dimensions in the column ``mask`` only, if it is given. model: mu, delta, gamma and w."""
    sent = rows.sparkSession.sparkContext.broadcast({n: np.asarray(model[n], float) for n in ("mu", "delta", "gamma", "w")})
    names = [*keep, "log_p", "log_b", "log_pop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = _matrix(b, dims)
            if mask:
                bits = b.column("_mask").to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.where((bits[:, None] >> np.arange(len(dims))) & 1, x, np.nan)
            logs = np.stack([log_density(x, *(m[n][c] for n in ("mu", "delta", "gamma"))) for c in range(len(m["mu"]))])
            nothing = np.isnan(x).all(1)
            made = [pa.array(log_mixture(logs, w), pa.float64(), mask=nothing) for w in m["w"][:3]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made], names)

    asked = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in dims], *([F.coalesce(F.col(mask), F.lit(0)).cast("long").alias("_mask")] if mask else []))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name in keep)
    return asked.mapInArrow(run, (kinds + ", " if kinds else "") + "log_p double, log_b double, log_pop double")


def support(counts: DataFrame, dims: int, least: int, label: str = "sample", names: tuple[str, str, str] = ("P", "B", "population")) -> DataFrame:
    """mask, has_p, has_b and has_pop (whether at least ``least`` rows of that sample have all of the pattern) and sub, its largest part that both classes have."""
    shown = counts.select("mask").where("mask > 0").distinct()
    over = shown.join(counts.withColumnRenamed("mask", "_m"), F.expr("_m & mask = mask"))
    has = over.groupBy("mask").agg(*[(F.sum(F.when(F.col(label) == name, F.col("n")).otherwise(0)) >= least).alias(n) for n, name in zip(("has_p", "has_b", "has_pop"), names, strict=True)])
    part = patterns.supported_subsets(counts, dims, label, list(names[:2]), least).withColumnRenamed("supported", "sub")
    return has.join(part, "mask", "left")


def pattern_ratios(rows: DataFrame, dims: list[str], key: str, model: dict, supported: DataFrame, prior: float, mode: str) -> DataFrame:
    """key, mask and l, the log ratio of both classes at each row.

    gate: null where the second class lacks the pattern. trust_global: the fit is trusted everywhere. project: only the largest
    part of the pattern that both classes have counts. local_unmixing: the density of a class that lacks the pattern is what
    the population leaves without the other class, where those two have it. The last two trust the fit where nothing else is told.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    masked = rows.select(key, *dims).withColumn("mask", patterns.pattern(dims)).join(F.broadcast(supported), "mask", "left")
    used = masked.withColumn("used", F.coalesce("sub", "mask") if mode == "project" else F.col("mask"))
    seen = class_densities(used, dims, model, "used", [key, "mask", "has_p", "has_b", "has_pop"])
    p, b, pop, plain = F.col("log_p"), F.col("log_b"), F.col("log_pop"), F.col("log_p") - F.col("log_b")
    if mode == "gate":
        plain = F.when(F.col("has_b"), plain)
    if mode == "local_unmixing":
        left = lambda share, own: pop + F.ln(F.greatest((1 - share * F.exp(own - pop)) / (1 - share), F.lit(1e-10)))
        plain = F.when(F.col("has_p") & ~F.col("has_b") & F.col("has_pop"), p - left(prior, p)).when(~F.col("has_p") & F.col("has_b") & F.col("has_pop"), left(1 - prior, b) - b).otherwise(plain)
    return seen.select(key, "mask", plain.alias("l"))


def pattern_prior(rows: DataFrame, dims: list[str], model: dict, digits: int = 3) -> float:
    """The share of the first class in the population: the fixed point over the counts of the rows' log ratios, rounded to ``digits``."""
    ratio = F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("log_p") - F.col("log_b"))), digits)
    counts = cut(class_densities(rows, dims, model).where("log_p IS NOT NULL").groupBy(ratio.alias("l")).agg(F.count("*").alias("n")), "ratio-counts").toArrow()
    l, n = (counts.column(c).to_numpy().astype(float) for c in ("l", "n"))  # noqa: E741
    return mixtures.class_prior(np.exp(np.minimum(l, 0)), np.exp(-np.maximum(l, 0)), n)
