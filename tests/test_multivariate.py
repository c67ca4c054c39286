"""Multivariate skew normals with gaps: densities against integration, fits on planted rows, ratios by pattern by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrade.operators import mixtures, patterns
from evigrade.operators import multivariate as op
from evigrade.operators.stratified import sized_draws

MU, DELTA = np.array([0.5, -1.0, 2.0]), np.array([1.2, -0.7, 0.4])
GAMMA = np.array([[0.8, 0.2, -0.1], [0.2, 0.5, 0.1], [-0.1, 0.1, 0.6]])
TWO = np.stack([DELTA, [0.3, 0.9, -0.8]], axis=1)
NAN = math.nan


def normal(x, mean, cov):
    r = x - mean
    return math.exp(-(len(x) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + r @ np.linalg.solve(cov, r)) / 2)


ROWS = np.array([[0.1, -2.0, 2.5], [1.5, NAN, 2.0], [NAN, NAN, 3.0], [NAN, -1.0, NAN], [4.0, -3.0, 1.0], [NAN, NAN, NAN]])


def test_density_is_the_integral_over_one_factor():
    t = np.linspace(0, 10, 4001)
    for x, got in zip(ROWS, op.log_density(ROWS, MU, DELTA, GAMMA), strict=True):
        at = np.flatnonzero(~np.isnan(x))
        f = [2 * math.exp(-v * v / 2) / math.sqrt(2 * math.pi) * normal(x[at], MU[at] + DELTA[at] * v, GAMMA[np.ix_(at, at)]) for v in t] if len(at) else [0.1] * len(t)
        assert math.isclose(math.exp(got), np.trapezoid(f, t), rel_tol=1e-6)


def test_density_is_the_integral_over_two_factors():
    nodes, weight = np.polynomial.legendre.leggauss(160)
    t, weight = 4.5 * (nodes + 1), 4.5 * weight
    for x, got in zip(ROWS[:5], op.log_density(ROWS[:5], MU, TWO, GAMMA), strict=True):
        at = np.flatnonzero(~np.isnan(x))
        d, cov = TWO[at], GAMMA[np.ix_(at, at)]
        r = (x[at] - MU[at])[:, None, None] - d[:, :1, None] * t[:, None] - d[:, 1:, None] * t[None, :]
        dense = np.exp(-(np.einsum("iab,ij,jab->ab", r, np.linalg.inv(cov), r) + np.linalg.slogdet(cov)[1] + len(at) * op.LOG_TAU) / 2) * 4 / (2 * math.pi) * np.exp(-(t[:, None] ** 2 + t[None, :] ** 2) / 2)
        assert math.isclose(math.exp(got), weight @ dense @ weight, rel_tol=1e-6)


def test_bivariate_distribution():
    for h, k, rho in ((0.0, 0.0, 0.5), (1.0, -0.5, -0.7), (-1.5, -1.0, 0.9), (0.3, 2.0, 0.0)):
        z = np.linspace(-9, h, 20001)
        inner = np.exp(mixtures.log_cdf((k - rho * z) / math.sqrt(1 - rho * rho)) - z * z / 2) / math.sqrt(2 * math.pi)
        assert math.isclose(math.exp(op.log_cdf_2(np.array([h]), np.array([k]), rho)[0]), np.trapezoid(inner, z), rel_tol=1e-6)


def test_statistics_of_gaps_are_those_of_draws():
    """What is expected of the missing values, against a large sample drawn given the present ones."""
    rng = np.random.default_rng(1)
    x = np.array([[0.9, NAN, NAN]])
    got = op.statistics(x, MU, DELTA, GAMMA, np.ones(1))
    total = GAMMA[0, 0] + DELTA[0] ** 2
    m, s = DELTA[0] * (0.9 - MU[0]) / total, math.sqrt(GAMMA[0, 0] / total)
    t = rng.normal(m, s, 2_000_000)
    t = t[t > 0]
    b = GAMMA[1:, 0] / GAMMA[0, 0]
    rest = MU[1:] + np.outer(0.9 - MU[0] - DELTA[0] * t, b) + np.outer(t, DELTA[1:]) + rng.multivariate_normal(np.zeros(2), GAMMA[1:, 1:] - np.outer(b, GAMMA[0, 1:]), len(t))
    full = np.column_stack([np.full(len(t), 0.9), rest])
    want = np.concatenate([[1, t.mean(), (t * t).mean()], full.mean(0), (full * t[:, None]).mean(0), (full.T @ full / len(t)).ravel()])
    assert np.allclose(got, want, atol=0.01)


def planted(n=1600, gaps=0.3):
    rng = np.random.default_rng(7)
    rows, mu = [], np.array([[-2.0, 1.0], [2.0, -1.5]])
    delta, gamma = np.array([[1.0, 0.5], [-0.8, 0.6]]), np.array([[[0.4, 0.1], [0.1, 0.3]], [[0.5, -0.1], [-0.1, 0.4]]])
    for i in range(n):
        sample = i % 3
        c = int(rng.random() < (0.03, 0.97, 0.5)[sample])
        x = mu[c] + delta[c] * abs(rng.normal()) + rng.multivariate_normal([0, 0], gamma[c])
        lost = rng.random(2) < gaps
        rows.append((i, *[None if lost[k] else float(x[k]) for k in range(2)], [sample], [1]))
    return rows, mu + delta * math.sqrt(2 / math.pi)


def test_fit_recovers_planted_components_on_any_partitioning(spark):
    rows, means = planted()
    df = spark.createDataFrame(rows, "id long, a double, b double, samples array<int>, times array<int>")
    one, many = (op.fit(df.repartition(n), ["a", "b"], 3, 2, 1, 30)[0] for n in (1, 4))
    assert all(b >= a - 1e-9 for a, b in zip(one["trace"], one["trace"][1:], strict=False))
    assert np.allclose(one["mu"] + one["delta"] * math.sqrt(2 / math.pi), means, atol=0.25)
    assert np.allclose(one["w"], [[0.97, 0.03], [0.03, 0.97], [0.5, 0.5]], atol=0.06)
    assert all(np.allclose(one[n], many[n], atol=1e-6) for n in ("mu", "delta", "gamma", "w"))
    assert op.fit(df.where("id < 0"), ["a", "b"], 3, 2) == []


def test_fit_of_bootstraps(spark):
    rows, means = planted(400)
    df = spark.createDataFrame(rows, "id long, a double, b double, samples array<int>, times array<int>").withColumn("mask", patterns.pattern(["a", "b"])).withColumn("sample", F.col("samples")[0])
    drawn = sized_draws(df.select("id", "sample", "mask"), ["sample", "mask"], "id", 2).select("id", F.transform("times", lambda v: v.cast("int")).alias("times"))
    fits = op.fit(df.drop("times").join(drawn, "id"), ["a", "b"], 3, 2, 2, 6)
    assert [f["seed"] for f in fits] == [0, 1] and not np.allclose(fits[0]["mu"], fits[1]["mu"])
    assert all(np.allclose(f["mu"] + f["delta"] * math.sqrt(2 / math.pi), means, atol=0.5) for f in fits)


MODEL = {"mu": [[-2.0, 1.0], [2.0, -1.5]], "delta": [[1.0, 0.5], [-0.8, 0.6]], "gamma": [[[0.4, 0.1], [0.1, 0.3]], [[0.5, -0.1], [-0.1, 0.4]]], "w": [[0.9, 0.1], [0.1, 0.9], [0.5, 0.5]]}


@pytest.mark.parametrize("mode", op.MODES)
def test_ratios_by_pattern(spark, mode):
    rows = [(1, 0.5, -1.0, "P"), (2, 0.5, None, "B"), (3, None, 1.0, "B"), (4, None, None, "P"), (5, -2.0, 1.5, "population"), (6, None, 0.2, "population"), (7, 1.0, math.nan, "P")]
    df = spark.createDataFrame(rows, "id long, a double, b double, sample string")
    counts = patterns.pattern_counts(df, ["a", "b"], ["sample"])
    told = op.support(counts, 2, 1)
    has = {r["mask"]: r for r in told.collect()}
    # Both classes have each dimension, only one of them both together.
    assert (has[1].has_p, has[1].has_b, has[1].sub) == (True, True, 1) and (has[2].has_p, has[2].has_b, has[2].sub) == (True, True, 2) and (has[3].has_p, has[3].has_b, has[3].sub) == (True, False, 1)
    got = {r.id: r.l for r in op.pattern_ratios(df, ["a", "b"], "id", MODEL, told, 0.2, mode).collect()}
    x = np.array([[NAN if v is None else v for v in r[1:3]] for r in rows])
    m = {n: np.array(v) for n, v in MODEL.items()}
    used = x.copy()
    if mode == "project":
        for i, row in enumerate(x):
            mask = sum(1 << k for k in range(2) if not math.isnan(row[k]))
            used[i] = [row[k] if mask and (has[mask]["sub"] >> k) & 1 else NAN for k in range(2)]
    logs = np.stack([op.log_density(used, m["mu"][c], m["delta"][c], m["gamma"][c]) for c in range(2)])
    p, b, pop = (op.log_mixture(logs, w) for w in m["w"])
    for i, r in enumerate(rows):
        mask = sum(1 << k for k in range(2) if not math.isnan(x[i, k]))
        want = p[i] - b[i]
        if not mask or (mode == "gate" and not has[mask].has_b):
            want = None
        elif mode == "local_unmixing" and has[mask].has_p and not has[mask].has_b and has[mask].has_pop:
            want = p[i] - math.log((math.exp(pop[i]) - 0.2 * math.exp(p[i])) / 0.8) if math.exp(pop[i]) > 0.2 * math.exp(p[i]) else p[i] - pop[i] - math.log(1e-10)
        assert (got[r[0]] is None) == (want is None) and (want is None or math.isclose(got[r[0]], want, rel_tol=1e-9, abs_tol=1e-9))


def test_prior_over_patterns(spark):
    rows, _ = planted(3000)
    df = spark.createDataFrame([r[:3] for r in rows if r[3] == [2]], "id long, a double, b double")
    assert abs(op.pattern_prior(df, ["a", "b"], {**MODEL, "w": [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]}) - 0.5) < 0.05
