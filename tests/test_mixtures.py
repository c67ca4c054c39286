"""Mixture fits on planted samples, against raw rows, and the edges of each operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrade.operators import mixtures as op
from evigrade.operators.bootstrap import times_drawn

SCHEMA = "doc_id long, g string, score double, is_plp boolean, is_blb boolean, is_pop boolean, score_lo double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(600):
        low = i % 2 == 0
        out.append((i, "a", float(round(rng.normal(20 if low else 60, 6))), low and i % 3 == 0, not low and i % 3 == 0, True, 0.0))
    odd = [(9001, "a", None, True, False, True, 0.0), (9002, "a", math.nan, True, False, True, 0.0), (9003, None, 1.0, None, None, None, None), (9004, "one", 5.0, True, False, True, 0.0), (9005, "one", 5.0, False, True, True, 0.0)]
    return spark.createDataFrame(out + odd, SCHEMA)


def test_density_is_one_and_moments_match_a_sum():
    x = np.linspace(-60, 60, 240_001)
    loc, delta, gamma = np.array([0.0, 1.0]), np.array([2.0, -3.0]), np.array([0.5, 1.0])
    lp, first, second = op.component_log_pdf(x, loc, delta, gamma)
    assert np.allclose(np.exp(lp).sum(1) * (x[1] - x[0]), 1, atol=1e-6)
    v = np.linspace(0, 12, 400_001)
    for k, at in ((0, 130_000), (1, 118_000)):
        f = np.exp(-(v**2) / 2 - (x[at] - loc[k] - delta[k] * v) ** 2 / (2 * gamma[k]))
        assert math.isclose(first[k, at], (f * v).sum() / f.sum(), rel_tol=1e-4) and math.isclose(second[k, at], (f * v * v).sum() / f.sum(), rel_tol=1e-4)


def test_planted_components_are_found_and_likelihood_never_falls():
    rng = np.random.default_rng(5)
    p, b = rng.normal(-1.5, 0.5, 400), rng.normal(1.5, 0.7, 400)
    pop = np.concatenate([p[:100], b[:300]])
    sample, x = np.repeat([0, 1, 2], [400, 400, 400]), np.concatenate([p, b, pop])
    m = op.fit_mixture(sample, x, np.ones(1200), 2, 0, 0)
    mean = m["loc"] + m["delta"] * math.sqrt(2 / math.pi)
    assert np.allclose(mean, [-1.5, 1.5], atol=0.15) and np.allclose(m["w"], [[1, 0], [0, 1], [0.25, 0.75]], atol=0.05)
    assert min(np.diff(m["trace"])) > -1e-6 * abs(m["trace"][0])


def test_fits_of_the_table_are_those_of_the_raw_rows(rows):
    counts = op.counted_scores(rows, "g", 2, bins=4096)
    fits = op.mixture_fits(counts, "g", (2,), 2).collect()
    assert {(r.g, r.seed, r.n_c, r.fit_idx) for r in fits} == {("a", s, 2, i) for s in (0, 1) for i in (0, 1)}
    raw = rows.where("g = 'a' AND score IS NOT NULL AND NOT isnan(score)")
    for r in fits:
        mine = raw.withColumn("n", times_drawn(F.col("doc_id"), F.lit(r.seed))).where("n > 0").collect()
        pairs = sorted((s, d.score, d.n) for d in mine for s, c in enumerate(op.SAMPLES) if d[c])
        s, x, n = (np.array(c) for c in zip(*pairs, strict=True))
        m = op.fit_mixture(s, x, n, 2, r.fit_idx, r.seed)
        assert np.allclose([c["loc"] for c in r.components], m["loc"], atol=1e-3) and np.allclose(r.weights, m["w"], atol=1e-3)
        assert math.isclose(r.train_ll, op.log_likelihood(s, x, n, m), rel_tol=1e-6)
    best = op.best_fits(op.mixture_fits(counts, "g", (2,), 2), "g")
    prior = {r.seed: r.prior for r in op.density_priors(best, counts, "g").collect()}
    assert set(prior) == {0, 1} and all(abs(p - 0.5) < 0.08 for p in prior.values())


def test_best_of_ties_and_failed_fits(spark):
    fits = spark.createDataFrame([("a", 0, 2, 1, -1.0), ("a", 0, 2, 0, -1.0), ("a", 0, 2, 2, None), (None, 0, 2, 0, -3.0), ("b", 0, 2, 0, None)], "g string, seed long, n_c int, fit_idx int, val_ll double")
    assert {(r.g, r.fit_idx) for r in op.best_fits(fits, "g").collect()} == {("a", 0), (None, 0)}


def test_priors():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(3, 1, 7000)])
    f = lambda m: np.exp(-((x - m) ** 2) / 2)
    assert abs(op.class_prior(f(0), f(3), np.ones(10_000)) - 0.3) < 0.02
    assert math.isnan(op.class_prior(np.zeros(3), np.ones(3), np.ones(3)))
    far = np.concatenate([x, np.full(5000, 1e6)])
    g = lambda m: np.exp(-((far - m) ** 2) / 2)
    assert abs(op.class_prior(g(0), g(3), np.ones(15_000)) - 0.3) < 0.02  # outliers that neither class reaches don't count
    mix = 0.3 * f(0) + 0.7 * f(3)
    assert abs(op.one_class_prior(f(0), mix, True) - 0.3) < 0.05 and abs(op.one_class_prior(f(3), mix, False) - 0.3) < 0.05
    assert op.one_class_prior(np.zeros(3), np.ones(3), True) == 0.1 and op.one_class_prior(np.ones(3), np.full(3, 1e-6), True) == 0.01
    assert math.isnan(op.one_class_prior(np.ones(3), np.full(3, 2.0), False))


def test_empty_and_quantile_distance(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert op.counted_scores(none, "g", 2).count() == 0 and op.mixture_fits(op.counted_scores(none, "g", 2), "g").count() == 0
    assert op.quantile_distance(none, "g").count() == 0
    found = {r.g: r.distance for r in op.quantile_distance(rows, "g").collect()}
    mine = rows.where("g = 'a' AND score IS NOT NULL AND NOT isnan(score)").toPandas()
    q = np.arange(1, 100) / 100
    a, b = (np.quantile(mine.score[mine[c]], q) for c in op.SAMPLES[:2])
    assert math.isclose(found["a"], math.sqrt(((a - b) ** 2).mean()), rel_tol=1e-9) and found["one"] == 0


def test_likelihood_ratio_test_tells_three_components_from_two(spark):
    rng = np.random.default_rng(2)
    rows = []
    for name, centres in (("two", (-3.0, 3.0)), ("three", (-6.0, 0.0, 6.0))):
        x = np.concatenate([rng.normal(c, 0.6, 200) for c in centres])
        n, edges = np.histogram(x, 48)
        rows += [(name, s, float((edges[i] + edges[i + 1]) / 2), int(v)) for s in range(3) for i, v in enumerate(n) if v]
    counts = spark.createDataFrame([*rows, ("one", 0, 1.0, 5)], "g string, sample int, x double, rows long")
    got = {r.g: r for r in op.likelihood_ratio_test(counts, "g", 9, restarts=1, bins=48, max_steps=60).collect()}
    assert set(got) == {"two", "three"} and got["three"].p == 0.1 and got["two"].p > 0.1 and got["three"].statistic > got["two"].statistic


def test_simulated_counts_have_the_size_and_shape_of_the_mixture():
    m = {"loc": np.array([0.0]), "delta": np.array([1.0]), "gamma": np.array([0.5]), "w": np.ones((3, 1))}
    sample, x, n = op.simulated_counts(m, [100_000, 0, 7], -4.0, 6.0, 200, np.random.default_rng(1))
    assert [n[sample == s].sum() for s in range(3)] == [100_000, 0, 7]
    assert abs(np.average(x[sample == 0], weights=n[sample == 0]) - math.sqrt(2 / math.pi)) < 0.02
