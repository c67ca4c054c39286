"""Fits to evidence against numeric expectations, and the constrained fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrade.operators import fits as op
from evigrade.operators import mixtures

SCHEMA = "g string, seed long, lo double, hi double, components array<struct<a:double,loc:double,scale:double>>, weights array<array<double>>"
PARTS = [(2.0, -1.0, 1.0), (-3.0, 1.5, 0.8)]


def dense(x, w):
    a, loc, scale = (np.array([c[i] for c in PARTS]) for i in range(3))
    lp = mixtures.component_log_pdf(np.atleast_1d(x), loc, scale * a / np.sqrt(1 + a * a), scale**2 / (1 + a * a))[0]
    return np.log(np.array(w) @ np.exp(lp))


def test_log_normal_cdf(spark):
    z = [-38.0, -12.0, -6.0, -3.0, -2.999, -1.0, 0.0, 0.5, 2.999, 3.0, 5.0, 9.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(op.log_normal_cdf(F.col("z"))).collect()]
    for v, l in zip(z, got, strict=True):  # noqa: E741
        want = math.log(math.erfc(-v / math.sqrt(2)) / 2) if v > -30 else -(v * v) / 2 - math.log(-v) - math.log(2 * math.pi) / 2
        assert math.isclose(l, want, rel_tol=1e-9 if v > -30 else 1e-3, abs_tol=1e-15)


@pytest.fixture(scope="module")
def table(spark):
    rows = [("pn", 0, -5.0, 5.0, PARTS, [[0.9, 0.1], [0.2, 0.8], [0.4, 0.6], [0.0, 1.0]]), ("pu", 0, -5.0, 5.0, PARTS, [[1.0, 0.0], None, [0.3, 0.7], None]), ("nu", 0, -5.0, 5.0, PARTS, [None, [0.0, 1.0], [0.3, 0.7], None]), ("no", 0, -5.0, 5.0, PARTS, [None, None, [0.3, 0.7], None])]
    return spark.createDataFrame(rows, SCHEMA)


def test_densities_priors_and_ratios(spark, table):
    x = [float(v) for v in np.linspace(-4, 4, 81)]
    places = spark.createDataFrame([(g, v, float(i % 7 + 1)) for g in ("pn", "pu", "nu", "no") for i, v in enumerate(x)] + [("pn", 6.0, 0.0)], "g string, x double, n double")
    seen = op.at_places(table, places, ["g"])
    by = {(r.g, r.x): r for r in seen.collect()}
    assert by["pn", 6.0].log_p is None and all(np.allclose(by["pn", v].log_p, dense(v, [0.9, 0.1])) and np.allclose(by["pn", v].log_pop, dense(v, [0.4, 0.6])) for v in x)
    priors = op.fit_priors(seen.where("log_pop IS NOT NULL"), ["g", "seed"])
    got = {r.g: r.prior for r in priors.collect()}
    n = np.array([i % 7 + 1 for i in range(81)], float)
    p, b = np.exp(dense(np.array(x), [0.9, 0.1])), np.exp(dense(np.array(x), [0.2, 0.8]))
    assert math.isclose(got["pn"], mixtures.class_prior(p, b, n), rel_tol=1e-9)
    pop = np.exp(dense(np.array(x), [0.3, 0.7]))
    for g, w, first in (("pu", [1.0, 0.0], True), ("nu", [0.0, 1.0], False)):
        own = np.exp(dense(np.array(x), w))
        assert math.isclose(got[g], mixtures.one_class_prior(own, pop, first), rel_tol=1e-9) and abs(got[g] - 0.3) < 0.03
    assert got["no"] == mixtures.NO_SIGNAL
    ratios = {(r.g, r.x): r.l for r in op.log_ratio(seen, priors, ["g", "seed"]).collect()}
    # The population is 0.3 of the first and 0.7 of the second component, so unmixing gives the other one back.
    exact = priors.withColumn("prior", F.when(F.col("g") == "pn", F.col("prior")).otherwise(0.3))
    unmixed = {(r.g, r.x): r.l for r in op.log_ratio(seen, exact, ["g", "seed"]).collect()}
    for v in x[30:50]:
        assert all(math.isclose(unmixed[g, v], float((dense(v, [1.0, 0.0]) - dense(v, [0.0, 1.0]))[0]), abs_tol=1e-6) for g in ("pu", "nu")) and math.isclose(ratios["pn", v], float((dense(v, [0.9, 0.1]) - dense(v, [0.2, 0.8]))[0]), rel_tol=1e-9)
    assert ratios["no", x[0]] is None and ratios["pn", 6.0] is None
    stand_in = {r.g: r.log_b for r in op.at_places(table, places.where("x = 0 OR abs(x) < 1e-9"), ["g"], "synonymous").collect()}
    mean = {r.g: r.log_b for r in op.at_places(table, places.where("abs(x) < 1e-9"), ["g"], "avg").collect()}
    assert np.allclose(stand_in["pn"], dense(0.0, [0.0, 1.0])) and np.allclose(mean["pn"], dense(0.0, [0.1, 0.9]))


def test_priors_of_datasets(spark):
    rows = [("a", 0.2), ("a", 0.3), ("a", 0.9), ("b", None), ("b", None), ("c", 0.2), ("c", None), ("c", None)]
    got = {r.g: r for r in op.dataset_priors(spark.createDataFrame(rows, "g string, prior double"), ["g"]).collect()}
    assert (got["a"].prior, got["a"].kept, got["a"].unstable) == (0.3, 1.0, False)
    assert (got["b"].prior, got["b"].kept, got["b"].unstable) == (op.FALLBACK, 0.0, True)
    assert got["c"].prior == 0.2 and got["c"].unstable


def test_unmixing_keeps_a_floor(spark):
    one = spark.createDataFrame([(math.log(0.1), 0.5, math.log(0.3)), (math.log(0.1), 0.5, math.log(0.1))], "pop double, share double, own double")
    low, same = (r[0] for r in one.select(op.unmixed(F.col("pop"), F.col("share"), F.col("own"))).collect())
    assert math.isclose(low, math.log(0.1 * op.FLOOR)) and math.isclose(same, math.log(0.1))


def test_moments_are_those_of_the_component(spark):
    delta, loc, scale = 0.9, 2.0, 1.5
    mean, var = loc + scale * delta * math.sqrt(2 / math.pi), scale**2 * (1 - 2 * delta**2 / math.pi)
    skew = (4 - math.pi) / 2 * (delta * math.sqrt(2 / math.pi)) ** 3 / (1 - 2 * delta**2 / math.pi) ** 1.5
    s2 = var + mean**2
    s3 = skew * var**1.5 + 3 * mean * s2 - 2 * mean**3
    row = spark.createDataFrame([(10.0, 10 * mean, 10 * s2, 10 * s3), (2.0, 1.0, 1.0, 1.0), (5.0, 5.0, 5.0, 5.0)], "n double, a double, b double, c double")
    got = [r[0] for r in row.select(op.moment_component(*[F.col(c) for c in ("n", "a", "b", "c")])).collect()]
    assert got[1] is None and got[2] is None
    assert np.allclose((got[0].a, got[0].loc, got[0].scale), (delta / math.sqrt(1 - delta**2), loc, scale))


def test_constrained_fits_keep_their_ratios_and_never_lose_likelihood(spark):
    rng = np.random.default_rng(8)
    for k in (2, 3):
        # The second class is much wider, so that free fits break the order of their ratios.
        x = np.concatenate([rng.normal(-0.5, 0.4, 300), rng.normal(0.5, 1.6, 300), rng.normal(0.2, 1.3, 300)])
        sample, n = np.repeat([0, 1, 2], 300), np.ones(900)
        free, held = (mixtures.fit_mixture(sample, x, n, k, 1, 0, max_steps=60, constrained=c) for c in (False, True))
        places = np.linspace(x.min(), x.max(), mixtures.RATIO_PLACES)
        falls = lambda m: mixtures.ratio_falls(list(mixtures.component_log_pdf(places, m["loc"], m["delta"], m["gamma"])[0]))  # noqa: E731, B023
        assert falls(held) and all(b >= a - 1e-6 * abs(a) for a, b in zip(held["trace"], held["trace"][1:], strict=False))
        assert k == 3 or not falls(free)
        assert held["trace"][-1] > held["trace"][0]
        if k == 2:
            lr = np.diff(np.log(held["w"][0] @ np.exp((l := mixtures.component_log_pdf(places, held["loc"], held["delta"], held["gamma"])[0]))) - np.log(held["w"][1] @ np.exp(l)))
            massive = (l > mixtures.MASS).all(0)
            inside = massive[1:] & massive[:-1]
            assert (lr[inside] <= 1e-6).all() or (lr[inside] >= -1e-6).all()


def test_fits_of_mixtures_give_evidence(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a", float(rng.normal(20 if i % 2 else 60, 6)), i % 2 == 1 and i % 3 == 0, i % 2 == 0 and i % 3 == 0, True) for i in range(600)]
    scored = spark.createDataFrame(rows, "doc_id long, g string, score double, is_plp boolean, is_blb boolean, is_pop boolean")
    counts = mixtures.counted_scores(scored, "g", 2, 128)
    best = mixtures.best_fits(mixtures.mixture_fits(counts, "g", (2,), 2, constrained=True), "g").select("g", "seed", "components", "weights")
    population = counts.where("sample = 2").select("g", "seed", "x", F.col("rows").alias("n"))
    priors = op.fit_priors(op.at_places(best, population, ["g", "seed"]), ["g", "seed"])
    assert all(abs(r.prior - 0.5) < 0.06 for r in priors.collect())
    places = spark.createDataFrame([("a", 15.0), ("a", 65.0)], "g string, x double")
    curve = {r.x: r for r in op.curve_percentiles(op.log_ratio(op.at_places(best, places, ["g"]), priors, ["g", "seed"]), ["g", "x"]).collect()}
    assert curve[15.0].p5 > 2 and curve[65.0].p95 < -2 and curve[15.0].fits == 2
