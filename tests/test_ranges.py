"""Clean-up of ranges on cases written out by hand, and the pieces of the curves."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from evigrade.jobs import ranges as jobs
from evigrade.operators import alignment, bootstrap
from evigrade.operators import ranges as op
from evigrade.operators.evidence import sorted_percentile

INF = math.inf


def full(**tiers):
    """Ranges of all tiers from p1, p2 and so on for, and b1, b2 and so on against."""
    out = {k: [] for k in (*range(1, 9), *range(-8, 0))}
    return out | {(1 if n[0] == "p" else -1) * int(n[1:]): rs for n, rs in tiers.items()}


def some(ranges):
    return {p: rs for p, rs in ranges.items() if rs}


def test_liberal_keeps_one_range_a_tier_and_drops_covered_ones():
    raw = full(p1=[(0, 1), (4, 5)], p2=[(2, 6)], b1=[(7, 8), (9, 10)], b2=[(8, 9)])
    assert some(op.liberal(raw, False)) == {2: [(2, 6)], -1: [(7, 8)], -2: [(8, 9)]}
    assert some(op.liberal(raw, True)) == {1: [(0, 1)], 2: [(2, 6)], -1: [(9, 10)], -2: [(8, 9)]}


def test_strict_flattens_and_cuts_what_falls_off():
    assert some(op.strict(full(p1=[(3, 4)]), (0, 10))) == {}
    assert some(op.strict(full(p1=[(0, 4)], b1=[(6, INF)]), (0, 10))) == {1: [(0, 4)], -1: [(6, INF)]}
    # A tier in pieces joined by the next one is taken as one, and stronger tiers go.
    assert some(op.strict(full(p1=[(0, 2), (3, 5)], p2=[(2, 3)]), (0, 10))) == {1: [(0, 5)]}
    # Pieces that the next tier doesn't join: those that touch it stay.
    assert some(op.strict(full(p1=[(0, 1), (6, 7)], p2=[(7, 8)], p3=[(8, 10)]), (0, 10))) == {1: [(6, 7)], 2: [(7, 8)], 3: [(8, 10)]}


def test_extended_goes_to_the_end_of_the_strongest_tier():
    raw = full(p1=[(3, 4)], p2=[(2, 3)], b1=[(6, 7)])
    assert some(op.extended(raw, (0, 10), False)) == {1: [(3, 4)], 2: [(0, 3)], -1: [(6, 10)]}
    assert some(op.extended(raw, (0, 10), True)) == {1: [(3, 4)], 2: [(2, 10)], -1: [(0, 7)]}
    assert some(op.extended(full(p1=[(0, 10)]), (0, 10), False)) == {}


def test_benign_envelopes_and_two_sides():
    assert some(op.benign_envelopes(full(b1=[(1, 2), (3, 4), (5, 6)], b2=[(2, 3), (4, 5)]))) == {-2: [(2, 5)], -1: [(1, 2), (5, 6)]}
    raw = full(p1=[(1, 2), (8, 9)], p2=[(9, 10)], b1=[(4, 6)])
    assert some(op.two_sided(raw, 5.0, (0, 10))) == {1: [(-INF, 2), (8, 9)], 2: [(9, INF)], -1: [(4, 6)]}
    assert op.two_sided(raw, None, (0, 10)) == raw
    assert op.is_two_sided(raw) and not op.is_two_sided(full(p1=[(0, 1)], b1=[(2, 3)])) and not op.is_two_sided(full())


def test_low_coverage_falls_to_the_weaker_tier():
    raw = full(p1=[(0, 1)], p3=[(1, 2)], b2=[(4, 5)])
    assert some(op.covered_enough(raw, {3: 0.2, -2: 0.3, 1: 0.01})) == {1: [(0, 1), (1, 2)]}
    assert some(op.covered_enough(raw, {})) == some(raw)


def test_draws_have_the_law_of_poisson(spark):
    rows = spark.range(20_000).select(*[d.alias(f"d{i}") for i, d in enumerate(bootstrap.draws(F.col("id"), 12))]).toPandas()
    for c in rows:
        share = rows[c].value_counts(normalize=True)
        assert abs(share[0] - math.exp(-1)) < 0.015 and abs(share[2] - math.exp(-1) / 2) < 0.015 and abs(rows[c].mean() - 1) < 0.03
    assert np.abs(np.corrcoef(rows.to_numpy().T) - np.eye(12)).max() < 0.04  # seeds are independent
    nothing = spark.createDataFrame([(None,)], "id long").select(bootstrap.draws(F.col("id"), 1)[0]).first()[0]
    assert nothing == 0


def test_interpolation_and_class(spark):
    curve = spark.createDataFrame([("d", 7, 1, 0.0), ("d", 7, 2, 2.0), ("d", 7, 3, None), ("d", 8, 1, 1.0)], "dataset string, seed long, grid int, l double")
    places = {r.grid: r.pieces for r in op.at_places(curve, "dataset").collect()}
    assert [tuple(p) for p in places[1]] == [(7, 0.0, 2.0), (8, 1.0, None)] and set(places) == {1, 2, 3}
    scores = spark.createDataFrame([(1.0,), (1.25,), (2.0,), (2.5,), (3.0,), (0.9,), (9.0,)], "s double").withColumn("dataset", F.lit("d")).withColumn("grid", F.floor("s").cast("int"))
    at = scores.join(op.at_places(curve, "dataset"), ["dataset", "grid"], "left").select("s", op.interpolated(F.get("pieces", F.lit(0)), F.col("s")).alias("v"))
    assert {r.s: r.v for r in at.collect()} == {1.0: 0.0, 1.25: 0.5, 2.0: 2.0, 2.5: None, 3.0: None, 0.9: None, 9.0: None}
    rows = spark.createDataFrame([(2.0, 3.0, "LP", "P"), (-4.0, -3.0, "B", "LB"), (5.0, -1.0, "P", "LB"), (-0.1, 3.0, "VUS", "P"), (None, None, None, None)], "a double, b double, low string, high string")
    l, name = op.chosen_class(F.col("a"), F.col("b"), F.col("low"), F.col("high"))  # noqa: E741
    assert [tuple(r) for r in rows.select(l, name).collect()] == [(2.0, "LP"), (-3.0, "LB"), (5.0, "P"), (-0.1, "VUS"), (None, "Unknown")]


def test_keys_close_over_assays(spark):
    rows = spark.createDataFrame([("x", None, "c1|c2", 1), ("x", None, "c2|c3", 2), ("y", "g1", "c9", 3), ("y", None, "c1", 4), ("z", None, None, 5)], "assay string, g string, c string, i long")
    keyed = alignment.keyed(rows, "assay", F.col("g"), F.col("c"), F.lit(None).cast("string"), F.col("i").cast("string"))
    got = {r.i: r.variant for r in alignment.with_variant(keyed).collect()}
    assert got == {1: "c:c1", 2: "c:c1", 3: "g:g1", 4: "i:4", 5: "i:5"}


def test_outer_ranges_are_liberal(spark):
    """On rows as on one dataset's dictionary, over random ranges."""
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(60):
        flipped = k % 2 == 0
        ranges = {p: sorted((lo := rng.randint(0, 20), lo + rng.randint(0, 9)) for _ in range(rng.randint(0, 3))) for p in (*range(1, 5), *range(-4, 0))}
        ranges = {p: [r for i, r in enumerate(rs) if not i or r[0] != rs[i - 1][0]] for p, rs in ranges.items()}
        rows += [(k, p, float(lo), float(hi), flipped) for p, rs in ranges.items() for lo, hi in rs]
        want[k] = {(p, *map(float, r)) for p, rs in op.liberal(ranges, flipped).items() for r in rs}
    got = {k: set() for k in want}
    for r in op.outer_ranges(spark.createDataFrame(rows, "k int, points int, lo double, hi double, f boolean"), ["k"], "f").collect():
        got[r.k].add((r.points, r.lo, r.hi))
    assert got == want


def test_percentiles_of_the_last_places(spark):
    df = spark.createDataFrame([([None, None, 1.0, 3.0, 5.0], 3), ([None, 2.0], 1), ([None, None], 0)], "v array<double>, n int")
    got = df.select(*[sorted_percentile(F.col("v"), q, F.col("n")) for q in (0.05, 0.5, 0.95)]).collect()
    assert np.allclose(got[0], [1.2, 3.0, 4.8]) and list(got[1]) == [2.0] * 3 and list(got[2]) == [None] * 3


def test_values_of_unseen_seeds(spark):
    """Against one row after the other: seeds that are missing, null values at a place or the next, null scores, ids and priors, places without a curve."""
    rng, seeds = random.Random(8), 11
    curve = {(s, g): None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 9) for s in range(seeds) if s != 4 for g in range(1, 6)}
    prior = {s: None if s == 2 else rng.random() for s in range(seeds) if s != 4}
    rows = [(i, "d", rng.choice([float(rng.randint(1, 6)), rng.uniform(0.5, 6.5)])) for i in range(300)] + [(900, "d", None), (None, "d", 2.5), (901, None, 2.5), (902, "other", 2.5)]
    df = spark.createDataFrame(rows, "id long, d string, score double")
    places = op.at_places(spark.createDataFrame([("d", s, g, v) for (s, g), v in curve.items()], "d string, seed long, grid int, l double"), "d")
    priors = op.packed_priors(spark.createDataFrame([("d", s, p) for s, p in prior.items()], "d string, seed long, prior double"), "d")
    times = {r.id: r.t for r in df.select("id", F.array(*bootstrap.draws(F.col("id"), seeds)).alias("t")).collect()}
    assert {r.id: r.unseen for r in bootstrap.with_unseen(df, "id", seeds).collect()} == {i: sum(1 << s for s, n in enumerate(t) if n == 0) for i, t in times.items()}
    got = {r.id: r for r in op.of_unseen(df, places, priors, "d", "id", "score", seeds).collect()}
    assert set(got) == {i for i, d, _ in rows if d == "d"}
    for i, d, x in rows:
        if d != "d":
            continue
        unseen = [s for s in range(seeds) if times[i][s] == 0]
        ls = []
        for s in unseen if x is not None else []:
            at, f = curve.get((s, math.floor(x))), x - math.floor(x)
            after = curve.get((s, math.floor(x) + 1))
            if at is not None and (f == 0 or after is not None):
                ls.append(at if f == 0 else at + (after - at) * f)
        assert got[i].n == len(ls) and got[i].ls == [None] * (seeds - len(ls)) + sorted(ls)
        assert got[i].own == sorted(prior[s] for s in unseen if prior.get(s) is not None)


def test_out_of_bag_rows_run_as_compiled_code(spark):
    """Java interprets a method of 8,000 bytes or more for every row, which made evidence_oob take ten times as long."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sf = "/root/testdata/sf0.001"
        plans = [jobs.evidence_oob(spark, sf), op.curve_counts(jobs._rows(spark, sf), "dataset", "at", "id", "p", "b", jobs.SEEDS)]
        for df in plans:
            code = df._jdf.queryExecution().debug().codegenToSeq()
            assert code.size() > 1 and max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
