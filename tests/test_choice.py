"""The signed-rank test against all sign patterns, and its normal approximation on ties."""

import math
import random
from itertools import product

from evigrade.operators.choice import signed_rank


def brute(diffs):
    """(n, w, p) over all signs, for differences without ties."""
    kept = [d for d in diffs if d]
    order = sorted(map(abs, kept))
    w = sum(order.index(abs(d)) + 1 for d in kept if d > 0)
    n = len(kept)
    return n, w, sum(sum(i + 1 for i, s in enumerate(signs) if s) >= w for signs in product((0, 1), repeat=n)) / 2**n


def test_exact(spark):
    rng = random.Random(4)
    given = {k: [rng.uniform(-1, 1.5) for _ in range(k)] for k in range(1, 12)} | {50: [0.0, 0.5, -0.25], 51: [0.0], 52: [None, math.nan]}
    got = {r.k: r for r in signed_rank(spark.createDataFrame([(k, d) for k, ds in given.items() for d in ds], "k int, d double"), ["k"], "d").collect()}
    for k, ds in given.items():
        if k < 51:
            n, w, p = brute(ds)
            assert (got[k].n, got[k].w) == (n, w) and math.isclose(got[k].p, p)
    assert (got[51].n, got[51].p, got[52].p) == (0, 1.0, 1.0)


def test_ties_and_many(spark):
    tied = [1.0, 1.0, -1.0, 2.0, 2.0, 3.0]
    many = [i + 0.5 if i % 3 else -i - 0.5 for i in range(60)]
    got = {r.k: r for r in signed_rank(spark.createDataFrame([("t", d) for d in tied] + [("m", d) for d in many], "k string, d double"), ["k"], "d").collect()}
    assert got["t"].w == 2 + 2 + 4.5 + 4.5 + 6
    z = (got["t"].w - 10.5) / math.sqrt(6 * 7 * 13 / 24 - (24 + 6) / 48)
    assert math.isclose(got["t"].p, math.erfc(z / math.sqrt(2)) / 2)
    w = sum(i + 1 for i, d in enumerate(many) if d > 0)
    z = (w - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert got["m"].n == 60 and math.isclose(got["m"].p, math.erfc(z / math.sqrt(2)) / 2)
