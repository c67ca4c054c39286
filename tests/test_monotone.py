"""Monotone repair and main regions against brute force."""

import numpy as np
import pytest

from evigrade.operators import monotone as op
from evigrade.operators.evidence import isotonic


def test_islands():
    for y, want in (([0, 1, 0], [0, 0, 0]), ([1, 0, 2, 0, 3], [1, 0, 0, 0, 3]), ([1, 1], [1, 1]), ([], []), ([0, 0], [0, 0]), ([0, 2, 2], [0, 2, 2])):
        assert op.without_islands(np.array(y, float)).tolist() == want


@pytest.mark.parametrize("liberal", [False, True])
def test_repair(spark, liberal):
    rng = np.random.default_rng(3)
    rows = [(i, *[None if rng.random() < 0.3 else float(rng.integers(12)) for _ in range(2)], float(round(rng.normal(), 3))) for i in range(90)]
    rows += [(900, None, None, 1.5), (901, float("nan"), None, 2.5), (902, 3.0, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, l double")
    ways = spark.createDataFrame([(0, 1), (1, -1)], "dim long, up long")
    got = {r.id: r.l for r in op.repaired(df, "id", ["a", "b"], "l", ways, liberal, 12).collect()}
    fits = []
    for d, up in ((1, 1), (2, -1)):
        own = [(up * r[d], r[3]) for r in rows if r[d] is not None and r[d] == r[d] and r[3] is not None]
        at = sorted({x for x, _ in own})
        of = [[l for x, l in own if x == v] for v in at]  # noqa: E741
        n = np.array([len(ls) for ls in of], float)
        rise, fall = (isotonic(np.array([np.mean([max(s * l, 0) for l in ls]) for ls in of])[::s], n[::s])[::s] for s in (1, -1))  # noqa: E741
        fits.append({up * x: v for x, v in zip(at, rise - fall, strict=True)})
        assert (np.diff(rise) >= 0).all() and (np.diff(fall) <= 0).all()
    for i, a, b, l in rows:  # noqa: E741
        vs = [] if l is None else [f[v] for f, v in zip(fits, (a, b), strict=True) if v is not None and v == v]
        ups, downs = [v for v in vs if v > 0], [v for v in vs if v < 0]
        want = l if not vs else max(vs) if liberal else 0.0 if ups and downs else min(ups) if ups else max(downs) if downs else 0.0
        assert got[i] == want or abs(got[i] - want) < 1e-9


def test_main_region(spark):
    shape = ["##..#", "#...#", "..#.#", "###.#", "#####"]
    cells = spark.createDataFrame([(i, j, c == "#") for i, row in enumerate(shape) for j, c in enumerate(row)], "i long, j long, inside boolean")
    got = {(r.i, r.j) for r in op.main_region(cells, 5, "inside").collect()}
    assert got == {(i, j) for i, row in enumerate(shape) for j, c in enumerate(row) if c == "#"} - {(0, 0), (0, 1), (1, 0)}
    assert [(r.i, r.j) for r in op.main_region(cells.where("i + j = 0 OR i + j = 8"), 5, "inside").collect()] == [(0, 0)]
    assert op.main_region(cells, 5, "NOT inside AND inside").count() == 0
    nested = {(r.points, r.i, r.j) for r in op.nested_regions(cells, 5, [(1, "inside"), (2, "inside AND i < 2")]).collect()}
    assert {x for x in nested if x[0] == 2} == set() and len(nested) == len(got)
