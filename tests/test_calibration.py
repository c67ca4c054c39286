"""Each query against its SQL on the smallest tables, and the components against union-find."""

import glob
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrade.jobs import alignment, calibration, evaluation, evidence, fits, labels, patterns, ranges, robustness, scales, sources
from evigrade.operators.components import connected_components
from evigrade.operators.evidence import best_constants, combined_pair, isotonic

SF = "/root/testdata/sf0.001"
JOBS = (calibration, evidence, fits, patterns, scales, labels, evaluation, ranges, alignment, sources, robustness)
QUERIES, SQL = {n: q for j in JOBS for n, q in j.QUERIES.items()}, {n: q for j in JOBS for n, q in j.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {f.rpartition('/')[2][:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda xs, at: sorted(repr(tuple(x[at(n)] for n in names)) for x in xs)
    assert rows(got.collect(), lambda n: n) == rows(want.fetchall(), want.columns.index)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_isotonic():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 30):
        y, w = rng.standard_normal(n), rng.integers(1, 9, n).astype(float)
        means = {(i, j): np.average(y[i : j + 1], weights=w[i : j + 1]) for i in range(n) for j in range(i, n)}
        want = [max(min(means[i, j] for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(isotonic(y, w), want)


def test_pairs_and_rules(spark):
    pair = combined_pair(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([(None, None), (None, -2), (3, None), (2, 4), (-2, -4), (0, -1), (3, -1)], "a long, b long")
    assert [r[0] for r in rows.select(pair).collect()] == [None, -2, 3, 4, -4, -1, 0]
    assert best_constants(spark.createDataFrame([], "k string, p double"), ["k"], "p").count() == 0
    best = best_constants(spark.createDataFrame([("x", 0.1)], "k string, p double"), ["k"], "p", 3000).first()
    assert 1 <= best.c <= 3000 and best.broken == 0
