"""Monotone evidence in several dimensions: repair along each dimension, and the main region of a threshold on a grid.

Along a dimension rows are counted by place first, and the isotonic fit runs on the places of one dimension, whatever the
number of rows; a row takes its place's value. Regions are connected components of grid cells, found by joins.

Defined results: a null or NaN value is a gap; a row without values keeps its ratio; a null ratio stays null; a dimension with one
single value or fewer than ``LEAST`` rows isn't repaired; without rows of both classes a dimension's direction is upwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrade.operators.components import connected_components
from evigrade.operators.evidence import isotonic

PLACES, LEAST = 256, 10


def directions(rows: DataFrame, dims: list[str], label: str, first: str, second: str) -> DataFrame:
    """dim and up: 1 where the first class has the higher mean in a dimension, or a class has no value there, else -1."""
    mean = lambda d, v: F.avg(F.when((F.col(label) == v) & ~F.isnan(d), F.col(d)))
    ups = [F.struct(F.lit(i).cast("long").alias("dim"), F.when(mean(d, first) <= mean(d, second), -1).otherwise(1).cast("long").alias("up")) for i, d in enumerate(dims)]
    return rows.agg(F.array(*ups).alias("ups")).select(F.explode("ups").alias("x")).select("x.*")


def without_islands(y: np.ndarray) -> np.ndarray:
    """y with runs of positive values set to 0 that touch neither end."""
    positive = np.concatenate([[False], y > 0, [False]])
    starts, ends = np.flatnonzero(np.diff(positive.astype(int)) == 1), np.flatnonzero(np.diff(positive.astype(int)) == -1)
    out = y.copy()
    for a, b in zip(starts, ends, strict=True):
        if a > 0 and b < len(y):
            out[a:b] = 0.0
    return out


def repaired(rows: DataFrame, key: str, dims: list[str], ratio: str, ways: DataFrame, liberal: bool = False, places: int = PLACES) -> DataFrame:
    """key and l: the ratio made monotone along each dimension, and the dimensions reconciled.

    Evidence for the first class may only grow along a dimension's direction, that against it only fall; each is fitted by
    itself. Then a row takes the weakest of its dimensions, and 0 where they conflict, or, if liberal, the highest.
    """
    cell = F.explode(F.filter(F.array(*[F.when(F.col(d).isNotNull() & ~F.isnan(d), F.struct(F.lit(i).cast("long").alias("dim"), F.col(d).cast("double").alias("x"))) for i, d in enumerate(dims)]), lambda c: c.isNotNull())).alias("c")
    each = rows.where(F.col(ratio).isNotNull()).select(key, F.col(ratio).alias("l"), cell).select(key, "l", "c.*").join(F.broadcast(ways), "dim").withColumn("x", F.col("x") * F.col("up"))
    ends = each.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).where((F.col("hi") > F.col("lo")) & (F.col("n") >= LEAST))
    place = F.least(F.lit(places - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * places)).cast("long")
    placed = each.join(F.broadcast(ends), "dim", "left").select(key, "l", "dim", place.alias("place"))
    means = placed.where("place IS NOT NULL").groupBy("dim", "place").agg(F.avg(F.greatest("l", F.lit(0.0))).alias("up"), F.avg(F.greatest(-F.col("l"), F.lit(0.0))).alias("down"), F.count("*").cast("double").alias("n"))

    def fitted(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("place")
        up, down = isotonic(one.up.to_numpy(), one.n.to_numpy()), isotonic(one.down.to_numpy()[::-1], one.n.to_numpy()[::-1])[::-1]
        if not liberal:
            up, down = without_islands(up), without_islands(down)
        return pd.DataFrame({"dim": one.dim, "place": one.place, "v": up - down})

    fits = means.groupBy("dim").applyInPandas(fitted, "dim long, place long, v double")
    seen = placed.join(F.broadcast(fits), ["dim", "place"], "left").withColumn("v", F.coalesce("v", "l"))
    low, high = F.min(F.when(F.col("v") > 0, F.col("v"))), F.max(F.when(F.col("v") < 0, F.col("v")))
    whole = F.max("v") if liberal else F.when(low.isNotNull() & high.isNotNull(), 0.0).otherwise(F.coalesce(low, high, F.lit(0.0)))
    own = seen.groupBy(key).agg(whole.alias("_own"))
    return rows.select(key, F.col(ratio).alias("l")).join(own, key, "left").select(key, F.coalesce("_own", "l").alias("l"))


def main_region(cells: DataFrame, width: int, inside: str) -> DataFrame:
    """i and j of the cells of the largest region that ``inside`` (a condition) holds in, by shared edges; of equal ones that with the smallest cell, i * width + j."""
    kept = cells.where(inside).select("i", "j", (F.col("i") * width + F.col("j")).alias("cell"))
    beside = kept.select("cell", F.explode(F.filter(F.array(F.when(F.col("j") + 1 < width, F.col("cell") + 1), F.col("cell") + width), lambda c: c.isNotNull())).alias("b"))
    edges = beside.join(kept.select(F.col("cell").alias("b")), "b", "left_semi").select(F.col("cell").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    roots = connected_components(edges)
    rooted = kept.join(roots, F.col("cell") == F.col("node"), "left").select("i", "j", F.coalesce("root", "cell").alias("root"))
    best = rooted.groupBy("root").agg(F.count("*").alias("n")).agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))
    return rooted.join(F.broadcast(best), "root").select("i", "j")


def nested_regions(cells: DataFrame, width: int, bars: list[tuple[int, str]]) -> DataFrame:
    """points, i and j: the main region of each bar (points and condition, the weakest first), inside that of the bar before."""
    found, before = [], None
    for points, inside in bars:
        region = main_region(cells, width, inside)
        region = region if before is None else region.join(before, ["i", "j"], "left_semi")
        before = region
        found.append(region.select(F.lit(points).cast("long").alias("points"), "i", "j"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
