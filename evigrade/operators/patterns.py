"""Scores in several dimensions with gaps: patterns of what is there, overlaps of dimensions, and what a pattern is supported by.

A row's pattern is a bit mask of its dimensions. Rows are counted by pattern and class in one pass with map-side sums; all
that follows works on that table, which has at most two to the number of dimensions rows a class, whatever the data.

Defined results: a null or NaN value is a gap; a row with gaps only has pattern 0 and supports nothing; a single
dimension is a component of its own and no group; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrade.operators.components import connected_components

#: Subsets of a pattern are enumerated, so patterns have at most this many dimensions.
MOST_DIMENSIONS = 16


def wide(rows: DataFrame, keys: list[str], dim: str, value: str, dims: list[str]) -> DataFrame:
    """A row for each of keys, and for each of dims the mean of its values there, null without any."""
    seen = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*keys).agg(*[F.avg(F.when(F.col(dim) == d, seen)).alias(d) for d in dims])


def pattern(dims: list[str]) -> Column:
    """The mask of the dimensions that have a value, the first one being bit 0."""
    bits = [F.when(F.col(d).isNotNull() & ~F.isnan(d), 1 << i).otherwise(0).cast("long") for i, d in enumerate(dims)]
    return sum(bits[1:], bits[0])


def pattern_counts(rows: DataFrame, dims: list[str], by: list[str]) -> DataFrame:
    """by, mask and n."""
    return rows.select(*by, pattern(dims).alias("mask")).groupBy(*by, "mask").agg(F.count("*").alias("n"))


def overlaps(counts: DataFrame, dims: int) -> DataFrame:
    """i, j and n: the rows that have a value in both dimensions, i < j."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(dims) for j in range(i + 1, dims)])).alias("p")
    both = counts.select("mask", "n", pairs).where(F.expr("mask & (1L << p.i) > 0 AND mask & (1L << p.j) > 0"))
    return both.groupBy("p.i", "p.j").agg(F.sum("n").alias("n"))


def connected_dims(counts: DataFrame, dims: int, least: int = 30) -> DataFrame:
    """dim, root, size and chosen: dimensions that share at least ``least`` rows are linked, directly or through others.

    The group of the most dimensions is chosen, of equal ones that with the smallest dimension; a lone dimension isn't a group and has no row.
    """
    edges = overlaps(counts, dims).where(F.col("n") >= least).select(F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"))
    found = connected_components(edges)
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    best = sizes.agg(F.max_by("root", F.struct("size", -F.col("root"))).alias("best"))
    return found.join(sizes, "root").crossJoin(F.broadcast(best)).select(F.col("node").alias("dim"), "root", "size", (F.col("root") == F.col("best")).alias("chosen"))


def supported_subsets(counts: DataFrame, dims: int, label: str, needed: list[str], least: int) -> DataFrame:
    """mask and supported: for each pattern its largest subset that at least ``least`` rows of every needed label have in full.

    Of equally large subsets the one with the smallest dimensions is taken; null where not even one dimension is supported.
    """
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    patterns = counts.select("mask").where("mask > 0").distinct()
    subset = patterns.select("mask", F.explode(F.sequence(F.lit(1).cast("long"), "mask")).alias("subset")).where(F.expr("subset & mask = subset"))
    full = subset.select("subset").distinct().join(counts.where(F.col(label).isin(needed)), F.expr("mask & subset = subset"))
    by_label = full.groupBy("subset", label).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    fine = by_label.groupBy("subset").agg(F.count("*").alias("labels")).where(F.col("labels") == len(needed)).select("subset")
    in_order = F.expr(f"filter(sequence(0, {dims - 1}), i -> subset & (1L << i) > 0)")
    best = subset.join(fine, "subset").groupBy("mask").agg(F.min_by("subset", F.struct(-F.bit_count("subset"), in_order)).alias("supported"))
    return patterns.join(best, "mask", "left")
