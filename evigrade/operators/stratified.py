"""Bootstraps of exact size by stratum: n of n rows drawn with replacement, without ranking a stratum in one task.

A stratum's rows stand in the order of a hash of their ids. Its n draws are split between the halves of that order, those
between theirs, and so on: the share of a half is binomial, drawn by a hash of the seed and the half. Where at most ``LEAF``
rows are left each draw picks its row. So every seed draws exactly n rows, a leaf finds its own draws from the size of its
stratum alone, and whatever a seed draws is the same on any cluster. A row's draws in all seeds are one array.

A half's share is the normal law's quantile, rounded: with at least LEAF / 2 expected draws and halves of equal size it
differs from the binomial law by well under one draw in a hundred.

Defined results: rows with a null id or a null stratum are never drawn and are left out; a stratum of one row draws it
once in every seed; a stratum of at most LEAF rows, but more than one, leaves a row unseen in every seed, being drawn again
where it doesn't (of larger ones fewer than one in a million draws leave none); repeated ids are rows of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF, DEPTH, TRIES = 16, 40, 20
#: Hex digits of the hash that divide a stratum into buckets; only a bucket's rows are ranked together.
DIGITS = 3


def uniform(key: Column, part: int) -> Column:
    """A number in (0, 1), the part-th of four that the MD5 of key gives."""
    return (F.conv(F.substring(F.md5(key), 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def half_draws(draws: Column, size: Column, left: Column, key: Column) -> Column:
    """How many of draws fall to the left rows of size: the rounded normal quantile, inside 0 and draws."""
    z = F.sqrt(-2 * F.ln(uniform(key, 0))) * F.cos(2 * math.pi * uniform(key, 1))
    p = left / size
    return F.least(draws, F.greatest(F.lit(0), F.floor(draws * p + z * F.sqrt(draws * p * (1 - p)) + 0.5))).cast("long")


def placed(rows: DataFrame, strata: list[str], row_id: str, digits: int = DIGITS) -> DataFrame:
    """rows with place, from 0 on within their stratum by a hash of the id, and size, the stratum's rows."""
    digest = F.md5(F.col(row_id).cast("string").cast("binary"))
    hashed = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*strata, row_id])).withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    counts = hashed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*strata)
    before = counts.select(*strata, "_bucket", F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("size"))
    within = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_digest", row_id))
    return hashed.withColumn("_within", within).join(before, [*strata, "_bucket"]).withColumn("place", F.col("_before") + F.col("_within") - 1).drop("_digest", "_bucket", "_within", "_before")


def _descent(state: Column, place: Column, split) -> Column:
    """state (lo, size and what split adds) at the leaf that holds place; split gives the fields of the left and of the right half."""

    def step(s: Column) -> Column:
        left = F.floor(s["size"] / 2)
        go_left = place < s["lo"] + left
        more = split(s, left)
        halves = [F.struct(lo.alias("lo"), size.alias("size"), *[v[k].alias(n) for n, v in more.items()]) for k, (lo, size) in enumerate(((s["lo"], left), (s["lo"] + left, s["size"] - left)))]
        return F.when(s["size"] <= LEAF, s).when(go_left, halves[0]).otherwise(halves[1])

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), state, lambda s, _: step(s))


def _at_leaf(stratum: Column, seed: Column, lo: Column, size: Column, total: Column) -> Column:
    """The draws of one leaf: the number of times that each of its places is taken."""
    whole = F.struct(F.lit(0).cast("long").alias("lo"), total.alias("size"), total.alias("draws"))

    def split(s: Column, left: Column) -> dict:
        to_left = half_draws(s["draws"], s["size"], left, F.concat_ws(":", stratum, seed.cast("string"), s["lo"].cast("string"), s["size"].cast("string")))
        return {"draws": (to_left, s["draws"] - to_left)}

    draws = _descent(whole, lo, split)["draws"]

    def picked(attempt: Column) -> Column:
        """Picks in order; one MD5 gives four of them."""
        key = lambda j: F.concat_ws(":", stratum, seed.cast("string"), lo.cast("string"), F.lit("leaf"), attempt.cast("string"), F.floor(j / 4).cast("string"))
        hex8 = lambda j: F.substring(F.md5(key(j)), (1 + 8 * (j % 4)).cast("int"), F.lit(8))
        pick = lambda j: F.floor((F.conv(hex8(j), 16, 10).cast("double") + 0.5) / 2.0**32 * size)
        return F.when(draws > 0, F.transform(F.sequence(F.lit(0), draws.cast("int") - 1), pick)).otherwise(F.array().cast("array<bigint>"))

    # Drawn again only where the leaf is the whole stratum and no row is left unseen.
    first = F.struct(picked(F.lit(0)).alias("picks"))
    again = lambda s, k: F.when((total == size) & (size > 1) & (F.size(F.array_distinct(s["picks"])) == size), F.struct(picked(k).alias("picks"))).otherwise(s)
    picks = F.when(total <= LEAF, F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), first, again)).otherwise(first)["picks"]
    return picks


def sized_draws(rows: DataFrame, strata: list[str], row_id: str, seeds: int, digits: int = DIGITS) -> DataFrame:
    """strata, row_id and times, the array of how often each of the seeds draws the row; a stratum's times add up to its rows in each seed."""
    at = placed(rows.select(*strata, row_id), strata, row_id, digits)
    start = F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("size"))
    leaf = at.withColumn("leaf", _descent(start, F.col("place"), lambda s, left: {}))
    leaves = leaf.groupBy(*strata, F.col("leaf.lo").alias("lo"), F.col("leaf.size").alias("leaf_size"), F.col("size").alias("total")).agg(F.array_sort(F.collect_list(F.struct("place", F.col(row_id).alias("id")))).alias("members"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in strata])
    each = leaves.withColumn("key", key).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    picks = each.withColumn("picks", _at_leaf(F.col("key"), F.col("seed"), F.col("lo"), F.col("leaf_size"), F.col("total")))
    counted = picks.withColumn("n", F.transform("members", lambda m: F.size(F.filter("picks", lambda p: p == m["place"] - F.col("lo")))))
    # Seeds of a leaf come together again: LEAF rows and an array of the seeds each.
    packed = counted.groupBy(*strata, "lo", "leaf_size", "total").agg(F.first("members").alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("seed", "n"))), lambda v: v["n"]).alias("by_seed"))
    member = packed.select(*strata, "by_seed", F.posexplode("members").alias("at", "m"))
    return member.select(*strata, F.col("m.id").alias(row_id), F.transform("by_seed", lambda v: F.get(v, F.col("at"))).alias("times"))


def sized_draws_sql(rows: str, strata: list[str], row_id: str, seeds: int) -> str:
    """The same as CTEs of DuckDB, ending in the table drawn(strata, row_id, seed, times); rows is a table of strata and row_id."""
    s, key = ", ".join(strata), "concat_ws('|', " + ", ".join(strata) + ")"
    u = lambda k, part: f"(('0x' || substr(md5({k}), {1 + 8 * part}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"
    node = f"concat_ws(':', {key}, seed, lo, size)"
    z = f"sqrt(-2 * ln({u(node, 0)})) * cos(2 * pi() * {u(node, 1)})"
    p = "(size // 2 / size)"
    pick = "floor((('0x' || substr(md5(concat_ws(':', key, seed, lo, 'leaf', attempt, j // 4)), (1 + 8 * (j % 4))::INT, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE * size)::BIGINT"
    return f"""numbered AS (SELECT {s}, {row_id}, row_number() OVER (PARTITION BY {s} ORDER BY md5({row_id}::VARCHAR), {row_id}) - 1 AS place FROM {rows} WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*strata, row_id])}),
halves AS (SELECT {s}, seed, 0::BIGINT AS lo, count(*) AS size, count(*) AS draws, count(*) AS total FROM numbered, range({seeds}) t(seed) GROUP BY {s}, seed
  UNION ALL SELECT {s}, seed, CASE WHEN side = 0 THEN lo ELSE lo + size // 2 END, CASE WHEN side = 0 THEN size // 2 ELSE size - size // 2 END, CASE WHEN side = 0 THEN to_left ELSE draws - to_left END, total
  FROM (SELECT *, least(draws, greatest(0, floor(draws * {p} + {z} * sqrt(draws * {p} * (1 - {p})) + 0.5)))::BIGINT AS to_left FROM halves WHERE size > {LEAF}), (VALUES (0), (1)) v(side)),
tried AS (SELECT *, {key} AS key, list_transform(range(draws), lambda j: {pick}) AS picks FROM halves, range({TRIES + 1}) a(attempt) WHERE size <= {LEAF} AND (attempt = 0 OR (total = size AND size > 1))),
picked AS (SELECT {s}, seed, lo, picks FROM (SELECT *, row_number() OVER (PARTITION BY {s}, seed, lo ORDER BY (total = size AND size > 1 AND len(list_distinct(picks)) = size AND attempt < {TRIES}), attempt) AS i FROM tried) WHERE i = 1),
taken AS (SELECT {s}, seed, lo + unnest(picks) AS place FROM picked),
tallied AS (SELECT {s}, seed, place, count(*) AS times FROM taken GROUP BY ALL),
drawn AS (SELECT {", ".join(f"n.{c}" for c in strata)}, n.{row_id}, t.seed, coalesce(y.times, 0) AS times FROM numbered n, range({seeds}) t(seed) LEFT JOIN tallied y ON {" AND ".join(f"y.{c} = n.{c}" for c in strata)} AND y.seed = t.seed AND y.place = n.place)"""
