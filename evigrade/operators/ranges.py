"""Likelihood ratio curves over a grid, ranges of points along them, and the clean-up of ranges.

Curves come from counts by dataset, grid place and seed, a table whose size is the grid's and not the data's. Ranges of a
dataset are few; their clean-up is plain Python over one row a dataset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrade.operators.bootstrap import seeds_of_blocks, with_block_draws, with_unseen

TIERS = 8
#: A range: where it begins and ends.
Range = tuple[float, float]
RANGE_TYPE = "map<int,array<struct<lo:double,hi:double>>>"


def curve_counts(rows: DataFrame, dataset: str, at: str, row_id: str, first: str, second: str, seeds: int) -> DataFrame:
    """dataset, grid, seed, p, b, n: rows of the first class, of the second, and all that each seed drew at each place."""
    drawn = with_block_draws(rows.select(dataset, F.col(at).cast("int").alias("grid"), row_id, first, second), row_id, seeds)
    # Rows are summed by their flags first, so that they meet eight sums and not three times as many.
    flagged = drawn.groupBy(dataset, "grid", "block", first, second).agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(8)])
    of = lambda flag, i: F.sum(F.when(F.col(flag), F.col(f"d{i}")).otherwise(0) if flag else F.col(f"d{i}"))
    sums = flagged.groupBy(dataset, "grid", "block").agg(*[of(f, i).alias(f"{n}{i}") for n, f in (("p", first), ("b", second), ("n", None)) for i in range(8)])
    return seeds_of_blocks(sums, [dataset, "grid"], {n: [F.col(f"{n}{i}") for i in range(8)] for n in "pbn"}, seeds)


def log_ratios(counts: DataFrame, dataset: str) -> DataFrame:
    """dataset, seed, grid, l: log ratio of both densities, half a row added at each place; null beyond the places that the seed drew."""
    w = Window.partitionBy(dataset, "seed")
    inside = F.when(F.col("n") > 0, F.col("grid"))
    places = F.count("*").over(w) / 2
    share = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(w) + places)
    limits = counts.select("*", F.min(inside).over(w).alias("low"), F.max(inside).over(w).alias("high"), F.ln(share("p") / share("b")).alias("raw"))
    return limits.select(dataset, "seed", "grid", F.when(F.col("grid").between(F.col("low"), F.col("high")), F.round("raw", 9)).alias("l"))


def seed_priors(counts: DataFrame, dataset: str) -> DataFrame:
    """dataset, seed, prior: share of the first class among all that the seed drew, with one row of each class added; null outside 0 and 1."""
    prior = (F.sum("p") + 1) / (F.sum("n") + 2)
    return counts.groupBy(dataset, "seed").agg(F.when((prior > 0) & (prior < 1), prior).alias("prior"))


def step_of(prior: Column) -> Column:
    """Log ratio of one point at a prior, so that eight are enough for a posterior of 0.99."""
    return F.ln(0.99 * (1 - prior) / (prior * 0.01)) / TIERS


def points_up(l: Column, step: Column) -> Column:  # noqa: E741
    return F.coalesce(F.when(l >= step, F.least(F.lit(TIERS), F.floor(l / step + 1e-9))), F.lit(0)).cast("long")


def points_down(l: Column, step: Column) -> Column:  # noqa: E741
    return -points_up(-l, step)


def runs_of(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, lo, hi, value of the runs of one value along a grid; a run ends where the next begins, the last at the grid's end; null and 0 give none."""
    w = Window.partitionBy(*keys).orderBy("grid")
    before = curve.select(*keys, "grid", value, F.lag(value).over(w).alias("before"), F.row_number().over(w).alias("k"), F.max("grid").over(Window.partitionBy(*keys)).alias("last"))
    starts = before.where((F.col("k") == 1) | ~F.col(value).eqNullSafe(F.col("before")))
    ended = starts.withColumn("hi", F.coalesce(F.lead("grid").over(w), "last"))
    return ended.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "0")).select(*keys, F.col("grid").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), value)


def at_places(curves: DataFrame, dataset: str) -> DataFrame:
    """dataset, grid and pieces: at each place an array of (seed, l, next), the values there and at the next place; a row a place, whatever the number of rows."""
    following = curves.select(dataset, "seed", (F.col("grid") - 1).alias("grid"), F.col("l").alias("next"))
    both = curves.join(following, [dataset, "seed", "grid"], "left")
    return both.groupBy(dataset, "grid").agg(F.array_sort(F.collect_list(F.struct("seed", "l", "next"))).alias("pieces"))


def outer_ranges(ranges: DataFrame, keys: list[str], flipped: str) -> DataFrame:
    """keys, points, lo and hi: of each tier the range towards the middle; a tier goes where a stronger one of its sign covers all of it.

    The same as ``liberal`` on rows instead of one dataset's dictionary. flipped is a column that is one value for each of keys.
    """
    ends = F.struct("lo", "hi")
    tiers = ranges.groupBy(*keys, "points").agg(F.min_by(ends, "lo").alias("low"), F.max_by(ends, "lo").alias("high"), F.first(flipped).alias("flipped"))
    kept = tiers.select(*keys, "points", F.when((F.col("points") > 0) == F.col("flipped"), F.col("low")).otherwise(F.col("high")).alias("r")).select(*keys, "points", "r.lo", "r.hi")
    stronger = kept.select(*keys, F.col("points").alias("q"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    covered = kept.join(stronger, keys).where("q * points > 0 AND abs(q) > abs(points) AND q_lo <= lo AND hi <= q_hi").select(*keys, "points").distinct()
    return kept.join(covered, [*keys, "points"], "left_anti")


def set_curves(sets: DataFrame, curves: DataFrame, priors: DataFrame, dataset: str, seeds: int) -> DataFrame:
    """dataset, unseen, grid, p5, p95 and prior: percentiles of the curves of each set of seeds, and the median of their priors.

    sets has the distinct dataset and unseen. However many variants share a set, its curves are taken once; a set of no seeds has none.
    """
    seed = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))).alias("seed")
    of_set = sets.select(dataset, "unseen", seed).where(F.expr("unseen & shiftleft(1L, CAST(seed AS INT)) > 0"))
    prior = of_set.join(priors, [dataset, "seed"]).groupBy(dataset, "unseen").agg(F.round(F.percentile("prior", 0.5), 9).alias("prior"))
    q = F.percentile("l", F.array(F.lit(0.05), F.lit(0.95)))
    found = of_set.join(curves, [dataset, "seed"]).groupBy(dataset, "unseen", "grid").agg(q.alias("q"))
    return found.join(prior, [dataset, "unseen"]).select(dataset, "unseen", "grid", "prior", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p95"))])


def _mask(values: Column, seeds: int) -> Column:
    """The places of an array that have a value, as a bit mask."""
    bits = [F.when(F.get(values, F.lit(s)).isNotNull(), F.lit(1 << s).cast("long")).otherwise(F.lit(0).cast("long")) for s in range(seeds)]
    return sum(bits[1:], bits[0])


def of_unseen(rows: DataFrame, pieces: DataFrame, priors: DataFrame, dataset: str, row_id: str, score: str, seeds: int) -> DataFrame:
    """row_id, n, ls and own: of the seeds that never drew a row the n values at its score, sorted after a null for each other seed, and their sorted priors.

    pieces is as at_places gives it, and a row meets those at its own place only; nothing but small tables moves. What is done for
    each row is Java code, one expression a seed: a lambda over the pieces is interpreted, for each seed of each row. The one over
    the priors costs little and makes that step code of its own, in methods of a size that Java compiles; whole-stage code
    would be one of over 8,000 bytes, which Java interprets.
    """
    of = F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda s: F.get(F.filter("pieces", lambda x: x["seed"] == s), F.lit(0)))
    places = pieces.select(dataset, "grid", of["l"].alias("l"), of["next"].alias("next")).withColumn("there", _mask(F.col("l"), seeds))
    places = places.withColumn("between", F.col("there").bitwiseAND(_mask(F.col("next"), seeds)))
    at = with_unseen(rows.select(dataset, row_id, score), row_id, seeds).withColumn("grid", F.floor(score).cast("int"))
    at = at.join(places, [dataset, "grid"], "left").join(F.broadcast(priors), dataset).withColumn("f", F.col(score) - F.col("grid"))
    held = F.col("unseen").bitwiseAND(F.when(F.col("f") == 0, F.col("there")).otherwise(F.col("between")))
    at = at.withColumn("held", F.coalesce(held, F.lit(0).cast("long")))
    l, after = ([F.get(c, F.lit(s)) for s in range(seeds)] for c in ("l", "next"))
    value = [F.when(F.col("f") == 0, l[s]).otherwise(l[s] + (after[s] - l[s]) * F.col("f")) for s in range(seeds)]
    ls = F.sort_array(F.array(*[F.when(F.col("held").bitwiseAND(F.lit(1 << s).cast("long")) != 0, v) for s, v in enumerate(value)]))
    own = F.filter("priors", lambda x: x["bit"].bitwiseAND(F.col("unseen")) != 0)["prior"]
    return at.select(row_id, F.bit_count("held").alias("n"), ls.alias("ls"), own.alias("own"))


def packed_priors(priors: DataFrame, dataset: str) -> DataFrame:
    """dataset and priors: an array of (prior, bit of its seed), sorted, without nulls."""
    each = F.when(F.col("prior").isNotNull(), F.struct("prior", F.expr("shiftleft(1L, CAST(seed AS INT))").alias("bit")))
    return priors.groupBy(dataset).agg(F.sort_array(F.collect_list(each)).alias("priors"))


def interpolated(piece: Column, score: Column) -> Column:
    """Value at score of a piece that begins at the whole place below it; null where a neighbour that counts is null."""
    f = score - F.floor(score)
    return F.when(f == 0, piece["l"]).otherwise(piece["l"] + (piece["next"] - piece["l"]) * f)


def chosen_class(l5: Column, l95: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The bound that speaks for a variant and its class: the low one if that is likely pathogenic, the high one if that is likely benign.

    Where both decide, the larger one does; where neither does it is VUS, by the bound nearer to 0. low and high are their classes.
    """
    up, down = low.isin("LP", "P"), high.isin("LB", "B")
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    nearer = F.when(l95.isNull() | (F.abs(l5) <= F.abs(l95)), l5).otherwise(l95)
    use_up = up & (~down | (F.abs(l5) >= F.abs(l95)))
    return F.when(use_up, l5).when(down, l95).otherwise(F.coalesce(nearer, l95)), F.when(l5.isNull() & l95.isNull(), "Unknown").when(use_up, low).when(down, high).otherwise("VUS")


# Clean-up: ranges by points, positive ones for the first class. ``flipped`` says that the first class has the high scores.


def _outer(ranges: list[Range], low_side: bool) -> list[Range]:
    return [ranges[0] if low_side else ranges[-1]] if ranges else []


def liberal(ranges: dict[int, list[Range]], flipped: bool) -> dict[int, list[Range]]:
    """One range a tier, the one towards the middle for either class; a tier goes where a stronger one covers all of it."""
    kept = {p: _outer(rs, low_side=(p > 0) == flipped) for p, rs in ranges.items()}
    for p in sorted(kept, key=abs):
        stronger = (kept[q][0] for q in kept if q * p > 0 and abs(q) > abs(p) and kept[q])
        if kept[p] and any(lo <= kept[p][0][0] and kept[p][0][1] <= hi for lo, hi in stronger):
            kept[p] = []
    return kept


def strict(ranges: dict[int, list[Range]], ends: Range) -> dict[int, list[Range]]:
    """Evidence that falls off again goes: a lone weakest tier that touches no end of the scores, and all beyond the first tier that had to be mended.

    A tier in several pieces that the next one doesn't join keeps the pieces that touch it; what is still in pieces is taken as one.
    """
    out = {}
    for sign in (1, -1):
        capped = False
        for k in range(1, TIERS + 1):
            pieces, above = list(ranges.get(sign * k, [])), ranges.get(sign * (k + 1), [])
            if k == 1 and pieces and not above and not (pieces[0][0] in (ends[0], -math.inf) or pieces[-1][1] in (ends[1], math.inf)):
                capped = True
            if capped:
                pieces = []
            elif len(pieces) > 1:
                if above and above[0][0] != pieces[0][1] and above[-1][1] != pieces[-1][0]:
                    pieces = [r for r in pieces if r[0] == above[-1][1] or r[1] == above[0][0]]
                    capped = not pieces
                if len(pieces) > 1:
                    pieces, capped = [(pieces[0][0], pieces[-1][1])], True
            out[sign * k] = pieces
    return out


def extended(ranges: dict[int, list[Range]], ends: Range, flipped: bool) -> dict[int, list[Range]]:
    """The strongest tier of a class goes on to its end of the scores; a tier that then covers all scores goes."""
    out = dict(ranges)
    for sign in (1, -1):
        reached = [k for k in range(1, TIERS + 1) if out.get(sign * k)]
        if reached:
            p = sign * reached[-1]
            rs = out[p]
            out[p] = [(ends[0], rs[-1][1])] if (sign > 0) != flipped else [(rs[0][0], ends[1])]
    return {p: [] if rs and (rs[0][0], rs[-1][1]) == ends else rs for p, rs in out.items()}


def without_claimed(one: Range, claimed: list[Range]) -> list[Range]:
    """What is left of a range outside the claimed ones."""
    pieces = [one]
    for lo, hi in claimed:
        cut = [[(a, b)] if hi <= a or lo >= b else [(a, lo)] * (lo > a) + [(hi, b)] * (hi < b) for a, b in pieces]
        pieces = [r for rs in cut for r in rs]
    return pieces


def benign_envelopes(ranges: dict[int, list[Range]]) -> dict[int, list[Range]]:
    """Benign tiers, strongest first, as the span of their pieces without what a stronger one has claimed; nothing is extended."""
    out, claimed = dict(ranges), []
    for k in range(TIERS, 0, -1):
        if rs := ranges.get(-k):
            span = (min(a for a, _ in rs), max(b for _, b in rs))
            out[-k] = without_claimed(span, claimed)
            claimed.append(span)
    return out


def two_sided(ranges: dict[int, list[Range]], centre: float | None, ends: Range, is_liberal: bool = True) -> dict[int, list[Range]]:
    """Pathogenic tiers cleaned on either side of the benign centre as if each were a set of its own."""
    if centre is None:
        return ranges
    out = dict(ranges)
    sides = {}
    for flipped in (False, True):
        own = {k: [r for r in ranges.get(k, []) if ((r[0] + r[1]) / 2 >= centre) == flipped] for k in range(1, TIERS + 1)}
        mend = (lambda rs, f=flipped: liberal(rs, f)) if is_liberal else (lambda rs: strict(rs, ends))
        sides[flipped] = mend(extended(mend(own), (-math.inf, math.inf), flipped))
    for k in range(1, TIERS + 1):
        out[k] = sides[False].get(k, []) + sides[True].get(k, [])
    return out


def covered_enough(ranges: dict[int, list[Range]], missing: dict[int, float], most: float = 0.05) -> dict[int, list[Range]]:
    """A tier that too many bootstraps don't reach goes; its ranges fall to the next weaker tier that has any."""
    out = {p: list(rs) for p, rs in ranges.items()}
    for sign in (1, -1):
        for k in range(1, TIERS + 1):
            p = sign * k
            if out.get(p) and missing.get(p, 0.0) > most:
                weaker = next((sign * j for j in range(k - 1, 0, -1) if out.get(sign * j)), None)
                if weaker is not None:
                    out[weaker] = sorted(out[weaker] + out[p])
                out[p] = []
    return out


def is_two_sided(ranges: dict[int, list[Range]]) -> bool:
    """Whether along the scores a range for the first class lies on both sides of one against it."""
    signs = [s for _, s in sorted((lo, 1 if p > 0 else -1) for p, rs in ranges.items() for lo, _ in rs)]
    return any(s < 0 and 1 in signs[:i] and 1 in signs[i + 1 :] for i, s in enumerate(signs))


def cleaned(rows: DataFrame, dataset: str) -> DataFrame:
    """dataset, kind, points, lo, hi of the ranges of each dataset after each clean-up. rows has a row a dataset: ranges, missing, low, high, flipped."""
    kind = dict(rows.dtypes)[dataset]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                raw = {k: [] for k in [*range(1, TIERS + 1), *range(-1, -TIERS - 1, -1)]} | {int(p): sorted((x["lo"], x["hi"]) for x in rs) for p, rs in dict(r.ranges).items()}
                ends, flipped = (r.low, r.high), bool(r.flipped)
                benign = [x for p in raw if p < 0 for x in raw[p]]
                centre = (min(a for a, _ in benign) + max(b for _, b in benign)) / 2 if benign else None
                once = liberal(raw, flipped)
                kinds = {
                    "liberal": liberal(extended(once, ends, flipped), flipped), "strict": strict(extended(strict(raw, ends), ends, flipped), ends),
                    "covered": covered_enough(raw, {int(k): v for k, v in dict(r.missing).items()}), "two_sided": two_sided(benign_envelopes(raw), centre, ends),
                }
                out += [(getattr(r, dataset), n, p, lo, hi) for n, by in kinds.items() for p, rs in by.items() for lo, hi in rs]
            yield pd.DataFrame(out, columns=[dataset, "kind", "points", "lo", "hi"])

    return rows.select(dataset, "ranges", "missing", "low", "high", "flipped").mapInPandas(run, f"`{dataset}` {kind}, kind string, points int, lo double, hi double")
