"""Queries from bootstrapped curves to evidence of variants, each with its SQL but for the clean-up, which is tested on cases.

A dataset is a line number, a variant a line item with its quantity as the score, a little below a whole number; its class
follows from quantity and part, so that the ratio rises along the scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.functions import scales as sc
from evigrade.functions import thresholds as th
from evigrade.jobs.scales import _class
from evigrade.operators import ranges as op
from evigrade.operators.bootstrap import draws, draws_sql, with_unseen
from evigrade.operators.evidence import sorted_percentile
from evigrade.sources.staging import cut, once, table

SEEDS, SET_SEEDS = 16, 6
KEYS = {"dataset": "CAST(l_linenumber AS INT)", "id": "l_partkey * 100000000 + l_orderkey * 10 + l_linenumber"}
#: Measurements of one variant are averaged, and its flags follow.
FIELDS = {"at": "CAST(floor(avg(l_quantity)) AS INT)", "score": "round(avg(l_quantity) - avg(l_tax), 9)", "p": "avg(l_quantity) + max(l_partkey) % 23 > 42", "b": "avg(l_quantity) + max(l_partkey) % 23 < 24"}


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "lineitem").withColumns({n: F.expr(e) for n, e in KEYS.items()})
    return once(spark, "variant-rows", sf, lambda: keyed.groupBy(*KEYS).agg(*[F.expr(e).alias(n) for n, e in FIELDS.items()]))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, "curve-counts", sf, lambda: op.curve_counts(_rows(spark, sf), "dataset", "at", "id", "p", "b", SEEDS))


def _curves(spark: SparkSession, sf: str) -> DataFrame:
    """Each seed's log ratios."""
    return once(spark, "curves", sf, lambda: op.log_ratios(_counts(spark, sf), "dataset"))


def _percentiles(curves: DataFrame) -> DataFrame:
    q = F.percentile("l", F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)]))
    found = curves.groupBy("dataset", "grid").agg(q.alias("q"), F.count("l").alias("seeds"))
    return found.select("dataset", "grid", "seeds", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


def _prior(counts: DataFrame) -> DataFrame:
    return op.seed_priors(counts, "dataset").groupBy("dataset").agg(F.round(F.percentile("prior", 0.5), 9).alias("prior"))


def bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    """By dataset and seed, rows drawn, rows never drawn, and rows drawn twice or more."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("seed"), d.cast("long").alias("n")) for i, d in enumerate(draws(F.col("id"), SEEDS))])).alias("x")
    rows = _rows(spark, sf).select("dataset", each).groupBy("dataset", "x.seed", "x.n").agg(F.count("*").alias("rows"))
    return rows.groupBy("dataset", "seed").agg(F.sum(F.col("n") * F.col("rows")).alias("drawn"), F.sum(F.when(F.col("n") == 0, F.col("rows")).otherwise(0)).alias("unseen"), F.sum(F.when(F.col("n") > 1, F.col("rows")).otherwise(0)).alias("again"))


def lr_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles over the bootstraps of each dataset's log ratio along the scores."""
    return _percentiles(_curves(spark, sf))


def dataset_priors(spark: SparkSession, sf: str) -> DataFrame:
    return _prior(_counts(spark, sf)).withColumn("prior", F.round("prior", 6))


def fit_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of points of each bootstrap by its own curve and prior, for and against."""
    counts = _counts(spark, sf)
    curves = _curves(spark, sf).where("l IS NOT NULL").join(op.seed_priors(counts, "dataset").where("prior IS NOT NULL"), ["dataset", "seed"])
    step = op.step_of(F.col("prior"))
    graded = cut(curves.select("dataset", "seed", "grid", op.points_up(F.col("l"), step).alias("up"), op.points_down(F.col("l"), step).alias("down")), "fit-points")
    sides = [op.runs_of(graded.select("dataset", "seed", "grid", F.col(c).alias("points")), ["dataset", "seed"], "points") for c in ("up", "down")]
    return sides[0].unionByName(sides[1])


def _graded(spark: SparkSession, sf: str, against: float = 1.0) -> DataFrame:
    """dataset, grid, up, down: points by the low and the high percentile; the prior against may be another one, in proportion."""
    counts = _counts(spark, sf)
    curves = _percentiles(_curves(spark, sf)).join(_prior(counts), "dataset")
    up, down = op.points_up(F.col("p5"), op.step_of(F.col("prior"))), op.points_down(F.col("p95"), op.step_of(F.col("prior") * against))
    return cut(curves.select("dataset", "grid", up.alias("up"), down.alias("down")), "graded-curves")


def _both_sides(graded: DataFrame) -> DataFrame:
    up, down = (op.runs_of(graded.select("dataset", "grid", F.col(c).alias("points")), ["dataset"], "points") for c in ("up", "down"))
    return up.unionByName(down)


def score_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of points of each dataset: the low percentile decides for, the high one against."""
    return _both_sides(_graded(spark, sf))


def dual_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a prior of its own for evidence against."""
    return _both_sides(_graded(spark, sf, 0.5))


def class_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of classes along the scores by the posterior of the low percentile, and of the high one."""
    counts = _counts(spark, sf)
    curves = _percentiles(_curves(spark, sf)).join(_prior(counts), "dataset")
    of = lambda c: sc.class_of(F.round(th.posterior_from_lr(F.exp(c), F.col("prior")), 6))
    up = F.when(F.col("p5").isNotNull() & of("p5").isin("P", "LP"), of("p5"))
    down = F.when(F.col("p95").isNotNull() & of("p95").isin("B", "LB"), of("p95"))
    graded = cut(curves.select("dataset", "grid", up.alias("up"), down.alias("down")), "graded-classes")
    sides = [op.runs_of(graded.select("dataset", "grid", F.col(c).alias("class")), ["dataset"], "class") for c in ("up", "down")]
    return sides[0].unionByName(sides[1])


def reached_by_bootstraps(spark: SparkSession, sf: str) -> DataFrame:
    """By dataset and tier, the share of bootstraps without any evidence of that tier or a stronger one."""
    best = fit_ranges(spark, sf).groupBy("dataset", "seed").agg(F.max("points").alias("top"), F.min("points").alias("low"))
    every = op.seed_priors(_counts(spark, sf), "dataset").where("prior IS NOT NULL").select("dataset", "seed").join(best, ["dataset", "seed"], "left")
    tier = F.explode(F.array(*[F.lit(k) for k in (*range(1, 9), *range(-8, 0))])).alias("points")
    missed = F.when(F.col("points") > 0, F.coalesce("top", F.lit(0)) < F.col("points")).otherwise(F.coalesce("low", F.lit(0)) > F.col("points"))
    rows = every.select("dataset", "top", "low", tier)
    return rows.groupBy("dataset", F.col("points").cast("long").alias("points")).agg(F.round(F.avg(missed.cast("double")), 6).alias("missing"))


def range_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of each dataset after each kind of clean-up. flipped: the first class has the higher mean score."""
    found = cut(score_ranges(spark, sf), "raw-ranges").groupBy("dataset", "points").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("rs"))
    ranges = found.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct(F.col("points").cast("int"), "rs"))).alias("ranges"))
    missing = reached_by_bootstraps(spark, sf).groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct(F.col("points").cast("int"), "missing"))).alias("missing"))
    side = lambda c: F.avg(F.when(F.col(c), F.col("score")))
    about = _rows(spark, sf).groupBy("dataset").agg(F.min("at").cast("double").alias("low"), F.max("at").cast("double").alias("high"), F.coalesce(side("p") > side("b"), F.lit(False)).alias("flipped"))
    return op.cleaned(ranges.join(missing, "dataset").join(about, "dataset"), "dataset")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of the seeds' curves at each place."""
    return once(spark, "curve-places", sf, lambda: op.at_places(_curves(spark, sf), "dataset"))


def _at_scores(spark: SparkSession, sf: str) -> DataFrame:
    """dataset, id, score, prior, l5 and l95: percentiles of the seeds' curves at each variant's score, taken once for each distinct score."""
    rows = _rows(spark, sf).select("dataset", "id", "score")
    at = rows.select("dataset", "score").distinct().withColumn("grid", F.floor("score").cast("int")).join(_places(spark, sf), ["dataset", "grid"], "left")
    seen = F.coalesce("pieces", F.array().cast("array<struct<seed:bigint,l:double,next:double>>"))
    ls = F.sort_array(F.filter(F.transform(seen, lambda x: op.interpolated(x, F.col("score"))), lambda v: v.isNotNull()))
    found = at.join(F.broadcast(_prior(_counts(spark, sf))), "dataset").withColumn("ls", ls)
    found = found.select("dataset", "score", "prior", *[F.when(F.size("ls") > 0, F.round(sorted_percentile(F.col("ls"), q), 6)).alias(n) for n, q in (("l5", 0.05), ("l95", 0.95))])
    return rows.join(found, ["dataset", "score"])


def evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    """Each variant's points by the ranges of its dataset, percentiles of its ratio and posterior, class and fractional points."""
    ranges = cut(score_ranges(spark, sf), "evidence-ranges").groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("points", "lo", "hi"))).alias("ranges"))
    rows = _at_scores(spark, sf).join(ranges, "dataset", "left")
    # The first range that holds the score, weakest against first.
    points = F.coalesce(F.get(F.filter("ranges", lambda r: F.col("score").between(r["lo"], r["hi"])), F.lit(0))["points"], F.lit(0))
    post = lambda c: F.round(th.posterior_from_lr(F.exp(c), F.col("prior")), 6)
    low, high = F.when(F.col("l5").isNotNull(), sc.class_of(post("l5"))), F.when(F.col("l95").isNotNull(), sc.class_of(post("l95")))
    l, name = op.chosen_class(F.col("l5"), F.col("l95"), low, high)  # noqa: E741
    graded = rows.select("id", points.cast("long").alias("points"), "l5", "l95", post("l5").alias("post5"), post("l95").alias("post95"), name.alias("class"), l.alias("used"), "prior")
    shown = F.when(F.col("class") == "VUS", 0.0).when(F.col("class") != "Unknown", F.round(sc.display_points(F.col("used"), F.col("prior")), 5))
    return graded.select("id", "points", "l5", "l95", "post5", "post95", "class", shown.alias("display"))


def evidence_oob(spark: SparkSession, sf: str) -> DataFrame:
    """Each variant's evidence from the bootstraps that never drew it: percentiles, prior and points."""
    priors = once(spark, "packed-priors", sf, lambda: op.packed_priors(op.seed_priors(_counts(spark, sf), "dataset"), "dataset"))
    rows = op.of_unseen(_rows(spark, sf), _places(spark, sf), priors, "dataset", "id", "score", SEEDS)
    found = {"l5": (6, sorted_percentile(F.col("ls"), 0.05, F.col("n"))), "l95": (6, sorted_percentile(F.col("ls"), 0.95, F.col("n"))), "own_prior": (9, sorted_percentile(F.col("own"), 0.5))}
    rows = rows.select("id", F.col("n").cast("long").alias("n"), *[c.alias(name) for name, (_, c) in found.items()])
    rows = rows.select("id", "n", *[F.round(name, digits).alias(name) for name, (digits, _) in found.items()])
    rows = rows.withColumn("step", op.step_of(F.col("own_prior")))
    rows = rows.withColumns({"up": op.points_up(F.col("l5"), F.col("step")), "down": op.points_down(F.col("l95"), F.col("step"))})
    return rows.select("id", "n", "l5", "l95", F.round("own_prior", 6).alias("prior"), F.when(F.col("n") > 0, F.when(F.col("up") > 0, F.col("up")).otherwise(F.col("down"))).alias("points"))


def evidence_oob_full(spark: SparkSession, sf: str) -> DataFrame:
    """Each variant's points by the cleaned ranges of the bootstraps that never drew it, null where every one did.

    Curves, ranges and clean-up run once for each set of bootstraps and dataset, not once a variant.
    """
    rows = with_unseen(_rows(spark, sf).select("dataset", "id", "score"), "id", SET_SEEDS)
    sets = rows.select("dataset", "unseen").distinct()
    priors = op.seed_priors(_counts(spark, sf), "dataset").where("prior IS NOT NULL")
    curves = op.set_curves(sets, _curves(spark, sf).where(F.col("l").isNotNull()), priors, "dataset", SET_SEEDS)
    step = op.step_of(F.col("prior"))
    graded = cut(curves.select("dataset", "unseen", "grid", op.points_up(F.col("p5"), step).alias("up"), op.points_down(F.col("p95"), step).alias("down")), "set-points")
    keys = ["dataset", "unseen"]
    up, down = (op.runs_of(graded.select(*keys, "grid", F.col(c).alias("points")), keys, "points") for c in ("up", "down"))
    side = lambda c: F.avg(F.when(F.col(c), F.col("score")))
    flipped = _rows(spark, sf).groupBy("dataset").agg(F.coalesce(side("p") > side("b"), F.lit(False)).alias("is_flipped"))
    ranges = cut(op.outer_ranges(up.unionByName(down).join(F.broadcast(flipped), "dataset"), keys, "is_flipped"), "set-ranges")
    packed = ranges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("points", "lo", "hi"))).alias("ranges"))
    at = rows.join(packed, keys, "left")
    # The first range that holds the score, weakest against first.
    points = F.coalesce(F.get(F.filter("ranges", lambda r: F.col("score").between(r["lo"], r["hi"])), F.lit(0))["points"], F.lit(0).cast("long"))
    return at.select("id", F.bit_count("unseen").cast("long").alias("seeds"), F.when(F.col("unseen") > 0, points).alias("points"))


def variant_report(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence table with out-of-bag points beside the standard ones: what counts, by dataset and sign."""
    both = evidence_table(spark, sf).select("id", "points").join(evidence_oob(spark, sf).select("id", F.col("points").alias("oob_points")), "id", "left")
    dataset = F.pmod("id", F.lit(10)).alias("dataset")
    s = F.signum(F.coalesce("oob_points", "points")).cast("long").alias("sign")
    return both.groupBy(dataset, s).agg(F.count("*").alias("n"), F.count_if(F.col("oob_points").isNull()).alias("in_bag"), F.count_if(~F.col("points").eqNullSafe(F.col("oob_points"))).alias("changed"))


QUERIES = {f.__name__: f for f in (bootstrap_draws, lr_curves, dataset_priors, fit_ranges, score_ranges, dual_ranges, class_ranges, reached_by_bootstraps, range_cleanup, evidence_table, evidence_oob, evidence_oob_full, variant_report)}

_ROWS = "x AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in (KEYS | FIELDS).items()) + " FROM lineitem GROUP BY 1, 2)"
BAG = f"WITH {_ROWS}, w AS (SELECT x.*, seed, {draws_sql('id', 'seed')} AS d FROM x, range({SEEDS}) r(seed))"
CURVES = BAG + """, k AS (SELECT dataset, "at" AS grid, seed, coalesce(sum(d) FILTER (p), 0) AS p, coalesce(sum(d) FILTER (b), 0) AS b, sum(d) AS n FROM w GROUP BY 1, 2, 3),
z AS (SELECT *, min(grid) FILTER (n > 0) OVER v AS low, max(grid) FILTER (n > 0) OVER v AS high, ln(((p + 0.5::DOUBLE) / (sum(p) OVER v + count(*) OVER v / 2::DOUBLE)) / ((b + 0.5::DOUBLE) / (sum(b) OVER v + count(*) OVER v / 2::DOUBLE))) AS raw FROM k WINDOW v AS (PARTITION BY dataset, seed)),
c AS (SELECT dataset, seed, grid, CASE WHEN grid BETWEEN low AND high THEN round(raw, 9) END AS l FROM z),
sp AS (SELECT dataset, seed, (sum(p) + 1)::DOUBLE / (sum(n) + 2) AS prior FROM k GROUP BY 1, 2),
dp AS (SELECT dataset, round(median(prior), 9) AS prior FROM sp WHERE prior > 0 AND prior < 1 GROUP BY 1),
q AS (SELECT dataset, grid, count(l) AS seeds, round(quantile_cont(l, 0.05), 6) AS p5, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.95), 6) AS p95 FROM c GROUP BY 1, 2)"""
_STEP = "(ln(0.99 * (1 - {0}) / ({0} * 0.01)) / 8)"
_UP = "coalesce(CASE WHEN {0} >= {1} THEN least(8, floor({0} / {1} + 1e-9)) END, 0)::BIGINT"


def _runs(source: str, keys: str, value: str) -> str:
    over = f"PARTITION BY {keys} ORDER BY grid"
    return f"""(WITH f AS (SELECT *, lag({value}) OVER ({over}) AS before, row_number() OVER ({over}) AS k, max(grid) OVER (PARTITION BY {keys}) AS last FROM ({source})),
s AS (SELECT *, coalesce(lead(grid) OVER ({over}), last) AS hi FROM f WHERE k = 1 OR {value} IS DISTINCT FROM before) SELECT {keys}, grid::DOUBLE AS lo, hi::DOUBLE AS hi, {value} FROM s WHERE {value} IS NOT NULL AND {value}::STRING <> '0')"""


def _sides(of: str, keys: str, up: str, down: str, name: str) -> str:
    return " UNION ALL ".join(_runs(f"SELECT {keys}, grid, {e} AS {name} FROM {of}", keys, name) for e in (up, down))


def _down(x: str, step: str) -> str:
    return "-" + _UP.format(f"(-{x})", step)


_TWO = lambda against: _sides("q JOIN dp USING (dataset)", "dataset", _UP.format("p5", _STEP.format("prior")), _down("p95", _STEP.format(f"(prior * {against})")), "points")
_FIT = _sides("c JOIN sp USING (dataset, seed) WHERE l IS NOT NULL", "dataset, seed", _UP.format("l", _STEP.format("prior")), _down("l", _STEP.format("prior")), "points")
_TARGETS = {n: f"{t}::DOUBLE" for n, t in sc.TARGETS.items()}
_PST = "round(exp({0}) * prior / ((exp({0}) - 1) * prior + 1), 6)"
_AT = """, a AS (SELECT w.dataset, w.id, w.score, w.d, w.seed, CASE WHEN f.l IS NOT NULL AND w.score = floor(w.score) THEN f.l ELSE f.l + (g.l - f.l) * (w.score - floor(w.score)) END AS l FROM w LEFT JOIN c f ON f.dataset = w.dataset AND f.seed = w.seed AND f.grid = floor(w.score) LEFT JOIN c g ON g.dataset = w.dataset AND g.seed = w.seed AND g.grid = floor(w.score) + 1)"""
_EVIDENCE = CURVES + _AT + f""", h AS (SELECT dataset, id, any_value(score) AS score, round(quantile_cont(l, 0.05), 6) AS l5, round(quantile_cont(l, 0.95), 6) AS l95 FROM a GROUP BY 1, 2),
rg AS ({_TWO("1.0")}), pt AS (SELECT h.id, arg_min(points, {{'p': points, 'l': lo}}) AS points FROM h JOIN rg ON rg.dataset = h.dataset AND h.score BETWEEN rg.lo AND rg.hi GROUP BY 1),
o AS (SELECT h.*, prior, coalesce(pt.points, 0) AS points, {_PST.format("l5")} AS post5, {_PST.format("l95")} AS post95 FROM h JOIN dp USING (dataset) LEFT JOIN pt USING (id)),
cl AS (SELECT *, CASE WHEN l5 IS NOT NULL THEN {_class("post5", _TARGETS)} END AS low, CASE WHEN l95 IS NOT NULL THEN {_class("post95", _TARGETS)} END AS high FROM o),
ch AS (SELECT *, coalesce(low IN ('LP', 'P'), false) AND (NOT coalesce(high IN ('LB', 'B'), false) OR abs(l5) >= abs(l95)) AS use_up FROM cl),
us AS (SELECT *, ln(prior / (1 - prior)) AS lpo, CASE WHEN l5 IS NULL AND l95 IS NULL THEN 'Unknown' WHEN use_up THEN low WHEN coalesce(high IN ('LB', 'B'), false) THEN high ELSE 'VUS' END AS class, CASE WHEN use_up THEN l5 ELSE l95 END AS y FROM ch)"""
_DISPLAY = "CASE class WHEN 'VUS' THEN 0 WHEN 'Unknown' THEN NULL ELSE round(CASE WHEN y >= ln(9::DOUBLE) - lpo THEN 6 + (y - (ln(9::DOUBLE) - lpo)) * 4 / ln(11::DOUBLE) WHEN y >= -ln(9::DOUBLE) - lpo THEN -1 + (y - (-ln(9::DOUBLE) - lpo)) * 7 / (2 * ln(9::DOUBLE)) ELSE -7 + (y - (-ln(99::DOUBLE) - lpo)) * 6 / ln(11::DOUBLE) END, 5) END"
_OOB = f""", u AS (SELECT a.id, count(l) AS n, round(quantile_cont(l, 0.05), 6) AS l5, round(quantile_cont(l, 0.95), 6) AS l95, round(median(sp.prior), 9) AS prior FROM a JOIN sp USING (dataset, seed) WHERE d = 0 GROUP BY 1),
ids AS (SELECT x.id, coalesce(n, 0) AS n, l5, l95, prior FROM x LEFT JOIN u USING (id)),
ob AS (SELECT id, n, l5, l95, round(prior, 6) AS prior, CASE WHEN n > 0 THEN CASE WHEN {_UP.format("l5", _STEP.format("prior"))} > 0 THEN {_UP.format("l5", _STEP.format("prior"))} ELSE {_down("l95", _STEP.format("prior"))} END END AS points FROM ids)"""
SQL = {
    "bootstrap_draws": BAG + " SELECT dataset, seed, sum(d)::BIGINT AS drawn, count(*) FILTER (d = 0) AS unseen, count(*) FILTER (d > 1) AS again FROM w GROUP BY 1, 2",
    "lr_curves": CURVES + " SELECT * FROM q",
    "dataset_priors": CURVES + " SELECT dataset, round(prior, 6) AS prior FROM dp",
    "fit_ranges": CURVES + " " + _FIT,
    "score_ranges": CURVES + " " + _TWO("1.0"),
    "dual_ranges": CURVES + " " + _TWO("0.5"),
    "class_ranges": CURVES + f""", t AS (SELECT dataset, grid, CASE WHEN p5 IS NOT NULL THEN {_class(_PST.format("p5"), _TARGETS)} END AS a, CASE WHEN p95 IS NOT NULL THEN {_class(_PST.format("p95"), _TARGETS)} END AS b FROM q JOIN dp USING (dataset)) """ + _sides("t", "dataset", "CASE WHEN a IN ('P', 'LP') THEN a END", "CASE WHEN b IN ('B', 'LB') THEN b END", "class"),
    "reached_by_bootstraps": CURVES + f""", fr AS ({_FIT}), bt AS (SELECT dataset, seed, max(points) AS top, min(points) AS low FROM fr GROUP BY 1, 2), ev AS (SELECT dataset, seed, coalesce(top, 0) AS top, coalesce(low, 0) AS low FROM sp LEFT JOIN bt USING (dataset, seed))
SELECT dataset, k AS points, round(avg(CASE WHEN k > 0 THEN top < k ELSE low > k END::INT), 6) AS missing FROM ev, range(-8, 9) r(k) WHERE k <> 0 GROUP BY 1, 2""",
    "evidence_table": _EVIDENCE + f" SELECT id, points, l5, l95, post5, post95, class, {_DISPLAY} AS display FROM us",
    "evidence_oob": CURVES + _AT + _OOB + " SELECT * FROM ob",
    "evidence_oob_full": CURVES + f""", un AS (SELECT dataset, id, any_value(score) AS score, sum(CASE WHEN d = 0 THEN 1 << seed::INT ELSE 0 END)::BIGINT AS unseen FROM w WHERE seed < {SET_SEEDS} GROUP BY 1, 2),
st AS (SELECT DISTINCT dataset, unseen, seed FROM un, range({SET_SEEDS}) r(seed) WHERE unseen & (1 << seed::INT) > 0),
pr AS (SELECT dataset, unseen, round(median(prior), 9) AS prior FROM st JOIN sp USING (dataset, seed) WHERE prior > 0 AND prior < 1 GROUP BY 1, 2),
sc AS (SELECT dataset, unseen, grid, round(quantile_cont(l, 0.05), 6) AS p5, round(quantile_cont(l, 0.95), 6) AS p95 FROM st JOIN c USING (dataset, seed) WHERE l IS NOT NULL GROUP BY 1, 2, 3),
rr AS ({_sides("sc JOIN pr USING (dataset, unseen)", "dataset, unseen", _UP.format("p5", _STEP.format("prior")), _down("p95", _STEP.format("prior")), "points")}),
fl AS (SELECT dataset, coalesce(avg(score) FILTER (p) > avg(score) FILTER (b), false) AS flipped FROM x GROUP BY 1),
ou AS (SELECT dataset, unseen, points, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY dataset, unseen, points ORDER BY CASE WHEN (points > 0) = flipped THEN lo ELSE -lo END) AS i FROM rr JOIN fl USING (dataset)) WHERE i = 1),
cl AS (SELECT * FROM ou a WHERE NOT EXISTS (SELECT 1 FROM ou q WHERE q.dataset = a.dataset AND q.unseen = a.unseen AND q.points * a.points > 0 AND abs(q.points) > abs(a.points) AND q.lo <= a.lo AND a.hi <= q.hi)),
hit AS (SELECT un.id, arg_min(points, {{'p': points, 'l': lo}}) AS points FROM un JOIN cl ON cl.dataset = un.dataset AND cl.unseen = un.unseen AND un.score BETWEEN cl.lo AND cl.hi GROUP BY 1)
SELECT un.id, bit_count(unseen)::BIGINT AS seeds, CASE WHEN unseen > 0 THEN coalesce(hit.points, 0) END AS points FROM un LEFT JOIN hit USING (id)""",
    "variant_report": _EVIDENCE + _OOB + """, bo AS (SELECT us.id, us.points, ob.points AS oob FROM us LEFT JOIN ob USING (id))
SELECT id % 10 AS dataset, sign(coalesce(oob, points))::BIGINT AS sign, count(*) AS n, count(*) FILTER (oob IS NULL) AS in_bag, count(*) FILTER (points IS DISTINCT FROM oob) AS changed FROM bo GROUP BY 1, 2""",
}
