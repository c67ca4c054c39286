"""Queries from fits to evidence, each with its SQL: densities, priors, likelihood ratio curves, ranges and evidence.

A dataset is a language and a mode: with both labelled classes (pn), with the first one only (pu) or the second one only (nu).
Fits are by moments, so that SQL can make them too; the operators take any fits, those of ``mixtures`` as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.jobs.calibration import SCORED, _scores
from evigrade.operators import choice, mixtures, ranges
from evigrade.operators import fits as op
from evigrade.operators.bootstrap import draws_sql
from evigrade.sources import scoresets
from evigrade.sources.staging import cut, once, shared_folder

SEEDS, BINS, PLACES, ROUNDS = 8, 256, 41, 8
MODES = {"pn": (0, 1, 2), "pu": (0, 2), "nu": (1, 2)}
DATASET = ["lang", "mode"]
FIT = [*DATASET, "seed"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).withColumn("score", F.round("score", 9))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """lang, mode, seed, sample, x, rows, n, unseen: each mode keeps the counts of its samples."""
    return once(spark, "fit-counts", sf, lambda: _counted(spark, sf))


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    counts = mixtures.counted_scores(_rows(spark, sf), "lang", SEEDS, BINS).withColumn("x", F.round("x", 9))
    in_mode = F.array(*[F.struct(F.lit(m).alias("mode"), F.array(*[F.lit(s) for s in samples]).alias("samples")) for m, samples in MODES.items()])
    each = counts.select("*", F.explode(in_mode).alias("m")).where(F.array_contains("m.samples", F.col("sample")))
    return each.select("lang", "m.mode", "seed", "sample", "x", "rows", "n", "unseen")


def _fits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = _counts(spark, sf)
    return once(spark, "moment-fits", sf, lambda: op.moment_fits(counts, FIT, ROUNDS)), counts


def _priors(spark: SparkSession, sf: str) -> DataFrame:
    """The prior of each fit, from its densities at the population's scores."""
    fits, counts = _fits(spark, sf)
    population = counts.where(F.col("sample") == op.POPULATION).select(*FIT, "x", F.col("rows").alias("n"))
    return once(spark, "fit-priors", sf, lambda: op.fit_priors(op.at_places(fits.drop("lo", "hi"), population, FIT), FIT))


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    ends = _rows(spark, sf).groupBy("lang").agg(F.min("score").alias("least"), F.max("score").alias("most")).where("most > least")
    places = ends.select("lang", "least", "most", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("grid"))
    x = F.col("least") + (F.col("grid") + 0.5) / PLACES * (F.col("most") - F.col("least"))
    return places.select("lang", F.col("grid").cast("long").alias("grid"), F.round(x, 9).alias("x")).crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in MODES], "mode string")))


def _ratios(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Log ratios of all fits over the grid, and the priors of the fits."""
    priors = _priors(spark, sf)
    return once(spark, "fit-ratios", sf, lambda: op.log_ratio(op.at_places(_fits(spark, sf)[0], _grid(spark, sf), DATASET), priors, FIT)), priors


def moment_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Components and weights of each fit, a row a component."""
    fits = _fits(spark, sf)[0].select(*FIT, "weights", F.posexplode("components").alias("k", "c"))
    w = [F.round(F.get(F.get("weights", F.lit(s)), F.col("k")), 5).alias(n) for s, n in enumerate(("w_p", "w_b", "w_pop"))]
    return fits.select(*FIT, F.col("k").cast("long").alias("k"), *[F.round(f"c.{c}", 5).alias(c) for c in ("a", "loc", "scale")], *w)


def fit_densities(spark: SparkSession, sf: str) -> DataFrame:
    """Log densities of both classes over the grid, that of a class without a sample unmixed from the population."""
    seen = op.at_places(_fits(spark, sf)[0], _grid(spark, sf), DATASET).join(_priors(spark, sf), FIT, "left")
    p, b = op.class_log_densities(F.col("log_p"), F.col("log_b"), F.col("log_pop"), F.col("prior"))
    return seen.select(*FIT, "grid", F.round(p, 3).alias("log_p"), F.round(b, 3).alias("log_b"), F.round("log_pop", 3).alias("log_pop"))


def fit_priors(spark: SparkSession, sf: str) -> DataFrame:
    """The prior of each fit, null where it can't be told."""
    return _priors(spark, sf).withColumn("prior", F.round("prior", 4))


def fitted_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Each dataset's prior, the share of fits that kept theirs, and whether it is unstable."""
    return op.dataset_priors(_priors(spark, sf), DATASET).withColumns({"prior": F.round("prior", 4), "kept": F.round("kept", 6)})


def fit_lr_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles over the fits of each dataset's log ratio along the scores."""
    found = op.curve_percentiles(_ratios(spark, sf)[0], [*DATASET, "grid"])
    return found.withColumns({c: F.round(c, 2) for c in ("p5", "p50", "p95")})


def fit_point_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of points of each dataset from its fits: the low percentile decides for, the high one against."""
    ratios, priors = _ratios(spark, sf)
    curves = op.curve_percentiles(ratios, [*DATASET, "grid"]).join(op.dataset_priors(priors, DATASET), DATASET)
    step = ranges.step_of(F.round("prior", 4))
    sides = {"up": ranges.points_up(F.round("p5", 2), step), "down": ranges.points_down(F.round("p95", 2), step)}
    graded = cut(curves.select(*DATASET, "grid", *[c.alias(n) for n, c in sides.items()]), "fit-graded")
    up, down = (ranges.runs_of(graded.select(*DATASET, "grid", F.col(c).alias("points")), DATASET, "points") for c in sides)
    return up.unionByName(down)


def fit_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's ratio percentiles, posteriors and points from the fits of its language, at its own score.

    Curves are taken at the distinct scores and joined back, so no row carries the curves of the fits.
    """
    fits, priors = _fits(spark, sf)[0], _priors(spark, sf)
    rows = _rows(spark, sf).where("lang IS NOT NULL")
    places = rows.select("lang", F.col("score").alias("x")).distinct().withColumn("mode", F.lit("pn"))
    found = op.curve_percentiles(op.log_ratio(op.at_places(fits, places, DATASET), priors, FIT), [*DATASET, "x"])
    told = op.dataset_priors(priors, DATASET).where("mode = 'pn'").select("lang", F.round("prior", 4).alias("prior"))
    at = rows.join(found.select("lang", F.col("x").alias("score"), "fits", F.round("p5", 2).alias("l5"), F.round("p95", 2).alias("l95")), ["lang", "score"]).join(told, "lang")
    step = ranges.step_of(F.col("prior"))
    up, down = ranges.points_up(F.col("l5"), step), ranges.points_down(F.col("l95"), step)
    return at.select("doc_id", "fits", "l5", "l95", F.when(up > 0, up).otherwise(down).alias("points"))


def ratio_checks(spark: SparkSession, sf: str) -> DataFrame:
    """For each fit whether neighbouring components' density ratios and the likelihood ratio are monotone over the grid."""
    return op.ratio_checks(_fits(spark, sf)[0].drop("lo", "hi"), _grid(spark, sf), DATASET, FIT)


def model_gains(spark: SparkSession, sf: str) -> DataFrame:
    """lang, seed and gain: how much likelier the rows that a bootstrap never drew are, on average, under the fit with both classes than under that with the first one only."""
    fits, counts = _fits(spark, sf)[0], _counts(spark, sf)
    unseen = counts.where((F.col("sample") == op.POPULATION) & (F.col("unseen") > 0)).select(*FIT, "x", "unseen")
    ll = op.at_places(fits.drop("lo", "hi"), unseen, FIT).groupBy(*FIT).agg((F.sum(F.col("log_pop") * F.col("unseen")) / F.sum("unseen")).alias("ll"))
    both = ll.groupBy("lang", "seed").agg(*[F.max(F.when(F.col("mode") == m, F.col("ll"))).alias(m) for m in ("pn", "pu")])
    return both.where("pn IS NOT NULL AND pu IS NOT NULL").select("lang", "seed", F.round(F.col("pn") - F.col("pu"), 6).alias("gain"))


def paired_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the larger model is to be taken: by the signed ranks of its gains, and, more cautiously, by their 5th percentile."""
    gains = cut(model_gains(spark, sf), "model-gains")
    low = gains.groupBy("lang").agg(F.percentile("gain", 0.05).alias("low"))
    tested = choice.signed_rank(gains, ["lang"], "gain").join(low, "lang")
    return tested.select("lang", "n", F.round("w", 3).alias("w"), F.round("p", 6).alias("p"), (F.col("p") < 0.05).alias("larger"), (F.col("low") > 0).alias("larger_cautious"))


def calibration_file(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrations written as JSON lines, one a dataset, and read back: prior, its stability, and the ranges of each tier."""
    path = f"{shared_folder(spark)}/calibrations-{uuid.uuid4().hex}"
    calibrations = scoresets.calibrations(fitted_priors(spark, sf), fit_point_ranges(spark, sf), DATASET)
    scoresets.write_json(calibrations, path)
    back = scoresets.read_json(spark, path, calibrations.schema)
    return back.select(*DATASET, "prior", "unstable", F.explode_outer("ranges").alias("points", "rs")).select(*DATASET, "prior", "unstable", F.col("points").cast("long").alias("points"), F.size("rs").cast("long").alias("n"), F.get("rs", F.lit(0))["lo"].alias("lo"), F.get("rs", F.size("rs") - 1)["hi"].alias("hi"))


QUERIES = {f.__name__: f for f in (model_gains, paired_choice, calibration_file, ratio_checks, moment_fits, fit_densities, fit_priors, fitted_priors, fit_lr_curves, fit_point_ranges, fit_evidence)}

_C = repr(op.LOG_ROOT_TAU)


def log_cdf_sql(z: str) -> str:
    """Log of the normal distribution function as SQL of DuckDB, z being a column or an expression in brackets."""
    x = f"abs({z})"
    fraction = f"list_reduce(list_prepend({x}, range({op.LEVELS}, 0, -1)::DOUBLE[]), lambda acc, k: {x} + k / acc)"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, range({op.TERMS}, 0, -1)::DOUBLE[]), lambda acc, k: 1 + {z} * {z} / (2 * k + 1) * acc)"
    tail = f"(-{z} * {z} / 2 - {_C} - ln({fraction}))"
    return f"CASE WHEN {x} < {op.FAR} THEN ln(0.5 + exp(-{z} * {z} / 2 - {_C}) * {z} * {series}) WHEN {z} < 0 THEN {tail} ELSE ln(1 - exp({tail})) END"


def _logs(table: str, keys: str) -> str:
    """Rows of table (keys and x) times the components of their fit: keys, k and l, the log density of the component there."""
    return f"SELECT {keys}, k, ln(2) - {_C} - ln(scale) - d * d / 2 + {log_cdf_sql('z')} AS l FROM (SELECT {keys}, k, scale, (x - loc) / scale AS d, a * (x - loc) / scale AS z FROM {table} JOIN comp USING (lang, mode, seed))"


#: Log densities of the samples by place, from the component's log densities l and weights.
_MIX = lambda w: f"max(l + ln({w})) FILTER (WHERE {w} > 0) + ln(sum(exp(l + ln({w}) - t_{w})) FILTER (WHERE {w} > 0))"


def _mixed(logs: str, keys: str) -> str:
    tops = ", ".join(f"max(CASE WHEN {w} > 0 THEN l + ln({w}) END) OVER (PARTITION BY {keys}) AS t_{w}" for w in ("w_p", "w_b", "w_pop"))
    return f"SELECT {keys}, {', '.join(f'{_MIX(w)} AS log_{w[2:]}' for w in ('w_p', 'w_b', 'w_pop'))} FROM (SELECT *, {tops} FROM {logs} JOIN weights USING (lang, mode, seed, k)) GROUP BY {keys}"


def _round(i: int) -> str:
    return f"""w{i} AS MATERIALIZED (SELECT lang, mode, seed, sample, k, sum(n * e / total) / any_value(all_n) AS w FROM (
  SELECT *, sum(e) OVER (PARTITION BY lang, mode, seed, sample, bin) AS total FROM (
    SELECT *, exp(j - max(j) OVER (PARTITION BY lang, mode, seed, sample, bin)) AS e FROM (
      SELECT b.*, l + ln(greatest(w, 1e-300)) AS j FROM binlogs b JOIN w{i - 1} USING (lang, mode, seed, sample, k)))) GROUP BY ALL)"""


_FIT_SQL = f"""WITH RECURSIVE {SCORED}, r AS (SELECT * REPLACE (round(score, 9) AS score) FROM s),
e AS (SELECT lang, min(score) AS lo, max(score) AS hi FROM r GROUP BY 1 HAVING max(score) > min(score)),
m AS (SELECT doc_id, lang, score, unnest(list_filter([CASE WHEN is_plp THEN 0 END, CASE WHEN is_blb THEN 1 END, 2], lambda v: v IS NOT NULL)) AS sample, least({BINS - 1}, floor((score - lo) / (hi - lo) * {BINS}))::INT AS bin FROM r JOIN e USING (lang)),
at_bin AS (SELECT lang, sample, bin, round(avg(score), 9) AS x, count(*) AS rows FROM m GROUP BY ALL),
drawn AS (SELECT lang, seed, sample, bin, sum({draws_sql("doc_id", "seed")}) AS n, count(*) FILTER (WHERE {draws_sql("doc_id", "seed")} = 0) AS unseen FROM m, range({SEEDS}) t(seed) GROUP BY ALL),
counts AS MATERIALIZED (SELECT lang, mode, seed, sample, bin, x, rows, n, unseen FROM drawn JOIN at_bin USING (lang, sample, bin), (VALUES {", ".join(f"('{m}', {list(v)})" for m, v in MODES.items())}) t(mode, samples) WHERE list_contains(samples, sample)),
sums AS (SELECT lang, mode, seed, sample, sum(n) AS n, sum(n * x) / sum(n) AS mean, sum(n * x * x) / sum(n) AS q2, sum(n * x * x * x) / sum(n) AS q3, min(x) FILTER (WHERE n > 0) AS lo, max(x) FILTER (WHERE n > 0) AS hi FROM counts GROUP BY ALL),
vars AS (SELECT *, q2 - mean * mean AS var, q3 - 3 * mean * q2 + 2 * mean * mean * mean AS third FROM sums),
skews AS (SELECT *, CASE WHEN var > 1e-9 THEN greatest(-0.99, least(0.99, third / pow(var, 1.5))) END AS skew FROM vars),
deltas AS (SELECT *, sign(skew) * sqrt(pi() / 2 * pow(abs(skew), 2 / 3) / (pow(abs(skew), 2 / 3) + pow((4 - pi()) / 2, 2 / 3))) AS delta FROM skews),
whole AS (SELECT lang, mode, seed, min(lo) AS lo, max(hi) AS hi FROM deltas GROUP BY ALL HAVING bool_and(n >= 3 AND coalesce(var, 0) > 1e-9)),
comp AS MATERIALIZED (SELECT lang, mode, seed, row_number() OVER (PARTITION BY lang, mode, seed ORDER BY sample) - 1 AS k, delta / sqrt(1 - delta * delta) AS a, mean - sqrt(var / (1 - 2 * delta * delta / pi())) * delta * sqrt(2 / pi()) AS loc,
  sqrt(var / (1 - 2 * delta * delta / pi())) AS scale FROM deltas SEMI JOIN whole USING (lang, mode, seed)),
drawn_bins AS (SELECT * FROM counts WHERE n > 0),
binlogs AS MATERIALIZED (SELECT * FROM ({_logs("drawn_bins", "lang, mode, seed, sample, bin, n")}) JOIN (SELECT lang, mode, seed, sample, sum(n) AS all_n FROM drawn_bins GROUP BY ALL) USING (lang, mode, seed, sample)),
w0 AS (SELECT DISTINCT lang, mode, seed, sample, k, 1.0 / count(*) OVER (PARTITION BY lang, mode, seed, sample, bin) AS w FROM binlogs),
{", ".join(_round(i + 1) for i in range(ROUNDS))},
weights AS MATERIALIZED (SELECT lang, mode, seed, k, max(w) FILTER (WHERE sample = 0) AS w_p, max(w) FILTER (WHERE sample = 1) AS w_b, max(w) FILTER (WHERE sample = 2) AS w_pop FROM w{ROUNDS} GROUP BY ALL),
pop AS (SELECT lang, mode, seed, bin, x, rows AS n FROM counts WHERE sample = 2), poplogs AS ({_logs("pop", "lang, mode, seed, bin, n")}), popseen AS MATERIALIZED ({_mixed("poplogs", "lang, mode, seed, bin, n")}),
it AS (SELECT lang, mode, seed, list(exp(log_p - greatest(log_p, log_b)) ORDER BY bin) AS f1, list(exp(log_b - greatest(log_p, log_b)) ORDER BY bin) AS f2, list(n ORDER BY bin) AS n, 0.5::DOUBLE AS prior, 1.0::DOUBLE AS diff, 0 AS step FROM popseen WHERE log_p IS NOT NULL AND log_b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, mode, seed, f1, f2, n, new, abs(new - prior), step + 1 FROM (SELECT *, list_sum(list_transform(range(1, len(n) + 1), lambda i: n[i] * prior * f1[i] / (prior * f1[i] + (1 - prior) * f2[i]))) / list_sum(n) AS new FROM it WHERE diff >= 1e-6 AND step < 10000 AND prior > 0 AND prior < 1)),
bounds AS (SELECT lang, mode, seed, CASE WHEN bool_or(log_p IS NOT NULL) THEN min(exp(log_pop - log_p)) ELSE 1 - min(exp(log_pop - log_b)) END AS raw, count(coalesce(log_p, log_b)) AS told FROM popseen WHERE log_p IS NULL OR log_b IS NULL GROUP BY lang, mode, seed),
priors AS MATERIALIZED (SELECT lang, mode, seed, CASE WHEN last > 0.001 AND last < 0.999 THEN last END AS prior FROM (SELECT lang, mode, seed, arg_max(prior, step) AS last FROM it GROUP BY ALL)
  UNION ALL SELECT lang, mode, seed, CASE WHEN told = 0 THEN {mixtures.NO_SIGNAL} WHEN raw >= {mixtures.MOST} OR raw < 0 THEN NULL ELSE greatest(raw, {mixtures.LEAST}) END FROM bounds),
told AS (SELECT lang, mode, round(coalesce(CASE WHEN median > 0 AND median < 1 THEN median END, {op.FALLBACK}), 4) AS prior, round(kept, 6) AS kept, median IS NULL OR median <= 0 OR median >= 1 OR kept < {op.LEAST_KEPT} AS unstable
  FROM (SELECT lang, mode, quantile_cont(prior, 0.5) AS median, avg((prior IS NOT NULL)::INT) AS kept FROM priors GROUP BY ALL))"""
_LEFT = "CASE WHEN {other} IS NOT NULL THEN log_pop + ln(greatest((1 - ({share}) * exp({other} - log_pop)) / (1 - ({share})), 1e-10)) END"
_SIDES = f"""CASE WHEN prior > 0 AND prior < 1 THEN coalesce(log_p, {_LEFT.format(share="1 - prior", other="log_b")}) END AS f_p, CASE WHEN prior > 0 AND prior < 1 THEN coalesce(log_b, {_LEFT.format(share="prior", other="log_p")}) END AS f_b"""


def _at(places: str, key: str) -> str:
    """Densities of the fits at places (lang, mode, key, x), and from them f_p and f_b, as the table at."""
    keys = f"lang, mode, seed, {key}"
    return f"""inside AS (SELECT lang, mode, seed, {key}, x FROM ({places}) JOIN whole USING (lang, mode) WHERE x BETWEEN lo AND hi), outside AS (SELECT lang, mode, seed, {key} FROM ({places}) JOIN whole USING (lang, mode) WHERE x NOT BETWEEN lo AND hi),
inlogs AS ({_logs("inside", keys)}), seen AS ({_mixed("inlogs", keys)} UNION ALL SELECT {keys}, NULL, NULL, NULL FROM outside),
at_fit AS (SELECT seen.*, prior, {_SIDES} FROM seen LEFT JOIN priors USING (lang, mode, seed))"""


_GRID = f"SELECT lang, mode, grid, round(lo + (grid + 0.5) / {PLACES} * (hi - lo), 9) AS x FROM e, range({PLACES}) g(grid), (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in MODES)}) t(mode)"
_STEP = f"(ln(0.99 * (1 - prior) / (prior * 0.01)) / {ranges.TIERS})"
_POINTS = "coalesce(CASE WHEN {l} >= {step} THEN least({tiers}, floor({l} / {step} + 1e-9)) END, 0)::BIGINT"
_UP = lambda l: _POINTS.format(l=l, step=_STEP, tiers=ranges.TIERS)  # noqa: E731, E741


def _runs(side: str) -> str:
    return f"""SELECT lang, mode, grid::DOUBLE AS lo, hi::DOUBLE AS hi, {side} AS points FROM (SELECT *, coalesce(lead(grid) OVER w, last) AS hi FROM (
  SELECT *, lag({side}) OVER w AS before, row_number() OVER w AS i, max(grid) OVER (PARTITION BY lang, mode) AS last FROM graded WINDOW w AS (PARTITION BY lang, mode ORDER BY grid)) WHERE i = 1 OR {side} IS DISTINCT FROM before WINDOW w AS (PARTITION BY lang, mode ORDER BY grid)) WHERE {side} <> 0"""


_CHECKS = f"""gridded AS ({{grid}}), placed AS (SELECT lang, mode, seed, grid, x FROM gridded JOIN whole USING (lang, mode)), gridlogs AS MATERIALIZED ({_logs("placed", "lang, mode, seed, grid")}),
by_loc AS (SELECT lang, mode, seed, k, row_number() OVER (PARTITION BY lang, mode, seed ORDER BY loc) AS i FROM comp), ordered AS (SELECT * FROM gridlogs JOIN by_loc USING (lang, mode, seed, k)),
pairs AS (SELECT a.lang, a.mode, a.seed, a.i, a.grid, a.l - b.l AS r FROM ordered a JOIN ordered b ON a.lang = b.lang AND a.mode = b.mode AND a.seed = b.seed AND a.grid = b.grid AND b.i = a.i + 1 WHERE a.l > {mixtures.MASS} AND b.l > {mixtures.MASS}),
falls AS (SELECT lang, mode, seed, coalesce(NOT bool_or(step > {mixtures.SLACK}), true) AS ratios_fall FROM (SELECT *, r - lag(r) OVER (PARTITION BY lang, mode, seed, i ORDER BY grid) AS step FROM pairs) GROUP BY lang, mode, seed),
mixed AS ({_mixed("gridlogs", "lang, mode, seed, grid")}),
lr AS (SELECT lang, mode, seed, NOT bool_or(step > {mixtures.SLACK}) AS lr_falls, NOT bool_or(-step > {mixtures.SLACK}) AS lr_rises FROM (SELECT *, log_p - log_b - lag(log_p - log_b) OVER (PARTITION BY lang, mode, seed ORDER BY grid) AS step FROM mixed) GROUP BY lang, mode, seed)
SELECT lang, mode, seed, coalesce(ratios_fall, true) AS ratios_fall, lr_falls, lr_rises FROM whole LEFT JOIN falls USING (lang, mode, seed) LEFT JOIN lr USING (lang, mode, seed)"""
_CURVES = "curves AS (SELECT lang, mode, grid, count(f_p - f_b) AS fits, round(quantile_cont(f_p - f_b, 0.05), 2) + 0 AS p5, round(quantile_cont(f_p - f_b, 0.5), 2) + 0 AS p50, round(quantile_cont(f_p - f_b, 0.95), 2) + 0 AS p95 FROM at_fit GROUP BY ALL)"
_GAINS = """gains AS (SELECT lang, seed, round(pn - pu, 6) AS gain FROM (SELECT lang, seed, max(ll) FILTER (WHERE mode = 'pn') AS pn, max(ll) FILTER (WHERE mode = 'pu') AS pu FROM (
  SELECT lang, mode, seed, sum(log_pop * unseen) / sum(unseen) AS ll FROM popseen JOIN (SELECT lang, mode, seed, bin, unseen FROM counts WHERE sample = 2 AND unseen > 0) USING (lang, mode, seed, bin) GROUP BY ALL) GROUP BY ALL) WHERE pn IS NOT NULL AND pu IS NOT NULL)"""
SQL = {
    "model_gains": f"{_FIT_SQL}, {_GAINS} SELECT lang, seed, gain + 0 AS gain FROM gains",
    "paired_choice": f"""{_FIT_SQL}, {_GAINS}, tied AS (SELECT lang, abs(gain) AS a, count(*) AS t, count(*) FILTER (WHERE gain > 0) AS up FROM gains WHERE gain <> 0 GROUP BY ALL),
ranked AS (SELECT *, sum(t) OVER (PARTITION BY lang ORDER BY a) - (t - 1) / 2 AS r FROM tied),
sums_of AS (SELECT lang, sum(t)::BIGINT AS n, sum(r * up)::DOUBLE AS w, sum(t * t * t - t) AS ties FROM ranked GROUP BY lang),
chances AS (SELECT lang, n, w, ties, count(*) FILTER (WHERE list_sum(list_transform(range(n), lambda i: CASE WHEN s & (1 << i::INT) > 0 THEN i + 1 ELSE 0 END)) >= w) / count(*) AS exact,
  (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM sums_of, range({2**SEEDS}) r(s) WHERE s < (1 << n) GROUP BY lang, n, w, ties),
ps AS (SELECT lang, n, w, CASE WHEN ties = 0 THEN exact ELSE exp({log_cdf_sql("(-z)")}) END AS p FROM chances)
SELECT l.lang, coalesce(n, 0) AS n, round(coalesce(w, 0), 3) AS w, round(coalesce(p, 1), 6) AS p, coalesce(p, 1) < 0.05 AS larger, low > 0 AS larger_cautious FROM (SELECT lang, quantile_cont(gain, 0.05) AS low FROM gains GROUP BY 1) l LEFT JOIN ps USING (lang)""",
    "calibration_file": f"""{_FIT_SQL}, {_at(_GRID, 'grid')}, {_CURVES}, graded AS (SELECT lang, mode, grid, {_UP('p5')} AS up, -{_UP('(-p95)')} AS down FROM curves JOIN told USING (lang, mode)), pr AS ({_runs('up')} UNION ALL {_runs('down')}),
tiers AS (SELECT lang, mode, points, count(*) AS n, arg_min(lo, lo) AS lo, arg_max(hi, lo) AS hi FROM pr GROUP BY ALL)
SELECT lang, mode, prior, unstable, points, n, lo, hi FROM told LEFT JOIN tiers USING (lang, mode)""",
    "ratio_checks": f"{_FIT_SQL}, {_CHECKS.format(grid=_GRID)}",
    "moment_fits": f"{_FIT_SQL} SELECT lang, mode, seed, k, round(a, 5) + 0 AS a, round(loc, 5) + 0 AS loc, round(scale, 5) + 0 AS scale, round(w_p, 5) + 0 AS w_p, round(w_b, 5) + 0 AS w_b, round(w_pop, 5) + 0 AS w_pop FROM comp JOIN weights USING (lang, mode, seed, k)",
    "fit_densities": f"{_FIT_SQL}, {_at(_GRID, 'grid')} SELECT lang, mode, seed, grid, round(f_p, 3) + 0 AS log_p, round(f_b, 3) + 0 AS log_b, round(log_pop, 3) + 0 AS log_pop FROM at_fit",
    "fit_priors": f"{_FIT_SQL} SELECT lang, mode, seed, round(prior, 4) AS prior FROM priors",
    "fitted_priors": f"{_FIT_SQL} SELECT lang, mode, prior, kept, unstable FROM told",
    "fit_lr_curves": f"{_FIT_SQL}, {_at(_GRID, 'grid')}, {_CURVES} SELECT lang, mode, grid, fits, p5, p50, p95 FROM curves",
    "fit_point_ranges": f"{_FIT_SQL}, {_at(_GRID, 'grid')}, {_CURVES}, graded AS (SELECT lang, mode, grid, {_UP('p5')} AS up, -{_UP('(-p95)')} AS down FROM curves JOIN told USING (lang, mode)) {_runs('up')} UNION ALL {_runs('down')}",
    "fit_evidence": f"""{_FIT_SQL}, {_at("SELECT DISTINCT lang, 'pn' AS mode, score AS x, score FROM r WHERE lang IS NOT NULL", "score")},
found AS (SELECT lang, score, count(f_p - f_b) AS fits, round(quantile_cont(f_p - f_b, 0.05), 2) + 0 AS l5, round(quantile_cont(f_p - f_b, 0.95), 2) + 0 AS l95 FROM at_fit GROUP BY ALL)
SELECT doc_id, fits, l5, l95, CASE WHEN {_UP("l5")} > 0 THEN {_UP("l5")} ELSE -{_UP("(-l95)")} END AS points FROM r JOIN found USING (lang, score) JOIN (SELECT lang, prior FROM told WHERE mode = 'pn') USING (lang)""",
}
