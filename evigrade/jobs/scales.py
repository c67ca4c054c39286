"""Queries on scales of evidence, each with its SQL: every document has points and the prior of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.functions import scales as sc
from evigrade.functions import thresholds as th
from evigrade.jobs.calibration import SCORED, _scores

#: Stricter benign targets, as a dataset may set them.
STRICT = sc.TARGETS | {"LB": 0.05, "B": 0.005}
GAP = 12


def priors(spark: SparkSession, sf: str) -> DataFrame:
    """source and prior: share of P rows among the labelled ones, with one row of each class added."""
    return _scores(spark, sf).where("is_plp OR is_blb").groupBy("source").agg(((F.sum(F.col("is_plp").cast("double")) + 1) / (F.count("*") + 2)).alias("prior"))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).join(priors(spark, sf), "source").select("doc_id", "source", "prior", (F.col("doc_id") % 37 - 12).cast("double").alias("t"))


def _rounded(columns: dict[str, Column]) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def evidence_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Log likelihood ratio, ratio and posterior of a document's points on each scale."""
    t, p = F.col("t"), F.col("prior")
    logs = {"piecewise": sc.log_lr(t, p), "additive": sc.log_lr(t, p, places=sc.ADDITIVE_PLACES), "custom": sc.log_lr(t, p, STRICT), "neutral": sc.log_lr(t, p, STRICT, neutral=True), "anchored": sc.anchored_log_lr(t, p)}
    rows = _graded(spark, sf).select("doc_id", "prior", *[c.alias(n) for n, c in logs.items()])
    out = {f"{n}_log_lr": F.col(n) for n in logs} | {f"{n}_lr": F.log10(F.exp(n)) for n in logs} | {f"{n}_posterior": th.posterior_from_lr(F.exp(n), p) for n in logs}
    return rows.select("doc_id", *_rounded(out))


def scale_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of the tiers 1 to 8 of each source on the piecewise and the additive scale, for and against."""
    k, p = F.col("points").cast("double"), F.col("prior")
    rows = priors(spark, sf).select("source", "prior", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("points"))
    lr = {"piecewise_p": sc.log_lr(k, p), "piecewise_b": sc.log_lr(-k, p), "additive_p": sc.log_lr(k, p, places=sc.ADDITIVE_PLACES), "additive_b": sc.log_lr(-k, p, places=sc.ADDITIVE_PLACES)}
    return rows.select("source", F.col("points").cast("long").alias("points"), *_rounded({n: F.exp(c) for n, c in lr.items()}))


def continuous_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios at the target posteriors of each source, as given and floored at the prior."""
    p = F.col("prior")
    plain = {f"lr_{n}": th.lr_for_posterior(F.lit(q), p) for n, q in STRICT.items()}
    floor = {f"floor_{n}": th.lr_for_posterior(q, p) for n, q in sc.floored(STRICT, p).items()}
    return priors(spark, sf).select("source", *_rounded(plain | floor))


def continuous_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each document by the posterior of its piecewise evidence, with standard, strict and floored targets."""
    p = F.col("prior")
    rows = _graded(spark, sf).withColumn("post", F.round(th.posterior_from_lr(F.exp(sc.log_lr(F.col("t"), p)), p), 6))
    return rows.select("doc_id", "post", sc.class_of(F.col("post")).alias("standard"), sc.class_of(F.col("post"), STRICT).alias("strict"), sc.class_of(F.col("post"), sc.floored(STRICT, p)).alias("floored"))


def display_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Fractional points of a log ratio on the standard, the custom, the neutral and the floored knots."""
    y, p = F.col("t") / 4, F.col("prior")
    shown = {"standard": sc.display_points(y, p), "custom": sc.display_points(y, p, STRICT), "floored": sc.display_points(y, p, sc.floored(STRICT, p), neutral=True)}
    return _graded(spark, sf).select("doc_id", *_rounded(shown))


def fixed_reference(spark: SparkSession, sf: str) -> DataFrame:
    """One slope for all priors: log ratio, points of the prior, total, posterior and class of a document's points."""
    slope, p, t = sc.fixed_slope(GAP), F.col("prior"), F.col("t")
    total = t + sc.prior_points(p, slope)
    rows = _graded(spark, sf).select("doc_id", sc.clean_gap().cast("long").alias("gap"), *_rounded({"log_lr": slope * t, "prior_points": sc.prior_points(p, slope), "total": total, "posterior": sc.logistic(slope * total)}))
    return rows.withColumn("class", sc.class_of(F.col("posterior")))


def fixed_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """For each source the points of evidence at which its documents change class on the fixed scale."""
    slope, p = sc.fixed_slope(GAP), F.col("prior")
    return priors(spark, sf).select("source", *_rounded({n: sc.log_odds(q) / slope - sc.prior_points(p, slope) for n, q in sc.TARGETS.items()}))


def assigned_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tier that each document's ratio reaches, for and against, at its source's thresholds."""
    ratio = F.exp(F.col("t") / 3)
    c = th.lr_for_posterior(F.lit(0.99), F.col("prior"))
    tiers = lambda name: F.transform(th.tier_thresholds(c), lambda x: x[name])
    rows = _graded(spark, sf)
    return rows.select("doc_id", sc.tier_of(ratio, tiers("lr_p"), True).cast("long").alias("points_p"), (-sc.tier_of(ratio, tiers("lr_b"), False)).cast("long").alias("points_b"))


def reached_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any document of a source reaches each tier, for and against: two extremes a source suffice."""
    ends = _graded(spark, sf).groupBy("source", "prior").agg(F.max("t").alias("top"), F.min("t").alias("low"))
    c = F.explode(th.tier_thresholds(th.lr_for_posterior(F.lit(0.99), F.col("prior"))))
    rows = ends.select("source", "top", "low", c.alias("x"))
    return rows.select("source", F.col("x.points").cast("long").alias("points"), (F.exp(F.col("top") / 3) >= F.col("x.lr_p")).alias("reached_p"), (F.exp(F.col("low") / 3) <= F.col("x.lr_b")).alias("reached_b"))


def weight_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Priors from the weights of two components in a source's samples: shares of long texts among P, B, toxic and all rows."""
    wide = F.col("score") > 7
    share = lambda flag: F.avg(F.when(flag, wide.cast("double")))
    rows = _scores(spark, sf).groupBy("source").agg(share(F.col("is_plp")).alias("p"), share(F.col("is_blb")).alias("b"), share(F.col("is_reg")).alias("s"), share(F.lit(True)).alias("g"))
    pair = lambda c: F.when(F.col(c).isNotNull(), F.array(1 - F.col(c), F.col(c)))
    found = {m: sc.weight_prior(pair("p"), sc.benign_weights(pair("b"), pair("s"), m), pair("g")) for m in ("benign", "synonymous", "avg")}
    return rows.select("source", *_rounded(found | {"proper_avg": sc.proper(found["avg"])}))


def baseline_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline method's constant for each source and its eight thresholds."""
    rows = priors(spark, sf).select("source", sc.baseline_constant(F.col("prior")).cast("long").alias("constant"))
    at = {f"{side}{k}": F.pow(F.col("constant").cast("double"), F.lit((1 if side == "p" else -1) * k / 8)) for side in "bp" for k in (1, 2, 4, 8)}
    return rows.select("source", "constant", *_rounded(at))


QUERIES = {f.__name__: f for f in (evidence_scales, scale_tiers, continuous_targets, continuous_classes, display_scale, fixed_reference, fixed_boundaries, assigned_tiers, reached_tiers, weight_priors, baseline_tiers)}

PRIORS = f"WITH {SCORED}, p AS (SELECT source, (sum(is_plp::INT) + 1)::DOUBLE / (count(*) + 2) AS prior FROM s WHERE is_plp OR is_blb GROUP BY 1)"
GRADED = PRIORS + ", g AS (SELECT doc_id, source, prior, (doc_id % 37 - 12)::DOUBLE AS t, ln(prior / (1 - prior)) AS lpo FROM s JOIN p USING (source))"
_ODDS = {n: f"ln({q} / {1 - q}::DOUBLE)" for n, q in sc.TARGETS.items()}
_STRICT = {n: f"ln({q}::DOUBLE / (1 - {q}::DOUBLE))" for n, q in STRICT.items()}
_CUT = {"B": "<=", "LB": "<=", "P": ">=", "LP": ">="}


def _line(x: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f"coalesce({y0} + ({x} - ({x0})) * (({y1}) - ({y0})) / nullif(({x1}) - ({x0}), 0), {y0})"


def _knots(x: str, pairs: list[tuple[str, str]]) -> str:
    lines = [_line(x, *pairs[i], *pairs[i + 1]) for i in range(len(pairs) - 1)]
    return "CASE " + " ".join(f"WHEN {x} >= {pairs[i][0]} THEN {lines[i]}" for i in range(len(lines) - 1, 0, -1)) + f" ELSE {lines[0]} END"


def _by_place(odds: dict[str, str], places: dict[str, float], neutral: bool = False) -> list[tuple[str, str]]:
    pairs = [(f"{places[n]}::DOUBLE", f"({odds[n]} - lpo)") for n in ("B", "LB", "LP", "P")]
    return [*pairs[:2], ("0::DOUBLE", "0::DOUBLE"), *pairs[2:]] if neutral else pairs


def _class(posterior: str, q: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {posterior} {_CUT[n]} {q[n]} THEN '{n}'" for n in _CUT) + " ELSE 'VUS' END"


_LOGS = {"piecewise": _knots("t", _by_place(_ODDS, sc.PLACES)), "additive": _knots("t", _by_place(_ODDS, sc.ADDITIVE_PLACES)), "custom": _knots("t", _by_place(_STRICT, sc.PLACES)), "neutral": _knots("t", _by_place(_STRICT, sc.PLACES, True)), "anchored": "CASE WHEN t >= 0 THEN (ln(9::DOUBLE) - lpo) / 6 * t ELSE -(ln(9::DOUBLE) + lpo) * t END"}
_POST = "{0} * prior / (({0} - 1) * prior + 1)"
_FLOOR = {n: f"{'least' if n in ('B', 'LB') else 'greatest'}({q}::DOUBLE, prior)" for n, q in STRICT.items()}
_FLOOR_ODDS = {n: f"ln({q} / (1 - {q}))" for n, q in _FLOOR.items()}
_SLOPE = f"(ln(11::DOUBLE) / {GAP})"
_LR = "(0.99 * (1 - prior) / (prior * 0.01))"
_CRITERIA = " + ".join(f"({_POST.format(f'pow(c::DOUBLE, {e / 8})')} >= {q}::DOUBLE)::INT" for eighths, q in ((sc.LIKELY_EIGHTHS, 0.9), (sc.CERTAIN_EIGHTHS, 0.99)) for e in eighths)
SQL = {
    "evidence_scales": GRADED + ", l AS (SELECT doc_id, prior, " + ", ".join(f"{e} AS {n}" for n, e in _LOGS.items()) + " FROM g) SELECT doc_id, " + ", ".join(f"round({n}, 6) + 0::DOUBLE AS {n}_log_lr, round(log10(exp({n})), 6) AS {n}_lr, round({_POST.format(f'exp({n})')}, 6) AS {n}_posterior" for n in _LOGS) + " FROM l",
    "scale_tiers": PRIORS + ", g AS (SELECT source, k AS points, ln(prior / (1 - prior)) AS lpo, k::DOUBLE AS t FROM p, range(1, 9) r(k)), n AS (SELECT source, points, lpo, -t AS t FROM g), a AS (SELECT source, points, "
    + f"round(exp({_LOGS['piecewise']}), 6) AS piecewise_p, round(exp({_LOGS['additive']}), 6) AS additive_p FROM g), b AS (SELECT source, points, round(exp({_LOGS['piecewise']}), 6) AS piecewise_b, round(exp({_LOGS['additive']}), 6) AS additive_b FROM n) SELECT * FROM a JOIN b USING (source, points)",
    "continuous_targets": PRIORS + " SELECT source, " + ", ".join(f"round({q}::DOUBLE * (1 - prior) / (prior * (1 - {q}::DOUBLE)), 6) AS lr_{n}, round({_FLOOR[n]} * (1 - prior) / (prior * (1 - {_FLOOR[n]})), 6) AS floor_{n}" for n, q in STRICT.items()) + " FROM p",
    "continuous_classes": GRADED + f", l AS (SELECT doc_id, prior, {_LOGS['piecewise']} AS l FROM g), q AS (SELECT doc_id, prior, round({_POST.format('exp(l)')}, 6) AS post FROM l) SELECT doc_id, post, {_class('post', {n: f'{q}::DOUBLE' for n, q in sc.TARGETS.items()})} AS standard, {_class('post', {n: f'{q}::DOUBLE' for n, q in STRICT.items()})} AS strict, {_class('post', _FLOOR)} AS floored FROM q",
    "display_scale": GRADED + ", y AS (SELECT *, t / 4 AS y FROM g) SELECT doc_id, " + ", ".join(f"round({_knots('y', [(b, a) for a, b in pairs])}, 6) AS {n}" for n, pairs in (("standard", _by_place(_ODDS, sc.PLACES)), ("custom", _by_place(_STRICT, sc.PLACES)), ("floored", _by_place(_FLOOR_ODDS, sc.PLACES, True)))) + " FROM y",
    "fixed_reference": GRADED + f""", c AS (SELECT ln(9::DOUBLE) / ln(11::DOUBLE) AS c), w AS (SELECT k AS gap FROM c, range(4, 61) r(k) ORDER BY ceil(k * c) - k * c, k LIMIT 1),
f AS (SELECT doc_id, (SELECT gap FROM w) AS gap, round({_SLOPE} * t, 6) AS log_lr, round(lpo / {_SLOPE}, 6) AS prior_points, round(t + lpo / {_SLOPE}, 6) AS total, round(1 / (1 + exp(-({_SLOPE} * t + lpo))), 6) AS posterior FROM g)
SELECT *, {_class('posterior', {n: f'{q}::DOUBLE' for n, q in sc.TARGETS.items()})} AS class FROM f""",
    "fixed_boundaries": PRIORS + " SELECT source, " + ", ".join(f"round(({e} - ln(prior / (1 - prior))) / {_SLOPE}, 6) AS {n}" for n, e in _ODDS.items()) + " FROM p",
    "assigned_tiers": GRADED + f""", l AS (SELECT doc_id, t / 3 AS l, ln({_LR}) / 8 AS step FROM g), k AS (SELECT doc_id, l, step, k FROM l, range(1, 9) r(k))
SELECT doc_id, coalesce(max(k) FILTER (exp(l) >= pow(exp(step * 8), k / 8::DOUBLE)), 0) AS points_p, -coalesce(max(k) FILTER (exp(l) <= pow(exp(step * 8), -k / 8::DOUBLE)), 0) AS points_b FROM k GROUP BY 1""",
    "reached_tiers": GRADED + f""", e AS (SELECT source, {_LR} AS c, max(t) AS top, min(t) AS low FROM g GROUP BY 1, 2)
SELECT source, k AS points, exp(top / 3) >= pow(c, k / 8::DOUBLE) AS reached_p, exp(low / 3) <= pow(c, -k / 8::DOUBLE) AS reached_b FROM e, range(1, 9) r(k)""",
    "weight_priors": f"""WITH {SCORED}, w AS (SELECT source, avg((score > 7)::INT) FILTER (is_plp) AS p, avg((score > 7)::INT) FILTER (is_blb) AS b, avg((score > 7)::INT) FILTER (is_reg) AS s, avg((score > 7)::INT) AS g FROM s GROUP BY 1),
m AS (SELECT source, p, g, coalesce(b, s) AS benign, coalesce(s, b) AS synonymous, coalesce((b + s) / 2, b, s) AS av FROM w),
q AS (SELECT source, (g - benign) / nullif(p - benign, 0) AS benign, (g - synonymous) / nullif(p - synonymous, 0) AS synonymous, (g - av) / nullif(p - av, 0) AS av FROM m)
SELECT source, round(benign, 6) AS benign, round(synonymous, 6) AS synonymous, round(av, 6) AS avg, round(CASE WHEN av > 0 AND av < 1 THEN av END, 6) AS proper_avg FROM q""",
    "baseline_tiers": PRIORS + f""", c AS (SELECT source, prior, c, ({_CRITERIA}) AS met FROM p, range(1, {sc.LARGEST + 1}) r(c)),
m AS (SELECT source, CASE WHEN prior <= {sc.LOW_PRIOR} THEN {sc.LARGEST} WHEN prior > {sc.HIGH_PRIOR} THEN 1 ELSE min(c) FILTER (met = 13) - 1 END::BIGINT AS constant FROM c GROUP BY source, prior)
SELECT source, constant, """ + ", ".join(f"round(pow(constant::DOUBLE, {(1 if side == 'p' else -1) * k / 8}::DOUBLE), 6) AS {side}{k}" for side in "bp" for k in (1, 2, 4, 8)) + " FROM m",
}
