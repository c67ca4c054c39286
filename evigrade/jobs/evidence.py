"""Queries on rules, curves, out-of-bag evidence and the choice among fits, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.jobs.calibration import SCORED, _scores
from evigrade.operators import evidence as op
from evigrade.operators.bootstrap import draws_sql
from evigrade.sources.staging import table

SEEDS = 20
#: Strengths of a line of evidence by l_linenumber, for lines that speak for (l_returnflag R) and against (A).
FOR, AGAINST = {"pvs": 1, "ps": 2, "pm": 3, "pp": 4}, {"ba": 7, "bs": 6, "bm": 5, "bp": 2}


def combining_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each supplier's part lines, taken as lines of evidence."""
    items = table(spark, sf, "lineitem").where("l_returnflag IN ('R', 'A')")
    cells = {n: F.count_if((F.col("l_returnflag") == flag) & (F.col("l_linenumber") == k)) for flag, names in (("R", FOR), ("A", AGAINST)) for n, k in names.items()}
    counts = items.groupBy("l_partkey").agg(*[c.alias(n) for n, c in cells.items()])
    return counts.withColumn("class", op.combined_class({n: F.col(n) for n in cells}))


def rule_constants(spark: SparkSession, sf: str) -> DataFrame:
    """The constant of the tiers for each dataset's share of P rows."""
    prior = _scores(spark, sf).where("is_plp OR is_blb").groupBy("source").agg(((F.sum(F.col("is_plp").cast("double")) + 1) / (F.count("*") + 2)).alias("prior"))
    return op.best_constants(prior, ["source"], "prior").withColumn("prior", F.round("prior", 6))


def pairwise_combination(spark: SparkSession, sf: str) -> DataFrame:
    """Two assays of a user, a null where one wasn't measured, combined."""
    value = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    wide = table(spark, sf, "events").groupBy("user_id").agg(value("click").alias("x"), value("view").alias("y"))
    points = lambda c: F.when(F.col(c) > 60, 4).when(F.col(c) > 52, 1).when(F.col(c) < 40, -4).when(F.col(c) < 48, -1).when(F.col(c).isNotNull(), 0).cast("long")
    return wide.select("user_id", points("x").alias("a"), points("y").alias("b")).withColumn("points", op.combined_pair(F.col("a"), F.col("b")).cast("long"))


def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Mean discount by quantity, made never to fall, by return flag."""
    curves = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("grid")).agg(F.avg("l_discount").alias("y"), F.count("*").alias("w"))
    return op.isotonic_curves(curves, "l_returnflag", "grid", "y", "w").withColumn("fit", F.round("fit", 6))


def out_of_bag_evidence(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf)
    found = op.out_of_bag_evidence(scores, op.bootstrap_fits(scores, SEEDS))
    return found.select("doc_id", "fits", *[F.round(c, 6).alias(c) for c in ("prior", "p5", "p95")], "points")


def information_criteria(spark: SparkSession, sf: str) -> DataFrame:
    found = op.gaussian_criteria(table(spark, sf, "lineitem"), "l_linestatus", "l_discount", "l_returnflag")
    return found.select("l_linestatus", "n", "k", *[F.round(c, 2).alias(c) for c in ("bic_one", "bic_split", "aic_one", "aic_split")])


def stability_choice(spark: SparkSession, sf: str) -> DataFrame:
    """How often a supplier's weight persists over 0.05, how much it varies, and whether it counts as stable."""
    x = F.col("l_tax")
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg((x > 0.05).cast("double")), 6).alias("persistence"), F.round(F.try_divide(F.stddev_pop(x), F.avg(x)), 6).alias("cv"))
    return rows.withColumn("stable", (F.col("persistence") >= 0.3) & (F.col("cv") < 0.65))


QUERIES = {f.__name__: f for f in (combining_rules, rule_constants, pairwise_combination, isotonic_fit, out_of_bag_evidence, information_criteria, stability_choice)}

_CELLS = ", ".join(f"count(*) FILTER (l_returnflag = '{flag}' AND l_linenumber = {k}) AS {n}" for flag, names in (("R", FOR), ("A", AGAINST)) for n, k in names.items())
_POST = "round(pow(c, {0}) * prior / ((pow(c, {0}) - 1) * prior + 1), 3)"
_BROKEN = " + ".join(f"CASE WHEN {_POST.format(e / 8)} {'<' if e > 0 else '>'} {bound}::DOUBLE THEN {times} ELSE 0 END" for bound, rules in op.RULES.values() for e, times in rules)
_PTS = "CASE WHEN {0} > 60 THEN 4 WHEN {0} > 52 THEN 1 WHEN {0} < 40 THEN -4 WHEN {0} < 48 THEN -1 WHEN {0} IS NOT NULL THEN 0 END::BIGINT"
_LL = "-{0} / 2.0::DOUBLE * (ln({1}) + " + repr(math.log(2 * math.pi)) + " + 1)"
SQL = {
    "combining_rules": f"""WITH n AS (SELECT l_partkey, {_CELLS} FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1)
SELECT *, CASE WHEN pvs >= 1 AND (ps >= 1 OR pm >= 2) THEN 'P' WHEN ps >= 2 THEN 'P' WHEN ps = 1 AND pm >= 2 THEN 'P' WHEN pvs = 1 AND pm >= 1 THEN 'LP' WHEN ps = 1 AND pm = 1 THEN 'LP' WHEN pm >= 3 THEN 'LP'
  WHEN pm = 2 AND pp >= 2 THEN 'LP' WHEN ba >= 1 THEN 'B' WHEN bs >= 2 THEN 'B' WHEN bs = 1 AND bp >= 1 THEN 'LB' WHEN bm >= 2 THEN 'LB' ELSE 'VUS' END AS class FROM n""",
    "rule_constants": f"""WITH {SCORED}, p AS (SELECT source, (sum(is_plp::INT) + 1)::DOUBLE / (count(*) + 2) AS prior FROM s WHERE is_plp OR is_blb GROUP BY 1),
t AS (SELECT source, prior, k AS c, {_BROKEN.replace("pow(c", "pow(k::DOUBLE")} AS broken FROM p, range(1, {op.LARGEST_CONSTANT + 1}) r(k))
SELECT source, round(prior, 6) AS prior, c, broken::BIGINT AS broken FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY broken, c) = 1""",
    "pairwise_combination": f"""WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS x, avg(value) FILTER (event_type = 'view') AS y FROM events GROUP BY 1),
p AS (SELECT user_id, {_PTS.format("x")} AS a, {_PTS.format("y")} AS b FROM w)
SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a * b < 0 THEN 0 WHEN a > 0 OR b > 0 THEN greatest(a, b) ELSE least(a, b) END::BIGINT AS points FROM p""",
    "isotonic_fit": """WITH c AS (SELECT l_returnflag, l_quantity AS grid, avg(l_discount) AS y, count(*) AS w FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, sum(y * w) OVER o AS sy, sum(w) OVER o AS sw FROM c WINDOW o AS (PARTITION BY l_returnflag ORDER BY grid)),
m AS (SELECT i.l_returnflag AS f, i.grid AS lo, j.grid AS hi, (j.sy - i.sy + i.y * i.w) / (j.sw - i.sw + i.w) AS mean FROM p i JOIN p j ON i.l_returnflag = j.l_returnflag AND i.grid <= j.grid),
t AS (SELECT f, k.grid, m.lo, min(mean) AS least FROM m JOIN c k ON f = k.l_returnflag AND k.grid BETWEEN m.lo AND m.hi GROUP BY 1, 2, 3)
SELECT f AS l_returnflag, grid, round(max(least), 6) AS fit FROM t GROUP BY 1, 2""",
    "out_of_bag_evidence": f"""WITH {SCORED}, e AS (SELECT s.*, seed, {draws_sql('doc_id', 'seed')} AS d FROM s, range({SEEDS}) r(seed)),
f AS (SELECT seed, sum(d * score) FILTER (is_plp) / nullif(sum(d) FILTER (is_plp), 0) AS m1, sum(d * score) FILTER (NOT is_plp) / nullif(sum(d) FILTER (NOT is_plp), 0) AS m0, sum(d * score * score) / sum(d) - pow(sum(d * score) / sum(d), 2) AS v, sum(d) FILTER (is_plp)::DOUBLE / sum(d) AS prior FROM e WHERE is_plp OR is_blb GROUP BY 1),
l AS (SELECT doc_id, prior, (m1 - m0) * (score - (m1 + m0) / 2) / v AS lr FROM e JOIN f USING (seed) WHERE d = 0 AND m1 IS NOT NULL AND m0 IS NOT NULL AND v > 0),
q AS (SELECT doc_id, count(*) AS fits, median(prior) AS prior, quantile_cont(lr, 0.05) AS p5, quantile_cont(lr, 0.95) AS p95 FROM l GROUP BY 1),
u AS (SELECT *, ln(0.99 * (1 - prior) / (prior * 0.01)) / 8 AS step FROM q)
SELECT doc_id, fits, round(prior, 6) AS prior, round(p5, 6) AS p5, round(p95, 6) AS p95, CASE WHEN p5 > 0 THEN least(8, floor(p5 / step)) WHEN p95 < 0 THEN -least(8, floor(-p95 / step)) ELSE 0 END::BIGINT AS points FROM u""",
    "information_criteria": f"""WITH g AS (SELECT l_linestatus, l_returnflag, count(l_discount) AS n, var_pop(l_discount) AS v FROM lineitem GROUP BY 1, 2),
o AS (SELECT l_linestatus, var_pop(l_discount) AS v FROM lineitem JOIN g USING (l_linestatus, l_returnflag) WHERE g.v > 0 GROUP BY 1),
b AS (SELECT l_linestatus, sum(n)::BIGINT AS n, count(*) AS k, sum({_LL.format("n", "v")}) AS split FROM g WHERE v > 0 GROUP BY 1),
t AS (SELECT b.*, {_LL.format("n", "o.v")} AS one FROM b JOIN o USING (l_linestatus))
SELECT l_linestatus, n, k, round(2 * ln(n) - 2 * one, 2) AS bic_one, round((3 * k - 1) * ln(n) - 2 * split, 2) AS bic_split, round(4 - 2 * one, 2) AS aic_one, round(2 * (3 * k - 1) - 2 * split, 2) AS aic_split FROM t""",
    "stability_choice": """WITH w AS (SELECT l_suppkey, round(avg((l_tax > 0.05)::INT), 6) AS persistence, round(stddev_pop(l_tax) / nullif(avg(l_tax), 0), 6) AS cv FROM lineitem GROUP BY 1)
SELECT *, persistence >= 0.3 AND cv < 0.65 AS stable FROM w""",
}
