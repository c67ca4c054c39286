"""Queries on calibration under perturbed labels, each with its SQL: labelled documents, two kinds of perturbation, two levels, five seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.jobs.calibration import SCORED, _scores
from evigrade.jobs.evaluation import _CELLS, _metrics
from evigrade.operators import calibration as op
from evigrade.operators import evaluation as ev
from evigrade.operators import robustness as rb
from evigrade.sources.staging import cut

CONDITIONS = [(kind, level, seed) for kind, levels in (("downsample", (20, 50)), ("discordance", (5, 20))) for level in levels for seed in range(5)]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).where("is_plp OR is_blb").select("doc_id", F.round("score", 9).alias("score"), F.when(F.col("is_plp"), "P").otherwise("B").alias("truth"))


def _perturbed(spark: SparkSession, sf: str) -> DataFrame:
    conditions = spark.createDataFrame(CONDITIONS, "kind string, level int, seed int")
    return cut(rb.perturbed(_labelled(spark, sf), conditions, "doc_id"), "perturbed")


def perturbed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """By condition, rows of each class, labels that were swapped, and the sum of the ids that are left."""
    wrong = F.col("label") != F.col("truth")
    return _perturbed(spark, sf).groupBy("kind", "level", "seed").agg(F.count_if(F.col("label") == "P").alias("p"), F.count_if(F.col("label") == "B").alias("b"), F.count_if(wrong).alias("swapped"), F.sum("doc_id").alias("ids"))


def _matrices(spark: SparkSession, sf: str) -> DataFrame:
    found = rb.scored(_labelled(spark, sf), rb.thresholds(_perturbed(spark, sf)))
    strongest = found.groupBy("kind", "level", "seed").agg(F.max("points").alias("top"), F.min("points").alias("low"))
    cells = op.confusion(found, ["kind", "level", "seed"], F.col("truth"), F.col("points"))
    return cut(op.metrics(cells).join(strongest, ["kind", "level", "seed"]), "robustness")


def robustness_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Matrix, metrics and strongest tiers of the unperturbed rows under each condition's ranges."""
    return _matrices(spark, sf)


def robustness_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles over the seeds of a level: coverage, correlation, odds ratio where finite, and cells."""
    q = [0.25, 0.5, 0.75]
    found = _matrices(spark, sf).groupBy("kind", "level").agg(*[ev.finite_percentiles(F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))), q).alias(c) for c in ("coverage", "mcc", "dor", "tp", "tn", "top")])
    return found.select("kind", "level", *[F.when(F.col(c)[i] < float("inf"), F.round(F.col(c)[i], 6)).alias(f"{c}_{n}") for c in ("coverage", "mcc", "dor", "tp", "tn", "top") for i, n in enumerate(("p25", "median", "p75"))])


QUERIES = {f.__name__: f for f in (perturbed_labels, robustness_matrices, robustness_summary)}
_BASE = f"""WITH {SCORED}, x AS (SELECT doc_id, round(score, 9) AS score, CASE WHEN is_plp THEN 'P' ELSE 'B' END AS truth FROM s WHERE is_plp OR is_blb),
k AS (SELECT * FROM (VALUES {", ".join(map(str, CONDITIONS))}) t(kind, level, seed)), n AS (SELECT truth, count(*) AS n FROM x GROUP BY 1),
r AS (SELECT x.*, k.*, row_number() OVER (PARTITION BY kind, level, seed, truth ORDER BY ('0x' || substr(md5(concat(doc_id, ':', kind, '/', level, '/', seed)), 1, 7))::BIGINT, doc_id) AS rank,
  CASE kind WHEN 'discordance' THEN floor(level * n / 100) ELSE level END AS most FROM x JOIN n USING (truth), k),
l AS (SELECT kind, level, seed, doc_id, score, truth, CASE WHEN kind = 'discordance' AND rank <= most THEN CASE truth WHEN 'P' THEN 'B' ELSE 'P' END ELSE truth END AS label FROM r WHERE kind = 'discordance' OR rank <= most)"""
_SCORED = _BASE + """, m AS (SELECT kind, level, seed, avg(score) FILTER (label = 'P') AS p, avg(score) FILTER (label = 'B') AS b FROM l GROUP BY 1, 2, 3), t AS (SELECT kind, level, seed, round((p + b) / 2, 9) AS mid, round((p - b) / 4, 9) AS width FROM m),
y AS (SELECT kind, level, seed, truth = 'P' AS plp, (CASE WHEN (score - mid) / width > 0 THEN least(8, floor((score - mid) / width)) ELSE -least(8, floor(-(score - mid) / width)) END)::BIGINT AS points FROM x, t WHERE mid IS NOT NULL AND width <> 0),
c AS (SELECT kind, level, seed, max(points) AS top, min(points) AS low, """ + _CELLS.format("points") + " FROM y GROUP BY 1, 2, 3)"
_MATRICES = _SCORED + ", " + _metrics("c", "kind, level, seed, top, low")
_Q = ", ".join(f"round(quantile_cont({c}::DOUBLE, {q}), 6) AS {c}_{n}" for c in ("coverage", "mcc", "dor", "tp", "tn", "top") for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))
SQL = {
    "perturbed_labels": _BASE + " SELECT kind, level, seed, count(*) FILTER (label = 'P') AS p, count(*) FILTER (label = 'B') AS b, count(*) FILTER (label <> truth) AS swapped, sum(doc_id)::BIGINT AS ids FROM l GROUP BY 1, 2, 3",
    "robustness_matrices": _MATRICES,
    "robustness_summary": f"SELECT kind, level, {_Q} FROM ({_MATRICES}) GROUP BY 1, 2",
}
