"""Calibration queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrade.functions import thresholds as th
from evigrade.operators import calibration as op
from evigrade.operators.bootstrap import draws, draws_sql
from evigrade.sources.staging import table

#: Point ranges on ln(n_chars), closed; where two share a boundary the first counts.
RANGES = [(9.0, 99.0, 4), (8.0, 9.0, 2), (7.0, 8.0, 1), (5.0, 6.0, -1), (4.0, 5.0, -2), (-9.0, 4.0, -4)]
FIRST = "CASE " + " ".join(f"WHEN score BETWEEN {lo} AND {hi} THEN {p}" for lo, hi, p in RANGES) + " ELSE 0 END"
LAST = "CASE " + " ".join(f"WHEN score BETWEEN {lo} AND {hi} THEN {p}" for lo, hi, p in reversed(RANGES)) + " ELSE 0 END"
SCORED = """s AS (SELECT d.doc_id, d.lang, d.source, ln(d.n_chars) AS score, coalesce(l.quality = 1, false) AS is_plp, coalesce(l.quality = 0, false) AS is_blb,
  true AS is_pop, coalesce(l.toxic = 1, false) AS is_reg FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE d.n_chars > 0)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(labels, "doc_id", "left")
    return op.scoreset(rows, F.ln(F.col("n_chars").cast("double")), F.col("quality") == 1, F.col("quality") == 0, F.col("toxic") == 1, ["doc_id", "lang", "source"])


def scoreset(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).withColumn("score", F.round("score", 6))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    return _scores(spark, sf).select("doc_id", th.first_range(s, RANGES).cast("long").alias("first_points"), th.last_range(s, RANGES).cast("long").alias("last_points"), th.band(th.first_range(s, RANGES)).cast("long").alias("band"))


def _called(spark: SparkSession, sf: str) -> DataFrame:
    truth = F.when(F.col("is_plp"), "P").when(F.col("is_blb"), "B")
    return _scores(spark, sf).select("doc_id", "lang", "source", "is_plp", "is_blb", "is_reg", truth.alias("truth"), th.first_range(F.col("score"), RANGES).alias("points"))


def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return op.metrics(op.confusion(_called(spark, sf), ["source"], F.col("truth"), F.col("points")))


def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics by source, uncertain calls left out and taken in, with infinite ratios."""
    return op.full_metrics(op.confusion(_called(spark, sf), ["source"], F.col("truth"), F.col("points")))


def author_confusion(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag").count()
    return items.groupBy("l_linestatus").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("count")).otherwise(0)).cast("long").alias(n) for f, n in (("R", "abnormal"), ("A", "indeterminate"), ("N", "normal"))])


def vus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _called(spark, sf).where("truth IS NULL").groupBy("lang", "source").agg(F.count_if(F.col("points") != 0).alias("determinate"), F.count("*").alias("total"))


def evidence_distribution(spark: SparkSession, sf: str) -> DataFrame:
    category = F.explode(F.filter(F.array(F.when(F.col("is_plp"), "P"), F.when(F.col("is_blb"), "B"), F.when(F.col("is_reg"), "R"), F.lit("all")), lambda x: x.isNotNull()))
    counts = _called(spark, sf).select(category.alias("category"), th.band(F.col("points")).cast("long").alias("band")).groupBy("category", "band").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("category")), 6))


def source_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of the tiers, and class boundaries, at each dataset's share of P rows."""
    prior = _scores(spark, sf).where("is_plp OR is_blb").groupBy("source").agg(((F.sum(F.col("is_plp").cast("double")) + 1) / (F.count("*") + 2)).alias("prior"))
    p = F.col("prior")
    wide = prior.withColumn("t", F.explode(th.tier_thresholds(th.lr_for_posterior(F.lit(0.99), p)))).select("source", "prior", "t.*")
    return wide.select("source", F.col("points").cast("long").alias("points"), F.round("prior", 6).alias("prior"), F.round("lr_p", 6).alias("lr_p"), F.round("lr_b", 6).alias("lr_b"), F.round(th.posterior_from_lr(F.col("lr_p"), p), 6).alias("posterior"))


def piecewise_evidence(spark: SparkSession, sf: str) -> DataFrame:
    prior = F.lit(0.1)
    log_lr = th.piecewise_log_lr(F.col("points").cast("double"), prior)
    rows = _called(spark, sf).select("doc_id", "points", log_lr.alias("log_lr"))
    post = th.posterior_from_lr(F.exp("log_lr"), prior)
    return rows.select("doc_id", F.round("log_lr", 6).alias("log_lr"), F.round(post, 6).alias("posterior"), th.continuous_class(F.round(post, 6)).alias("class"))


def replicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("high", F.col("value") > 50)
    return op.replicate_mean(rows, ["user_id", "event_type"], "value", ["high"]).withColumn("score", F.round("score", 6))


def assay_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Assays aligned by variant: a column an assay, null where it wasn't measured; variants with two assays at least."""
    rows = table(spark, sf, "events")
    kinds = ["click", "view", "purchase"]
    wide = rows.where(F.col("event_type").isin(kinds)).groupBy("user_id").agg(*[F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 6).alias(k) for k in kinds])
    measured = sum((F.col(k).isNotNull().cast("long") for k in kinds), F.lit(0).cast("long"))
    return wide.withColumn("dims", measured).where("dims >= 2")


def merged_assays(spark: SparkSession, sf: str) -> DataFrame:
    """Points from l_discount by part over suppliers."""
    d = F.col("l_discount")
    points = F.when(d >= 0.08, 4).when(d >= 0.06, 1).when(d <= 0.01, -4).when(d <= 0.03, -1).otherwise(0).cast("long")
    label = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", points.alias("points"), label.alias("label"))
    return op.merge_assays(rows, ["l_partkey"], "points", "label", "l_suppkey")


def curve_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of equal points along each customer's orders by key."""
    price = F.col("o_totalprice")
    points = F.when(price > 250000, 2).when(price > 150000, 1).when(price < 50000, -1).otherwise(0).cast("long")
    return op.runs(table(spark, sf, "orders").select("o_custkey", "o_orderkey", points.alias("points")), ["o_custkey"], "o_orderkey", "points")


def curve_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """5th, 50th and 95th percentile at each grid place over the ensemble."""
    q = F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("grid")).agg(q.alias("q"))
    return rows.select("grid", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


def best_restarts(spark: SparkSession, sf: str) -> DataFrame:
    return op.best_restart(table(spark, sf, "events"), ["user_id", "event_type"], "value", "event_id")


def empirical_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted fractions of each dataset's scores; by distinct score, so that no window holds the rows of a dataset."""
    n = table(spark, sf, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("n_chars")
    return n.select("source", "n_chars", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("source")), 6).alias("cdf"))


def flag_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Null-safe filters: a flagged row goes, a null flag stays, and so does a missing splice score."""
    rows = table(spark, sf, "lineitem").withColumns({"flag": F.nullif("l_returnflag", F.lit("A")), "splice": F.when(F.col("l_tax") > 0.02, F.col("l_tax"))})
    kept = rows.where(~F.col("flag").eqNullSafe("R")).where(F.coalesce(F.col("splice") < 0.06, F.lit(True)))
    return kept.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count("flag").alias("flagged"), F.count("splice").alias("scored"))


def quantile_clip(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    q = events.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    kept = events.join(F.broadcast(q), "event_type").where(F.col("value").between(F.col("q")[0], F.col("q")[1]))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def interval_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Interval text to bounds and whether they are closed, and the class of a score by it."""
    text = F.concat(F.when(F.col("p_size") % 2 == 0, "[").otherwise("("), F.col("p_size").cast("string"), F.lit(", "), F.when(F.col("p_size") > 40, "Inf").otherwise((F.col("p_size") + 5).cast("string")), F.when(F.col("p_size") % 3 == 0, "]").otherwise(")"))
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).cast("double").alias("score"), text.alias("text"))
    pattern = r"^([\[(])\s*([^,]+),\s*([^\])]+)([\])])$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    bound = lambda i: F.when(part(i) == "Inf", F.lit(float("inf"))).otherwise(F.try_to_number(part(i), F.lit("999")).cast("double"))
    rows = rows.select("p_partkey", "score", bound(2).alias("lo"), bound(3).alias("hi"), (part(1) == "[").alias("lo_closed"), (part(4) == "]").alias("hi_closed"))
    inside = ((F.col("score") > F.col("lo")) | (F.col("lo_closed") & (F.col("score") == F.col("lo")))) & ((F.col("score") < F.col("hi")) | (F.col("hi_closed") & (F.col("score") == F.col("hi"))))
    return rows.select("p_partkey", "lo", F.when(F.col("hi") < float("inf"), F.col("hi")).alias("finite_hi"), "lo_closed", "hi_closed", inside.alias("inside"))


def out_of_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that no draw of a seeded bootstrap took, by seed."""
    times = F.array(*draws(F.col("doc_id"), 3))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(times).alias("seed", "n"))
    return rows.where("n = 0").select("doc_id", F.col("seed").cast("long").alias("seed"))


def strata_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and a weighted mean by region over chained metadata joins."""
    items = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("w"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("wx"), F.count("*").alias("n"))
    named = items.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name").agg(F.sum("n").alias("n"), F.countDistinct("s_suppkey").alias("suppliers"), F.round(F.sum("wx") / F.sum("w"), 6).alias("weighted_mean"))


QUERIES = {f.__name__: f for f in (scoreset, point_lookup, confusion_metrics, classification_metrics, author_confusion, vus_coverage, evidence_distribution, source_priors, piecewise_evidence, replicates, assay_matrix, merged_assays, curve_runs, curve_percentiles, best_restarts, empirical_cdf, flag_filter, quantile_clip, interval_parse, out_of_bag, strata_summary)}

CALLED = f"WITH {SCORED}, c AS (SELECT *, CASE WHEN is_plp THEN 'P' WHEN is_blb THEN 'B' END AS truth, {FIRST} AS points FROM s)"
BAND = "sign(points)::BIGINT * CASE WHEN abs(points) >= 8 THEN 8 WHEN abs(points) >= 4 THEN 4 WHEN abs(points) >= 2 THEN 2 ELSE abs(points) END"
_LOGS = [f"ln({q} * 0.9 / (0.1 * {1 - q}))" for _, q in th.KNOTS]
_SEG = [f"{_LOGS[i]} + (points - ({th.KNOTS[i][0]})) * ({_LOGS[i + 1]} - {_LOGS[i]}) / ({th.KNOTS[i + 1][0] - th.KNOTS[i][0]})" for i in range(3)]
_SHARE = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({a}) + ({b}), 0), 0)"
_ODDS = lambda tp, fn, fp, tn: f"CASE WHEN ({fp}) > 0 AND ({fn}) > 0 THEN round((({tp}) * ({tn}))::DOUBLE / (({fp}) * ({fn})), 6) ELSE 'inf'::DOUBLE END"
_PLUS = lambda tp, fn, fp, tn: f"CASE WHEN {_SHARE(tn, fp)} < 1 THEN round({_SHARE(tp, fn)} / (1 - {_SHARE(tn, fp)}), 6) ELSE 'inf'::DOUBLE END"
_MINUS = lambda tp, fn, fp, tn: f"CASE WHEN {_SHARE(tn, fp)} > 0 THEN round((1 - {_SHARE(tp, fn)}) / {_SHARE(tn, fp)}, 6) ELSE 'inf'::DOUBLE END"
_CELLS, _FIRST, _SECOND = ("tp", "fn", "fp", "tn"), ("tp", "fn + p_vus", "fp", "tn + b_vus"), ("tn", "fp + b_vus", "fn", "tp + p_vus")
_SURE = {"accuracy": f"round({_SHARE('tp + tn', 'fp + fn')}, 6)", "sensitivity": f"round({_SHARE('tp', 'fn')}, 6)", "specificity": f"round({_SHARE('tn', 'fp')}, 6)",
    "mcc": "round(coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0", "dor_standard": _ODDS(*_CELLS), "lr_plus_standard": _PLUS(*_CELLS), "lr_minus_standard": _MINUS(*_CELLS)}
_ALL = {"coverage": f"round({_SHARE('called', 'p_vus + b_vus')}, 6)", "lr_plus_pathogenic": _PLUS(*_FIRST), "lr_plus_benign": _PLUS(*_SECOND), "dor_pathogenic": _ODDS(*_FIRST), "dor_benign": _ODDS(*_SECOND)}
SQL = {
    "scoreset": f"WITH {SCORED} SELECT * REPLACE (round(score, 6) AS score) FROM s",
    "point_lookup": f"WITH {SCORED} SELECT doc_id, ({FIRST})::BIGINT AS first_points, ({LAST})::BIGINT AS last_points, ({BAND.replace('points', '(' + FIRST + ')')})::BIGINT AS band FROM s",
    "classification_metrics": CALLED + f""", m AS (SELECT source, count(*) FILTER (truth = 'P' AND points > 0) AS tp, count(*) FILTER (truth = 'P' AND points = 0) AS p_vus, count(*) FILTER (truth = 'P' AND points < 0) AS fn,
  count(*) FILTER (truth = 'B' AND points > 0) AS fp, count(*) FILTER (truth = 'B' AND points = 0) AS b_vus, count(*) FILTER (truth = 'B' AND points < 0) AS tn FROM c GROUP BY source), n AS (SELECT *, tp + fn + fp + tn AS called FROM m)
SELECT source, tp, p_vus, fn, fp, b_vus, tn, {", ".join(f"CASE WHEN called > 0 THEN {e} ELSE 0 END AS {n}" for n, e in _SURE.items())}, {", ".join(f"{e} AS {n}" for n, e in _ALL.items())} FROM n""",
    "confusion_metrics": CALLED + """, m AS (SELECT source, count(*) FILTER (truth = 'P' AND points > 0) AS tp, count(*) FILTER (truth = 'P' AND points = 0) AS p_vus, count(*) FILTER (truth = 'P' AND points < 0) AS fn,
  count(*) FILTER (truth = 'B' AND points > 0) AS fp, count(*) FILTER (truth = 'B' AND points = 0) AS b_vus, count(*) FILTER (truth = 'B' AND points < 0) AS tn FROM c GROUP BY source),
h AS (SELECT *, CASE WHEN fp = 0 OR fn = 0 THEN 0.5 ELSE 0 END::DOUBLE AS h, (tp + fn + fp + tn)::DOUBLE AS called FROM m)
SELECT source, tp, p_vus, fn, fp, b_vus, tn, round(called / nullif(called + p_vus + b_vus, 0), 6) AS coverage, round((tp + tn) / nullif(called, 0), 6) AS accuracy,
  round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS sensitivity, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity,
  round((tp * tn - fp * fn)::DOUBLE / nullif(sqrt(((tp + fp) * (tp + fn))::DOUBLE * ((tn + fp) * (tn + fn))::DOUBLE), 0), 6) AS mcc, round((tp + h) * (tn + h) / nullif((fp + h) * (fn + h), 0), 6) AS dor FROM h""",
    "author_confusion": "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS abnormal, count(*) FILTER (l_returnflag = 'A') AS indeterminate, count(*) FILTER (l_returnflag = 'N') AS normal FROM lineitem GROUP BY 1",
    "vus_coverage": CALLED + " SELECT lang, source, count(*) FILTER (points <> 0) AS determinate, count(*) AS total FROM c WHERE truth IS NULL GROUP BY 1, 2",
    "evidence_distribution": CALLED + f""", e AS (SELECT unnest(list_filter([CASE WHEN is_plp THEN 'P' END, CASE WHEN is_blb THEN 'B' END, CASE WHEN is_reg THEN 'R' END, 'all'], lambda x: x IS NOT NULL)) AS category, ({BAND})::BIGINT AS band FROM c)
SELECT category, band, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS pct FROM e GROUP BY 1, 2""",
    "source_priors": f"""WITH {SCORED}, p AS (SELECT source, (sum(is_plp::INT) + 1)::DOUBLE / (count(*) + 2) AS prior FROM s WHERE is_plp OR is_blb GROUP BY 1),
t AS (SELECT source, prior, k AS points, pow(0.99 * (1 - prior) / (prior * 0.01), k / 8.0::DOUBLE) AS lr FROM p, range(1, 9) r(k))
SELECT source, points, round(prior, 6) AS prior, round(lr, 6) AS lr_p, round(1 / lr, 6) AS lr_b, round(lr * prior / ((lr - 1) * prior + 1), 6) AS posterior FROM t""",
    "piecewise_evidence": CALLED + f""", l AS (SELECT doc_id, CASE WHEN points < -1 THEN {_SEG[0]} WHEN points < 6 THEN {_SEG[1]} ELSE {_SEG[2]} END AS log_lr FROM c),
q AS (SELECT *, round(exp(log_lr) * 0.1 / ((exp(log_lr) - 1) * 0.1 + 1), 6) AS posterior FROM l)
SELECT doc_id, round(log_lr, 6) AS log_lr, posterior, CASE WHEN posterior >= 0.99 THEN 'P' WHEN posterior >= 0.9 THEN 'LP' WHEN posterior <= 0.01 THEN 'B' WHEN posterior <= 0.1 THEN 'LB' ELSE 'VUS' END AS class FROM q""",
    "replicates": "SELECT user_id, event_type, round(avg(value), 6) AS score, count(value) AS n, bool_or(value > 50) AS high FROM events GROUP BY 1, 2",
    "assay_matrix": """WITH w AS (SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1)
SELECT *, ((click IS NOT NULL)::INT + (view IS NOT NULL)::INT + (purchase IS NOT NULL)::INT)::BIGINT AS dims FROM w WHERE (click IS NOT NULL)::INT + (view IS NOT NULL)::INT + (purchase IS NOT NULL)::INT >= 2""",
    "merged_assays": """WITH p AS (SELECT l_partkey, l_suppkey, CASE WHEN l_discount >= 0.08 THEN 4 WHEN l_discount >= 0.06 THEN 1 WHEN l_discount <= 0.01 THEN -4 WHEN l_discount <= 0.03 THEN -1 ELSE 0 END::BIGINT AS points, nullif(l_returnflag, 'A') AS label FROM lineitem),
m AS (SELECT l_partkey, min(points) AS lo, max(points) AS hi, count(DISTINCT label) AS labels, max(label) AS top, count(DISTINCT l_suppkey) AS assays FROM p GROUP BY 1)
SELECT l_partkey, CASE WHEN lo < 0 AND hi > 0 THEN 0 WHEN hi > 0 THEN hi ELSE lo END AS points, CASE WHEN hi <= 0 THEN lo ELSE hi END AS max_points, CASE WHEN labels = 1 THEN top END AS label, assays FROM m""",
    "curve_runs": """WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 250000 THEN 2 WHEN o_totalprice > 150000 THEN 1 WHEN o_totalprice < 50000 THEN -1 ELSE 0 END::BIGINT AS points FROM orders),
b AS (SELECT *, lag(points) OVER w AS before, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last_at FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
s AS (SELECT o_custkey, o_orderkey AS lo, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), last_at) AS hi, points FROM b WHERE before IS NULL OR before <> points)
SELECT * FROM s WHERE points <> 0""",
    "curve_percentiles": "SELECT l_quantity AS grid, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1",
    "best_restarts": "SELECT user_id, event_type, value AS ll, event_id AS fit FROM events WHERE value IS NOT NULL AND NOT isnan(value) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
    "empirical_cdf": "SELECT DISTINCT source, n_chars, round(cume_dist() OVER (PARTITION BY source ORDER BY n_chars), 6) AS cdf FROM documents",
    "flag_filter": """WITH r AS (SELECT l_linestatus, nullif(l_returnflag, 'A') AS flag, CASE WHEN l_tax > 0.02 THEN l_tax END AS splice FROM lineitem)
SELECT l_linestatus, count(*) AS n, count(flag) AS flagged, count(splice) AS scored FROM r WHERE flag IS DISTINCT FROM 'R' AND coalesce(splice < 0.06, true) GROUP BY 1""",
    "quantile_clip": """WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events JOIN q USING (event_type) WHERE value BETWEEN a AND b GROUP BY 1""",
    "interval_parse": """WITH r AS (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS score, p_size::DOUBLE AS lo, CASE WHEN p_size > 40 THEN 'inf'::DOUBLE ELSE p_size + 5 END AS hi, p_size % 2 = 0 AS lc, p_size % 3 = 0 AS hc FROM part)
SELECT p_partkey, lo, CASE WHEN isfinite(hi) THEN hi END AS finite_hi, lc AS lo_closed, hc AS hi_closed, (score > lo OR (lc AND score = lo)) AND (score < hi OR (hc AND score = hi)) AS inside FROM r""",
    "out_of_bag": f"SELECT doc_id, seed FROM documents, range(3) r(seed) WHERE ({draws_sql('doc_id', 'seed')}) = 0",
    "strata_summary": """SELECT r_name, count(*) AS n, count(DISTINCT s_suppkey) AS suppliers, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_mean
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
}
