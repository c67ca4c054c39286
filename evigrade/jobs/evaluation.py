"""Queries that hold calls against labels, each with its SQL, over the variants that line items stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrade.functions import labels as lb
from evigrade.functions import names as nm
from evigrade.jobs.labels import _STAR, _STARS, CALLS, V, variants, with_calls
from evigrade.operators import calibration as op
from evigrade.operators import evaluation as ev

PLP, BLB = "Pathogenic/Likely Pathogenic", "Benign/Likely Benign"
#: Points from which a call counts as pathogenic, and up to which as benign, by name.
CUTS = [("direction", 1, -1), ("moderate", 2, -2), ("strong", 4, -4), ("mixed", 2, -1)]


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Variants with their key, their class, the points that count and the author's call."""
    c = F.col
    rows = with_calls(variants(spark, sf))
    vid = nm.variant_id(F.concat(F.lit("V"), c("aa_pos").cast("string")), c("gene"), c("chrom"), c("coding"))
    key = nm.physical_key(vid, c("gene"), c("level"), c("aa_ref"), c("aa_pos"), c("aa_alt"))
    return rows.select("line", "gene", "assay", "dataset", key.alias("key"), "sample", "is_vus", lb.in_sample(c("sample"), PLP).alias("plp"), lb.in_sample(c("sample"), BLB).alias("blb"), F.coalesce("oob_points", "points").alias("eff"), "points", "oob_points", "author", "score", "aa_pos")


def _truth() -> dict:
    return {"blb": F.col("blb"), "plp": F.col("plp")}


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.gene_deduped(_evaluated(spark, sf), ["gene", "key"], "line", "eff", "sample", "author", "is_vus", "assay")
    return found.withColumns({"plp": lb.in_sample(F.col("sample"), PLP), "blb": lb.in_sample(F.col("sample"), BLB)})


def gene_deduped(spark: SparkSession, sf: str) -> DataFrame:
    """One row a physical variant of a gene over all assays that scored it."""
    return _deduped(spark, sf).drop("plp", "blb")


def deduped_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Matrices of merged points and merged calls by gene, for genes with at least one determinate call."""
    ours, theirs = ev.matrix(_truth(), F.col("points")), [c for c in ev.matrix(_truth(), ev.call_sign(F.col("call")), ("author_normal", "author_ir", "author_abnormal"))]
    found = _deduped(spark, sf).groupBy("gene").agg(F.count("call").alias("called"), *ours, *theirs)
    return found.where("called > 0")


def both_determinate(spark: SparkSession, sf: str) -> DataFrame:
    """By dataset, both matrices over the variants on which points and author both decide."""
    rows = _evaluated(spark, sf).where(F.col("eff") != 0).where(lb.determinate(F.col("author")).isNotNull())
    return rows.groupBy("dataset").agg(*ev.matrix(_truth(), F.col("eff")), *ev.matrix(_truth(), ev.call_sign(F.col("author")), ("author_normal", "author_ir", "author_abnormal")))


def author_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """The author's calls of labelled variants by dataset, and of its VUS those that decide; datasets without any determinate call have no row."""
    call = ev.call_sign(F.col("author"))
    found = _evaluated(spark, sf).groupBy("dataset").agg(*ev.matrix(_truth(), call), F.count_if(F.col("is_vus") & (call != 0)).alias("vus_determinate"), F.count_if("is_vus").alias("vus_total"))
    decided = ev.total("blb_normal", "blb_abnormal", "plp_normal", "plp_abnormal") > 0
    return found.where(decided)


def pooled_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of VUS that decide, pooled over datasets, by points and by author."""
    ours = _evaluated(spark, sf).where("is_vus").agg(F.count_if(F.col("eff") != 0).alias("n"), F.count("*").alias("of")).select(F.lit("points").alias("method"), "n", "of")
    theirs = author_matrices(spark, sf).agg(F.sum("vus_determinate").alias("n"), F.sum("vus_total").alias("of")).select(F.lit("author").alias("method"), "n", "of")
    return ours.unionByName(theirs).select("method", F.round(100 * F.try_divide("n", "of"), 6).alias("pct"))


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluated variants joined by identity with the class that a review panel gave, here by the size of the part: 1, -1 or 0."""
    panel = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("aa_pos"), F.when(F.col("p_size") % 3 == 0, 1).when(F.col("p_size") % 3 == 1, -1).otherwise(0).alias("panel")).where("panel <> 0")
    return _evaluated(spark, sf).join(panel, "aa_pos")


def _three_by_two(value, prefix: str) -> list:
    return [F.count_if((value == s) & (F.col("panel") == t)).alias(f"{prefix}_{r}_{c}") for s, r in ((1, "p"), (0, "i"), (-1, "b")) for t, c in ((1, "plp"), (-1, "blb"))]


def panel_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Points and author against the panel's classes by gene, as rows of classes with a column a call."""
    rows = _reviewed(spark, sf).groupBy("gene").agg(*_three_by_two(F.signum("eff").cast("int"), "ours"), *_three_by_two(ev.call_sign(F.col("author")), "author"))
    return ev.transposed(rows, ["gene"], "ours", "ours").join(ev.transposed(rows, ["gene"], "author", "author"), "gene")


def panel_deduped(spark: SparkSession, sf: str) -> DataFrame:
    """The same over physical variants; those with conflicting panel classes go."""
    rows = _reviewed(spark, sf)
    one = rows.groupBy("gene", "key").agg(F.min("panel").alias("panel"), F.max("panel").alias("other")).where("panel = other").drop("other")
    merged = ev.gene_deduped(rows, ["gene", "key"], "line", "eff", "sample", "author", "is_vus", "assay").join(one, ["gene", "key"])
    return merged.groupBy("gene").agg(*_three_by_two(F.signum("points").cast("int"), "ours"), *_three_by_two(ev.call_sign(F.col("call")), "author"))


def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Matrix and metrics for each pair of cuts, of the standard and of the out-of-bag points."""
    cuts = spark.createDataFrame(CUTS, "cut string, at int, below int")
    counts = _evaluated(spark, sf).where("plp OR blb").select("plp", "blb", F.explode(F.array(F.struct(F.lit("standard").alias("method"), F.col("points").alias("x")), F.struct(F.lit("oob").alias("method"), F.col("eff").alias("x")))).alias("m")).groupBy("plp", "m.method", "m.x").agg(F.count("*").alias("n"))
    call = ev.thresholded(F.col("x"), F.col("at"), F.col("below"))
    cell = lambda flag, s: F.coalesce(F.sum(F.when((F.col("plp") == flag) & (call == s), F.col("n"))), F.lit(0))
    cells = {"tp": cell(True, 1), "p_vus": cell(True, 0), "fn": cell(True, -1), "fp": cell(False, 1), "b_vus": cell(False, 0), "tn": cell(False, -1)}
    return op.metrics(counts.crossJoin(F.broadcast(cuts)).groupBy("method", "cut").agg(*[c.alias(n) for n, c in cells.items()]))


def method_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Single-assay points, joint ones and the choice between them by the number of assays, summed over genes."""
    merged = _evaluated(spark, sf).groupBy("gene", "key").agg(F.min("points").alias("lo"), F.max("points").alias("uv"), F.max("oob_points").alias("mv"), F.min("assay").alias("a"), F.max("assay").alias("b"), F.bool_or("plp").alias("plp"), F.bool_or("blb").alias("blb"))
    many, mv, uv = F.col("a") != F.col("b"), F.coalesce("mv", F.lit(0)), F.coalesce("uv", F.lit(0))
    methods = F.array(*[F.struct(F.lit(n).alias("method"), x.cast("long").alias("x")) for n, x in (("uv", uv), ("mv", mv), ("meta", F.when(many, mv).otherwise(uv)))])
    rows = merged.where("plp <> blb").select(F.when(F.col("plp"), "P").otherwise("B").alias("truth"), F.explode(methods).alias("m")).select("truth", "m.*")
    return op.metrics(op.confusion(rows, ["method"], F.col("truth"), F.col("x")))


def genewise_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """By gene, and over all, how many variants of each category point which way, and their share of the category."""
    rows = _evaluated(spark, sf)
    categories = F.filter(F.array(F.when(F.col("blb"), "B/LB"), F.when(F.col("is_vus"), "VUS"), F.when(F.col("plp"), "P/LP"), F.when(lb.in_sample(F.col("sample"), "gnomAD"), "gnomAD")), lambda x: x.isNotNull())
    s = F.signum("eff")
    counts = rows.select("gene", F.explode(categories).alias("category"), s.alias("s")).groupBy("gene", "category").agg(F.count_if(F.col("s") > 0).alias("for"), F.count_if(F.col("s") == 0).alias("none"), F.count_if(F.col("s") < 0).alias("against"))
    whole = counts.rollup("category", "gene").agg(F.sum("for").alias("for"), F.sum("none").alias("none"), F.sum("against").alias("against")).where("category IS NOT NULL")
    n = ev.total("for", "none", "against")
    return whole.select(F.coalesce("gene", F.lit("All")).alias("gene"), "category", "for", "none", "against", n.alias("n"), *[F.round(100.0 * F.col(x) / n, 6).alias(f"pct_{x}") for x in ("for", "none", "against")])


def assay_stats(spark: SparkSession, sf: str) -> DataFrame:
    """By dataset, shares of variants at each level of evidence, and numbers of its controls."""
    shares = {n: F.round(c, 6) for n, c in ev.levels_reached(F.col("eff")).items()}
    return _evaluated(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), *[c.alias(x) for x, c in shares.items()], F.count_if("plp").alias("n_plp"), F.count_if("blb").alias("n_blb"), F.count_if("is_vus").alias("n_vus"), F.count_if(lb.in_sample(F.col("sample"), "gnomAD")).alias("n_gnomad"))


def assay_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets by their author: mean, median and weighted mean of the share with any evidence, how many reach each level, and controls in all."""
    stats = assay_stats(spark, sf).withColumn("stratum", F.coalesce(nm.author_of(F.col("dataset")), F.lit("Other")))
    reach = [F.count_if(F.col(c) > 0).alias(f"{c}_count") for c in ("ge_1", "ge_2", "ge_4", "ge_8", "le_1", "le_2", "le_4", "le_8")]
    return stats.groupBy("stratum").agg(F.count("*").alias("datasets"), F.sum("n").alias("variants"), F.round(F.avg("any"), 6).alias("any_mean"), F.round(F.percentile("any", 0.5), 6).alias("any_median"), F.round(F.sum(F.col("any") * F.col("n")) / F.sum("n"), 6).alias("any_wmean"), F.count_if(F.col("any") > 50).alias("above_50"), *reach, F.sum("n_plp").alias("n_plp"), F.sum("n_blb").alias("n_blb"))


def vus_per_gene(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct VUS of sufficient quality by gene, as genomic places; a variant without a number of its own counts as one place."""
    c = F.col
    rows = variants(spark, sf).withColumn("status_now", lb.review_status(c("status_now"))).where(c("sig_now") == "Uncertain significance").where(lb.has_stars(c("status_now"), 1))
    return rows.dropDuplicates(["gene", "chrom", "pos", "ref", "alt"]).groupBy("gene").agg(F.count("*").alias("n"))


def gene_table(spark: SparkSession, sf: str) -> DataFrame:
    """By gene: its datasets, the first by name with its author and year, assays up to four, how many variants, and which inheritance it has."""
    by = _evaluated(spark, sf).groupBy("gene", "dataset", "assay").agg(F.count("*").alias("n"), F.count_if("is_vus").alias("vus"))
    d = by.groupBy("gene").agg(F.sort_array(F.collect_set("dataset")).alias("datasets"), F.size(F.collect_set("assay")).cast("long").alias("assays"), F.sum("n").alias("variants"), F.sum("vus").alias("vus"))
    first = F.get("datasets", F.lit(0))
    return d.where("size(datasets) > 1").select("gene", F.size("datasets").cast("long").alias("n_datasets"), first.alias("first"), nm.author_of(first).alias("author"), nm.year_of(first).alias("year"), (F.col("assays") <= 4).alias("joint"), "variants", "vus", _inheritance().alias("inheritance"))


def _inheritance():
    return F.when(F.substring("gene", 2, 9).cast("int") % 3 == 0, "AR").when(F.substring("gene", 2, 9).cast("int") % 3 == 1, "AD").otherwise("both")


def inheritance_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of labelled variants by gene, genes of one inheritance against those of the other: medians, and the rank sum of the first."""
    rows = _evaluated(spark, sf).where("plp OR blb").groupBy("gene").agg(F.round(F.count_if(F.col("eff") != 0) / F.count("*"), 9).alias("coverage")).withColumn("inheritance", _inheritance()).where("inheritance <> 'both'")
    ranks = ev.rank_sums(rows.withColumns({"all": F.lit(1), "dominant": F.col("inheritance") == "AD"}), ["all"], "coverage", "dominant")
    med = rows.agg(F.round(F.percentile(F.when(F.col("inheritance") == "AD", F.col("coverage")), 0.5), 6).alias("median_ad"), F.round(F.percentile(F.when(F.col("inheritance") == "AR", F.col("coverage")), 0.5), 6).alias("median_ar"))
    return ranks.crossJoin(med).select("n1", "n2", "u", F.round("auc", 6).alias("auc"), "median_ad", "median_ar")


def method_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, coverage and area under the curve of the score and of both kinds of points, by assay."""
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), x.cast("double").alias("x")) for n, x in (("score", F.col("score")), ("points", F.col("points")), ("oob", F.col("oob_points")))])).alias("m")
    rows = _evaluated(spark, sf).where("plp <> blb").select("assay", "plp", m).select("assay", "plp", "m.*")
    return ev.rank_sums(rows, ["assay", "method"], "x", "plp").select("assay", "method", "n1", "n2", F.round("auc", 6).alias("auc"))


def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline's matrix beside ours by dataset, over datasets that either has; where the baseline has none, all of its rows are indeterminate."""
    rows = _evaluated(spark, sf)
    ours = rows.groupBy("dataset").agg(*ev.matrix(_truth(), F.col("eff")))
    base = rows.where("assay <> 'A3'").groupBy("dataset").agg(*[c.alias(f"base_{n}") for c, n in zip(ev.matrix(_truth(), F.col("points")), NAMES, strict=True)])
    both = ours.join(base, "dataset", "full")
    whole = {f"base_{t}_{k}": F.coalesce(f"base_{t}_{k}", ev.total(*[f"{t}_{x}" for x in ("normal", "ir", "abnormal")]) if k == "ir" else F.lit(0)) for t in ("blb", "plp") for k in ("normal", "ir", "abnormal")}
    return both.withColumns(whole)


NAMES = [f"{t}_{n}" for t in ("blb", "plp") for n in ("normal", "ir", "abnormal")]


def restart_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """How far the best of the first N restarts stays behind the best of all, in standard deviations of the dataset's restarts: quartiles by N."""
    runs = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("dataset"), F.col("l_linenumber").alias("fit"), (F.col("l_extendedprice") / 1000).alias("ll"))
    best = runs.groupBy("dataset").agg(F.max("ll").alias("best"), F.stddev_pop("ll").alias("sd"), *[F.max(F.when(F.col("fit") <= n, F.col("ll"))).alias(f"b{n}") for n in (1, 2, 4, 7)])
    each = best.select(F.nullif("sd", F.lit(0.0)).alias("sd"), F.explode(F.array(*[F.struct(F.lit(n).alias("restarts"), (F.col(f"b{n}") - F.col("best")).alias("delta")) for n in (1, 2, 4, 7)])).alias("x"))
    delta = F.round(F.try_divide(F.col("x.delta"), F.col("sd")), 9)
    q = F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = each.select(F.col("x.restarts").cast("long").alias("restarts"), delta.alias("d")).where("d IS NOT NULL").groupBy("restarts").agg(q.alias("q"), F.count("*").alias("n"))
    return rows.select("restarts", "n", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("p25", "median", "p75"))])


QUERIES = {f.__name__: f for f in (gene_deduped, deduped_matrices, both_determinate, author_matrices, pooled_coverage, panel_matrices, panel_deduped, threshold_metrics, method_metrics, genewise_evidence, assay_stats, assay_strata, vus_per_gene, gene_table, inheritance_ranks, method_auc, method_comparison, restart_deltas)}

E = f"""WITH {V}, {CALLS}, e AS (SELECT c.*, CASE WHEN level = 'aa' THEN concat(gene, '_aa_', aa_ref, aa_pos, aa_alt) ELSE concat_ws('_', gene, coalesce(chrom, 'nan'), coding) END AS key,
  list_contains(string_split(sample, '|'), '{PLP}') AS plp, list_contains(string_split(sample, '|'), '{BLB}') AS blb, coalesce(oob_points, points) AS eff, CASE WHEN author <> 'Indeterminate' THEN upper(author) END AS det,
  CASE author WHEN 'Normal' THEN -1 WHEN 'Abnormal' THEN 1 ELSE 0 END AS cs FROM c)"""
_MERGED = "CASE WHEN min({0}) < 0 AND max({0}) > 0 THEN 0 WHEN max({0}) > 0 THEN max({0}) ELSE min({0}) END"
D = E + f""", d AS (SELECT gene, key, arg_min(sample, {{'o': line, 's': sample}}) FILTER (sample <> '') AS sample, {_MERGED.format("eff")} AS points, CASE WHEN count(DISTINCT det) = 1 THEN max(det) END AS call, bool_or(is_vus) AS is_vus, count(DISTINCT assay) AS n_assays FROM e GROUP BY 1, 2),
dd AS (SELECT *, coalesce(list_contains(string_split(sample, '|'), '{PLP}'), false) AS plp, coalesce(list_contains(string_split(sample, '|'), '{BLB}'), false) AS blb, CASE call WHEN 'NORMAL' THEN -1 WHEN 'ABNORMAL' THEN 1 ELSE 0 END AS cs FROM d)"""


def _matrix(value: str, prefix: str = "", before: str = "") -> str:
    return ", ".join(f"count(*) FILTER ({t} AND sign({value}) = {s}) AS {before}{t}_{prefix}{n}" for t in ("blb", "plp") for s, n in ((-1, "normal"), (0, "ir"), (1, "abnormal")))


def _panel(value: str, prefix: str) -> str:
    return ", ".join(f"count(*) FILTER (sign({value}) = {s} AND panel = {t}) AS {prefix}_{r}_{c}" for s, r in ((1, "p"), (0, "i"), (-1, "b")) for t, c in ((1, "plp"), (-1, "blb")))


def _metrics(source: str, keys: str) -> str:
    return f"""h AS (SELECT *, CASE WHEN fp = 0 OR fn = 0 THEN 0.5 ELSE 0 END::DOUBLE AS h, (tp + fn + fp + tn)::DOUBLE AS called FROM {source})
SELECT {keys}, tp, p_vus, fn, fp, b_vus, tn, round(called / nullif(called + p_vus + b_vus, 0), 6) AS coverage, round((tp + tn) / nullif(called, 0), 6) AS accuracy,
  round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS sensitivity, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity,
  round((tp * tn - fp * fn)::DOUBLE / nullif(sqrt(((tp + fp) * (tp + fn))::DOUBLE * ((tn + fp) * (tn + fn))::DOUBLE), 0), 6) AS mcc, round((tp + h) * (tn + h) / nullif((fp + h) * (fn + h), 0), 6) AS dor FROM h"""


_CELLS = "count(*) FILTER (plp AND {0} > 0) AS tp, count(*) FILTER (plp AND {0} = 0) AS p_vus, count(*) FILTER (plp AND {0} < 0) AS fn, count(*) FILTER (NOT plp AND {0} > 0) AS fp, count(*) FILTER (NOT plp AND {0} = 0) AS b_vus, count(*) FILTER (NOT plp AND {0} < 0) AS tn"
_AUTHOR = f"a AS (SELECT dataset, {_matrix('cs')}, count(*) FILTER (is_vus AND cs <> 0) AS vus_determinate, count(*) FILTER (is_vus) AS vus_total FROM e GROUP BY 1 HAVING count(*) FILTER (cs <> 0 AND (plp OR blb)) > 0)"
_PANEL = "r AS (SELECT e.*, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS panel FROM e JOIN part ON aa_pos = p_partkey WHERE p_size % 3 < 2)"
_LEVEL = ", ".join([f"round(100.0::DOUBLE * count(*) FILTER (eff >= {k}) / count(*), 6) AS ge_{k}, round(100.0::DOUBLE * count(*) FILTER (eff <= -{k}) / count(*), 6) AS le_{k}" for k in (1, 2, 4, 8)] + ["round(100.0::DOUBLE * count(*) FILTER (eff <> 0) / count(*), 6) AS \"any\""])
_STATS = f"t AS (SELECT dataset, count(*) AS n, {_LEVEL}, count(*) FILTER (plp) AS n_plp, count(*) FILTER (blb) AS n_blb, count(*) FILTER (is_vus) AS n_vus, count(*) FILTER (list_contains(string_split(sample, '|'), 'gnomAD')) AS n_gnomad FROM e GROUP BY 1)"
_KIND = "CASE gene[2:]::INT % 3 WHEN 0 THEN 'AR' WHEN 1 THEN 'AD' ELSE 'both' END"
_NAME = "CASE WHEN contains({0}, 'unpublished') THEN NULL ELSE regexp_extract({0}, '_(Kim[0-9])_', 1) || ' et al.' END"
_RANKS = "n AS (SELECT {keys}, {value} AS x, count(*) FILTER ({first}) AS a, count(*) FILTER (NOT {first}) AS b FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL), k AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY {keys} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n), u AS (SELECT {keys}, sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2, sum(a * (below + b / 2.0::DOUBLE)) AS u FROM k GROUP BY ALL)"
_CUTS = "cuts AS (SELECT * FROM (VALUES " + ", ".join(map(str, CUTS)) + ") t(cut, hi, lo))"
SQL = {
    "gene_deduped": D + " SELECT gene, key, sample, points, call, is_vus, n_assays FROM d",
    "deduped_matrices": D + f" SELECT gene, count(call) AS called, {_matrix('points')}, {_matrix('cs', 'author_')} FROM dd GROUP BY 1 HAVING count(call) > 0",
    "both_determinate": E + f" SELECT dataset, {_matrix('eff')}, {_matrix('cs', 'author_')} FROM e WHERE eff <> 0 AND cs <> 0 GROUP BY 1",
    "author_matrices": E + f", {_AUTHOR} SELECT * FROM a",
    "pooled_coverage": E + f""", {_AUTHOR} SELECT 'points' AS method, round(100 * count(*) FILTER (eff <> 0)::DOUBLE / count(*), 6) AS pct FROM e WHERE is_vus UNION ALL SELECT 'author', round(100 * sum(vus_determinate)::DOUBLE / nullif(sum(vus_total), 0), 6) FROM a""",
    "panel_matrices": E + f", {_PANEL} SELECT gene, " + ", ".join(f"count(*) FILTER (sign({v}) = {s} AND panel = {p}) AS {to}_{t}_{n}" for v, to in (("eff", "ours"), ("cs", "author")) for t, p in (("blb", -1), ("plp", 1)) for n, s in (("normal", -1), ("ir", 0), ("abnormal", 1))) + " FROM r GROUP BY 1",
    "panel_deduped": E + f""", {_PANEL}, g AS (SELECT gene, key, max(panel) AS panel, {_MERGED.format("eff")} AS points, CASE WHEN count(DISTINCT det) = 1 THEN max(det) END AS call FROM r GROUP BY 1, 2 HAVING count(DISTINCT panel) = 1),
w AS (SELECT *, CASE call WHEN 'NORMAL' THEN -1 WHEN 'ABNORMAL' THEN 1 ELSE 0 END AS cs FROM g) SELECT gene, {_panel("points", "ours")}, {_panel("cs", "author")} FROM w GROUP BY 1""",
    "threshold_metrics": E + f""", {_CUTS}, l AS (SELECT plp, 'standard' AS method, points AS x FROM e WHERE plp OR blb UNION ALL SELECT plp, 'oob', eff FROM e WHERE plp OR blb),
t AS (SELECT method, cut, plp, CASE WHEN x >= hi THEN 1 WHEN x <= lo THEN -1 ELSE 0 END AS y FROM l, cuts), mm AS (SELECT method, cut, {_CELLS.format("y")} FROM t GROUP BY 1, 2), {_metrics("mm", "method, cut")}""",
    "method_metrics": E + f""", g AS (SELECT gene, key, coalesce(max(points), 0) AS uv, coalesce(max(oob_points), 0) AS mv, count(DISTINCT assay) > 1 AS many, bool_or(plp) AS plp, bool_or(blb) AS blb FROM e GROUP BY 1, 2),
l AS (SELECT plp, unnest([{{'m': 'uv', 'x': uv}}, {{'m': 'mv', 'x': mv}}, {{'m': 'meta', 'x': CASE WHEN many THEN mv ELSE uv END}}], recursive := true) FROM g WHERE plp <> blb), mm AS (SELECT m AS method, {_CELLS.format("x")} FROM l GROUP BY 1), {_metrics("mm", "method")}""",
    "genewise_evidence": E + """, l AS (SELECT gene, sign(eff) AS s, unnest(list_filter([CASE WHEN blb THEN 'B/LB' END, CASE WHEN is_vus THEN 'VUS' END, CASE WHEN plp THEN 'P/LP' END, CASE WHEN list_contains(string_split(sample, '|'), 'gnomAD') THEN 'gnomAD' END], lambda x: x IS NOT NULL)) AS category FROM e),
b AS (SELECT coalesce(gene, 'All') AS gene, category, count(*) FILTER (s > 0) AS "for", count(*) FILTER (s = 0) AS "none", count(*) FILTER (s < 0) AS against, count(*) AS n FROM l GROUP BY GROUPING SETS ((category, gene), (category)))
SELECT *, round(100.0::DOUBLE * "for" / n, 6) AS pct_for, round(100.0::DOUBLE * "none" / n, 6) AS pct_none, round(100.0::DOUBLE * against / n, 6) AS pct_against FROM b""",
    "assay_stats": E + f", {_STATS} SELECT * FROM t",
    "assay_strata": E + f""", {_STATS} SELECT coalesce({_NAME.format("dataset")}, 'Other') AS stratum, count(*) AS datasets, sum(n)::BIGINT AS variants, round(avg("any"), 6) AS any_mean, round(median("any"), 6) AS any_median, round(sum("any" * n) / sum(n), 6) AS any_wmean, count(*) FILTER ("any" > 50) AS above_50,
  {", ".join(f"count(*) FILTER ({c} > 0) AS {c}_count" for c in ("ge_1", "ge_2", "ge_4", "ge_8", "le_1", "le_2", "le_4", "le_8"))}, sum(n_plp)::BIGINT AS n_plp, sum(n_blb)::BIGINT AS n_blb FROM t GROUP BY 1""",
    "vus_per_gene": f"WITH {V}, s AS (SELECT * REPLACE ({_STAR.format('status_now')} AS status_now) FROM v) SELECT gene, count(*) AS n FROM (SELECT DISTINCT gene, chrom, pos, ref, alt FROM s WHERE sig_now = 'Uncertain significance' AND {_STARS('status_now', 1)}) GROUP BY 1",
    "gene_table": E + f""", b AS (SELECT gene, list_sort(list(DISTINCT dataset)) AS d, count(DISTINCT assay) AS assays, count(*) AS variants, count(*) FILTER (is_vus) AS vus FROM e GROUP BY 1)
SELECT gene, len(d) AS n_datasets, d[1] AS first, {_NAME.format("d[1]")} AS author, nullif(regexp_extract(d[1], '_((19|20)[0-9][0-9])', 1), '') AS year, assays <= 4 AS joint, variants, vus, {_KIND} AS inheritance FROM b WHERE len(d) > 1""",
    "inheritance_ranks": E + f""", c2 AS (SELECT gene, round(count(*) FILTER (eff <> 0)::DOUBLE / count(*), 9) AS coverage, {_KIND} AS kind, 1 AS "all" FROM e WHERE plp OR blb GROUP BY 1), g AS (SELECT * FROM c2 WHERE kind <> 'both'),
{_RANKS.format(keys='"all"', value="coverage", first="kind = 'AD'", source="g")} SELECT n1, n2, u, round(u / nullif(n1 * n2, 0), 6) AS auc, (SELECT round(median(coverage), 6) FROM g WHERE kind = 'AD') AS median_ad, (SELECT round(median(coverage), 6) FROM g WHERE kind = 'AR') AS median_ar FROM u""",
    "method_auc": E + f""", l AS (SELECT assay, plp, 'score' AS method, score::DOUBLE AS x0 FROM e WHERE plp <> blb UNION ALL SELECT assay, plp, 'points', points FROM e WHERE plp <> blb UNION ALL SELECT assay, plp, 'oob', oob_points FROM e WHERE plp <> blb),
{_RANKS.format(keys="assay, method", value="x0", first="plp", source="l")} SELECT assay, method, n1, n2, round(u / nullif(n1 * n2, 0), 6) AS auc FROM u""",
    "method_comparison": E + f""", o AS (SELECT dataset, {_matrix("eff")} FROM e GROUP BY 1), b AS (SELECT dataset, {_matrix("points", before="base_")} FROM e WHERE assay <> 'A3' GROUP BY 1)
SELECT o.*, {", ".join(f"coalesce(base_{t}_{k}, {f'{t}_normal + {t}_ir + {t}_abnormal' if k == 'ir' else '0'}) AS base_{t}_{k}" for t in ("blb", "plp") for k in ("normal", "ir", "abnormal"))} FROM o FULL JOIN b USING (dataset)""",
    "restart_deltas": """WITH b AS (SELECT l_partkey, max(l_extendedprice / 1000) AS best, nullif(stddev_pop(l_extendedprice / 1000), 0) AS sd, max(l_extendedprice / 1000) FILTER (l_linenumber <= 1) AS b1, max(l_extendedprice / 1000) FILTER (l_linenumber <= 2) AS b2, max(l_extendedprice / 1000) FILTER (l_linenumber <= 4) AS b4, max(l_extendedprice / 1000) FILTER (l_linenumber <= 7) AS b7 FROM lineitem GROUP BY 1),
x AS (SELECT unnest([{'n': 1, 'd': (b1 - best) / sd}, {'n': 2, 'd': (b2 - best) / sd}, {'n': 4, 'd': (b4 - best) / sd}, {'n': 7, 'd': (b7 - best) / sd}], recursive := true) FROM b)
SELECT n::BIGINT AS restarts, count(*) AS n, round(quantile_cont(round(d, 9), 0.25), 6) AS p25, round(quantile_cont(round(d, 9), 0.5), 6) AS median, round(quantile_cont(round(d, 9), 0.75), 6) AS p75 FROM x WHERE d IS NOT NULL GROUP BY x.n""",
}
