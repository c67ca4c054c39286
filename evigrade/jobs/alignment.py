"""Queries that align assays and join what belongs to a variant, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.jobs.labels import V, variants
from evigrade.operators import alignment as op
from evigrade.operators.bootstrap import draws, draws_sql
from evigrade.sources.staging import table

ASSAYS = [f"A{i}" for i in range(6)]
#: Coding names of a variant: its own, and that of the group of three that it belongs to.
CODING = "concat('c', CAST(aa_pos AS STRING), '|c', CAST(aa_pos - aa_pos % 3 AS STRING))"
GENOMIC = "CASE WHEN assay IN ('A0', 'A1', 'A2') AND chrom IS NOT NULL THEN concat_ws('_', chrom, pos, ref, alt) END"
SEEDS = 16


def aligned_assays(spark: SparkSession, sf: str) -> DataFrame:
    """Three assays are keyed by place, two by coding names that overlap, one by id: one row a variant over all."""
    rows = variants(spark, sf).withColumns({"coding": F.when(F.col("assay").isin("A3", "A4"), F.expr(CODING)), "plp": F.contains("sample", F.lit("Pathogenic")), "blb": F.contains("sample", F.lit("Benign"))})
    keyed = op.keyed(rows, "assay", F.expr(GENOMIC), F.col("coding"), F.lit(None).cast("string"), F.concat(F.lit("v"), F.col("aa_pos").cast("string")))
    return op.aligned(op.with_variant(keyed), "assay", ASSAYS, "score", "line", ["plp", "blb"], "call")


def id_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Assays side by side by id, as an array with null where one has no score; ids with fewer than three assays or five measurements go."""
    rows = variants(spark, sf).where("score IS NOT NULL")
    wide = rows.groupBy(F.col("aa_pos").alias("id")).agg(F.count("*").alias("n"), F.array(*[F.round(F.avg(F.when(F.col("assay") == a, F.col("score"))), 6) for a in ASSAYS]).alias("scores"))
    dims = F.size(F.filter("scores", lambda s: s.isNotNull()))
    return wide.where((dims >= 3) & (F.col("n") >= 5)).select("id", "n", dims.cast("long").alias("dims"), F.array_join(F.transform("scores", lambda s: F.when(s.isNotNull(), F.format_string("%.4f", s))), ",", "nan").alias("scores"))


def functional_and_predictor(spark: SparkSession, sf: str) -> DataFrame:
    """Mean assay score and predictor score by protein change, whichever is known."""
    change = F.concat("gene", F.lit("_"), "aa_ref", F.col("aa_pos").cast("string"), "aa_alt")
    assayed = variants(spark, sf).where("assay = 'A1'").groupBy(change.alias("change")).agg(F.round(F.avg("score"), 6).alias("functional"))
    predicted = variants(spark, sf).where("assay IN ('A2', 'A3')").groupBy(change.alias("change")).agg(F.max("frequency").alias("predictor"))
    return assayed.join(predicted, "change", "full")


def leakage_split(spark: SparkSession, sf: str) -> DataFrame:
    """Predictor rows lose the labels that an assay will be judged by; labelled copies stay apart."""
    change = F.concat("gene", F.lit("_"), "aa_ref", F.col("aa_pos").cast("string"), "aa_alt")
    assayed = variants(spark, sf).where("assay = 'A1' AND score IS NOT NULL").select(change.alias("change"))
    predictor = variants(spark, sf).where("assay IN ('A2', 'A3')").groupBy(change.alias("change")).agg(F.bool_or(F.contains("sample", F.lit("Pathogenic"))).alias("plp"), F.bool_or(F.contains("sample", F.lit("Benign"))).alias("blb"), F.count("*").alias("n"))
    return op.without_leakage(predictor, assayed, "change", ["plp", "blb"])


def resolved_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Points of another table's variants, found by genomic place, else by coding name, else by protein change."""
    known = variants(spark, sf).where("assay = 'A0'")
    lookup = lambda key: known.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.max("points").alias("value"))
    place, coding, protein = F.concat_ws("_", F.col("chrom"), "pos", "ref", "alt"), F.col("coding"), F.concat("gene", F.lit("_"), "protein")
    place = F.when(F.col("chrom").isNotNull(), place)
    rows = variants(spark, sf).where("assay IN ('A4', 'A5')").withColumns({"k1": place, "k2": coding, "k3": protein})
    found = op.by_priority(rows, [(F.col("k1"), lookup(place)), (F.col("k2"), lookup(coding)), (F.col("k3"), lookup(protein))], "uv")
    return found.groupBy("gene", "assay").agg(F.count("*").alias("n"), F.count("uv").alias("found"), F.sum("uv").alias("points"))


def uv_points_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Points by gene and variant with a column an assay, and what remains of them: the extreme if all agree in sign, else 0."""
    rows = variants(spark, sf).groupBy("gene", F.col("aa_pos").alias("variant")).agg(*[F.max(F.when(F.col("assay") == a, F.col("points"))).alias(a) for a in ASSAYS])
    lo, hi = F.least(*ASSAYS), F.greatest(*ASSAYS)
    return rows.withColumn("agreed", F.when((lo < 0) & (hi > 0), 0).when(hi > 0, hi).otherwise(lo).cast("long"))


def oob_map(spark: SparkSession, sf: str) -> DataFrame:
    """The bootstraps that never drew a document, as a list."""
    times = F.array(*draws(F.col("doc_id"), SEEDS))
    unseen = F.filter(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda i: F.get("times", i) == 0)
    rows = table(spark, sf, "documents").select("doc_id", times.alias("times"))
    return rows.select("doc_id", F.array_join(unseen.cast("array<string>"), ",").alias("seeds"))


def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by supplier with what three dimension tables say of it; a supplier without line items stays."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("plp"), F.count_if(F.col("l_returnflag") == "A").alias("blb"))
    named = table(spark, sf, "supplier").join(items, "s_suppkey", "left").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("plp", F.lit(0)).alias("plp"), F.coalesce("blb", F.lit(0)).alias("blb"), "n_name", "r_name")


def resolved_components(spark: SparkSession, sf: str) -> DataFrame:
    """The components to use for each dataset: as configured, else as selected, else three, else two, else the first there is."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.concat(F.col("l_linenumber").cast("string"), F.lit("c")).alias("comp"))
    configured = F.when(F.col("dataset") % 3 == 0, F.concat((F.col("dataset") % 5 + 1).cast("string"), F.lit("c")))
    selected = F.when(F.col("dataset") % 2 == 0, F.lit("4c"))
    rank = F.when(F.col("comp") == configured, 0).when(F.col("comp") == selected, 1).when(F.col("comp") == "3c", 2).when(F.col("comp") == "2c", 3).otherwise(4)
    return rows.groupBy("dataset").agg(F.min(F.struct(rank.alias("rank"), "comp")).alias("m")).select("dataset", "m.comp")


def renamed_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Present names of datasets through a chain of two renamings, and whether any row of a dataset has a call."""
    old = "concat('D', CAST(aa_pos % 12 AS STRING))"
    rows = variants(spark, sf).select("line", F.expr(old).alias("dataset"), F.when(F.expr("aa_pos % 12 < 9"), F.col("call")).alias("call"))
    alias = spark.createDataFrame([("D1", "D2"), ("D2", "D20"), ("D5", "D50")], "old string, new string")
    once = rows.join(F.broadcast(alias), F.col("dataset") == F.col("old"), "left").select("line", F.coalesce("new", "dataset").alias("dataset"), "call")
    twice = once.join(F.broadcast(alias), F.col("dataset") == F.col("old"), "left").select("line", F.coalesce("new", "dataset").alias("dataset"), "call")
    return twice.groupBy("dataset").agg(F.count("*").alias("n"), F.count("call").alias("calls"), F.bool_or(F.col("call").isNotNull()).alias("reported"))


QUERIES = {f.__name__: f for f in (aligned_assays, id_alignment, functional_and_predictor, leakage_split, resolved_keys, uv_points_matrix, oob_map, dataset_summary, resolved_components, renamed_datasets)}

_CELL = lambda a: f"arg_max(score, {{'o': line, 's': score}}) FILTER (assay = '{a}' AND score IS NOT NULL)"
_CHANGE = "concat(gene, '_', aa_ref, aa_pos, aa_alt)"
_DIMS = " + ".join(f"(\"{a}\" IS NOT NULL)::INT" for a in ASSAYS)
SQL = {
    "aligned_assays": f"""WITH {V}, k AS (SELECT *, CASE WHEN assay IN ('A0', 'A1', 'A2') AND chrom IS NOT NULL THEN 'g:' || concat_ws('_', chrom, pos, ref, alt) WHEN assay IN ('A3', 'A4') THEN 'g' || (aa_pos // 3) ELSE concat('i:v', aa_pos) END AS grp,
  CASE WHEN assay IN ('A3', 'A4') THEN least('c:c' || aa_pos, 'c:c' || (aa_pos - aa_pos % 3)) ELSE grp END AS low, contains(sample, 'Pathogenic') AS p, contains(sample, 'Benign') AS b FROM v),
a AS (SELECT grp, min(low) AS variant, {", ".join(f'{_CELL(a)} AS "{a}"' for a in ASSAYS)}, bool_or(p) AS plp, bool_or(b) AS blb, CASE WHEN bool_or(lower(call) = 'abnormal') THEN 'Abnormal' ELSE min({{'a': assay, 'o': line, 'c': call}}) FILTER (call IS NOT NULL).c END AS call FROM k GROUP BY 1)
SELECT * EXCLUDE (grp), ({_DIMS})::BIGINT AS dims FROM a WHERE {_DIMS} > 0""",
    "id_alignment": f"""WITH {V}, w AS (SELECT aa_pos AS id, count(*) AS n, {", ".join(f"round(avg(score) FILTER (assay = '{a}'), 6) AS {a}" for a in ASSAYS)} FROM v WHERE score IS NOT NULL GROUP BY 1)
SELECT id, n, ({_DIMS})::BIGINT AS dims, concat_ws(',', {", ".join(f"coalesce(printf('%.4f', {a}), 'nan')" for a in ASSAYS)}) AS scores FROM w WHERE n >= 5 AND {_DIMS} >= 3""",
    "functional_and_predictor": f"""WITH {V}, a AS (SELECT {_CHANGE} AS change, round(avg(score), 6) AS functional FROM v WHERE assay = 'A1' GROUP BY 1), p AS (SELECT {_CHANGE} AS change, max(frequency) AS predictor FROM v WHERE assay IN ('A2', 'A3') GROUP BY 1)
SELECT coalesce(a.change, p.change) AS change, functional, predictor FROM a FULL JOIN p ON a.change = p.change""",
    "leakage_split": f"""WITH {V}, h AS (SELECT DISTINCT {_CHANGE} AS change FROM v WHERE assay = 'A1' AND score IS NOT NULL),
p AS (SELECT {_CHANGE} AS change, bool_or(contains(sample, 'Pathogenic')) AS plp, bool_or(contains(sample, 'Benign')) AS blb, count(*) AS n FROM v WHERE assay IN ('A2', 'A3') GROUP BY 1), m AS (SELECT p.*, change IN (SELECT change FROM h) AS hit FROM p)
SELECT change, plp AND NOT hit AS plp, blb AND NOT hit AS blb, n FROM m UNION ALL SELECT change || '_predictor_only', plp, blb, n FROM m WHERE hit AND (plp OR blb)""",
    "resolved_keys": f"""WITH {V}, t AS (SELECT *, CASE WHEN chrom IS NOT NULL THEN concat_ws('_', chrom, pos, ref, alt) END AS k1, coding AS k2, gene || '_' || protein AS k3 FROM v), o AS (SELECT * FROM t WHERE assay = 'A0'),
l1 AS (SELECT k1, max(points) AS v1 FROM o WHERE k1 IS NOT NULL GROUP BY 1), l2 AS (SELECT k2, max(points) AS v2 FROM o WHERE k2 IS NOT NULL GROUP BY 1), l3 AS (SELECT k3, max(points) AS v3 FROM o WHERE k3 IS NOT NULL GROUP BY 1)
SELECT gene, assay, count(*) AS n, count(coalesce(v1, v2, v3)) AS found, sum(coalesce(v1, v2, v3))::BIGINT AS points FROM t LEFT JOIN l1 USING (k1) LEFT JOIN l2 USING (k2) LEFT JOIN l3 USING (k3) WHERE assay IN ('A4', 'A5') GROUP BY 1, 2""",
    "uv_points_matrix": f"""WITH {V}, m AS (SELECT gene, aa_pos AS variant, {", ".join(f"max(points) FILTER (assay = '{a}') AS \"{a}\"" for a in ASSAYS)} FROM v GROUP BY 1, 2), e AS (SELECT *, least({", ".join(ASSAYS)}) AS lo, greatest({", ".join(ASSAYS)}) AS hi FROM m)
SELECT * EXCLUDE (lo, hi), CASE WHEN lo < 0 AND hi > 0 THEN 0 WHEN hi > 0 THEN hi ELSE lo END AS agreed FROM e""",
    "oob_map": f"SELECT doc_id, array_to_string(list_filter(range({SEEDS}), lambda s: ({draws_sql('doc_id', 's')}) = 0), ',') AS seeds FROM documents",
    "dataset_summary": """SELECT s_suppkey, s_name, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS plp, count(*) FILTER (l_returnflag = 'A') AS blb, n_name, r_name
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY s_suppkey, s_name, n_name, r_name""",
    "resolved_components": """WITH r AS (SELECT l_suppkey AS dataset, l_linenumber || 'c' AS comp, CASE WHEN l_suppkey % 3 = 0 AND l_linenumber = l_suppkey % 5 + 1 THEN 0 WHEN l_suppkey % 2 = 0 AND l_linenumber = 4 THEN 1 WHEN l_linenumber = 3 THEN 2 WHEN l_linenumber = 2 THEN 3 ELSE 4 END AS rank FROM lineitem)
SELECT dataset, min({'r': rank, 'c': comp}).c AS comp FROM r GROUP BY 1""",
    "renamed_datasets": f"""WITH {V}, r AS (SELECT CASE aa_pos % 12 WHEN 1 THEN 'D20' WHEN 2 THEN 'D20' WHEN 5 THEN 'D50' ELSE 'D' || (aa_pos % 12) END AS dataset, CASE WHEN aa_pos % 12 < 9 THEN call END AS call FROM v)
SELECT dataset, count(*) AS n, count(call) AS calls, count(call) > 0 AS reported FROM r GROUP BY 1""",
}
