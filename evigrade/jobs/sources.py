"""Queries through files: what is written and read again is what was there. Each has its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from evigrade.functions import names as nm
from evigrade.jobs.calibration import SCORED, _scores
from evigrade.jobs.labels import V, variants
from evigrade.sources import scoresets as src
from evigrade.sources.staging import shared_folder

SCORES = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), StructField("sample_assignments", StringType()), StructField("splice", DoubleType())])
#: Consequences that are called otherwise once they are read.
CONSEQUENCES = {"splice_acceptor_variant": "splice_site_variant", "splice_donor_variant": "splice_site_variant", "splice_region_variant": "splicing_variant", "splice_donor_region_variant": "splicing_variant", "splice_donor_5th_base_variant": "splicing_variant", "splice_polypyrimidine_tract_variant": "splicing_variant"}


def _folder(spark: SparkSession, suffix: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{suffix}"


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    flags = [F.col(c) for c in ("is_plp", "is_blb", "is_pop", "is_reg")]
    return _scores(spark, sf).select("doc_id", F.round("score", 6).alias("score"), src.assignments(flags).alias("sample_assignments"))


def _read_back(read: DataFrame) -> DataFrame:
    flags = nm.memberships(F.col("sample_assignments"), 4)
    return read.where("score IS NOT NULL").select("doc_id", "score", *[f.alias(n) for f, n in zip(flags, ("is_plp", "is_blb", "is_pop", "is_reg"), strict=True)])


def scoreset_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A scoreset written as CSV and read again, its sample numbers turned to flags; a column that the file lacks is null."""
    path = _folder(spark, ".csv")
    src.write_csv(_assigned(spark, sf), path)
    read = src.read_table(spark, path, SCORES)
    return _read_back(read.where("splice IS NULL"))


def scoreset_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same as JSON lines."""
    path = _folder(spark, ".json")
    src.write_json(_assigned(spark, sf), path)
    return _read_back(src.read_json(spark, path, SCORES))


def vcf_file(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a VCF of the variants that have a place, as written and read again: by chromosome, how many, the first and the last position."""
    path, c = _folder(spark, ".vcf"), F.col
    src.write_vcf(src.vcf_lines(variants(spark, sf), c("chrom"), c("pos"), c("coding"), c("ref"), c("alt")), path)
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    return lines.groupBy(F.col("f")[0].alias("chrom")).agg(F.count("*").alias("n"), F.min(F.col("f")[1].cast("long")).alias("first"), F.max(F.col("f")[1].cast("long")).alias("last"), F.count_if(F.size("f") != 8).alias("wrong"))


def adapted_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of another layout: renamed columns, a dataset from gene and assay, mapped consequences, alleles from the names, wild types dropped."""
    kinds = "CASE l_linenumber WHEN 1 THEN 'splice_donor_variant' WHEN 2 THEN 'splice_region_variant' WHEN 3 THEN 'missense_variant' END"
    rows = variants(spark, sf).withColumnsRenamed({"sig_now": "clinvar_sig_2026", "frequency": "gnomad_MAF", "protein": "hgvs_p"})
    mapped = F.create_map(*[F.lit(x) for pair in CONSEQUENCES.items() for x in pair])
    raw = F.expr(kinds.replace("l_linenumber", "line % 10"))
    ref, alt = nm.last_alleles(F.concat_ws("|", "coding", "hgvs_p"))
    rows = rows.where(F.col("hgvs_p").isNotNull()).select("line", F.concat_ws("_", "gene", "assay").alias("dataset"), F.coalesce(mapped[raw], raw).alias("consequence"), ref.alias("ref"), alt.alias("alt"), "clinvar_sig_2026", "gnomad_MAF")
    return rows.groupBy("dataset", "consequence", "ref", "alt").agg(F.count("*").alias("n"), F.count("clinvar_sig_2026").alias("known"), F.count("gnomad_MAF").alias("seen"))


def results_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of one dataset, scale and component a folder, found by their paths and taken together."""
    path = _folder(spark, "")
    rows = variants(spark, sf).select("assay", F.concat(F.lit("c"), (F.col("aa_pos") % 2 + 2).cast("string")).alias("comp"), "line", "points")
    rows.write.partitionBy("assay", "comp").csv(path, header=True)
    found = src.read_by_path(spark, path, StructType([StructField("line", LongType()), StructField("points", LongType())]), "assay=([^/]+)/comp=([^/]+)/", ["assay", "comp"])
    return found.groupBy("assay", "comp").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def patched_table(spark: SparkSession, sf: str) -> DataFrame:
    """An evidence table whose samples, calls and VUS flags are overwritten by id where a newer table has them."""
    rows = variants(spark, sf).groupBy("aa_pos").agg(F.max("sample").alias("sample"), F.max("call").alias("call"), F.bool_or("is_vus").alias("is_vus"))
    newer = variants(spark, sf).where("assay = 'A2'").groupBy("aa_pos").agg(F.min(F.nullif("sample", F.lit(""))).alias("new_sample"), F.min("call").alias("new_call"), F.bool_and("is_vus").alias("new_vus"))
    joined = rows.join(newer, "aa_pos", "left")
    return joined.select("aa_pos", F.coalesce("new_sample", "sample").alias("sample"), F.coalesce("new_call", "call").alias("call"), F.coalesce("new_vus", "is_vus").alias("is_vus"))


QUERIES = {f.__name__: f for f in (scoreset_csv, scoreset_json, vcf_file, adapted_table, results_by_path, patched_table)}
_SET = f"WITH {SCORED} SELECT doc_id, round(score, 6) AS score, is_plp, is_blb, is_pop, is_reg FROM s"
_MAP = "CASE line % 10 WHEN 1 THEN 'splice_site_variant' WHEN 2 THEN 'splicing_variant' WHEN 3 THEN 'missense_variant' END"
SQL = {
    "scoreset_csv": _SET,
    "scoreset_json": _SET,
    "vcf_file": f"WITH {V} SELECT chrom, count(*) AS n, min(pos::BIGINT) AS first, max(pos::BIGINT) AS last, 0::BIGINT AS wrong FROM v WHERE chrom IS NOT NULL AND pos <> 'x' GROUP BY 1",
    "adapted_table": f"""WITH {V} SELECT concat_ws('_', gene, assay) AS dataset, {_MAP} AS consequence, nullif(regexp_extract(coding, '([ACGT])>([ACGT])$', 1), '') AS ref, nullif(regexp_extract(coding, '([ACGT])>([ACGT])$', 2), '') AS alt,
  count(*) AS n, count(sig_now) AS known, count(frequency) AS seen FROM v WHERE protein IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "results_by_path": f"WITH {V} SELECT assay, 'c' || (aa_pos % 2 + 2) AS comp, count(*) AS n, sum(points)::BIGINT AS points FROM v GROUP BY 1, 2",
    "patched_table": f"""WITH {V}, r AS (SELECT aa_pos, max(sample) AS sample, max(call) AS call, bool_or(is_vus) AS is_vus FROM v GROUP BY 1), n AS (SELECT aa_pos, min(nullif(sample, '')) AS s, min(call) AS c, bool_and(is_vus) AS u FROM v WHERE assay = 'A2' GROUP BY 1)
SELECT r.aa_pos, coalesce(s, sample) AS sample, coalesce(c, call) AS call, coalesce(u, is_vus) AS is_vus FROM r LEFT JOIN n USING (aa_pos)""",
}
