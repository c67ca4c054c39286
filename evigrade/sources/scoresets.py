"""Readers and writers of variant tables and scoresets: CSV and TSV, JSON lines, VCF, and directories of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header of a VCF with these columns.
VCF_HEAD = ("##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A delimited file with a header, tabs where its name says so, compressed or not; columns come by name, and those it lacks are null.

    Everything is read as text and cast by the schema, so that a bad number is null and not a lost row.
    """
    tabs = path.rstrip("/").removesuffix(".gz").endswith((".tsv", ".txt"))
    raw = spark.read.csv(path, header=True, sep="\t" if tabs else ",", inferSchema=False, quote='"', escape='"')
    have = {c.lower(): c for c in raw.columns}
    cell = lambda f: F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
    return raw.select(*[cell(f).alias(f.name) for f in schema])


def write_csv(scores: DataFrame, path: str) -> None:
    """Score and comma list of samples; the rows are written by the tasks that hold them."""
    scores.write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json(scores: DataFrame, path: str) -> None:
    scores.write.json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; infinite and missing numbers may be bare words."""
    return spark.read.schema(schema).json(path, allowNonNumericNumbers=True)


def assignments(flags: list[Column]) -> Column:
    """Numbers of the samples that hold a row, with commas."""
    return F.array_join(F.filter(F.array(*[F.when(f, F.lit(str(i))) for i, f in enumerate(flags)]), lambda x: x.isNotNull()), ",")


def vcf_lines(rows: DataFrame, chrom: Column, pos: Column, name: Column, ref: Column, alt: Column) -> DataFrame:
    """chrom, pos and line of the rows that have a position, in order of chromosome, as text, and position."""
    p = pos.try_cast("long")
    kept = rows.select(chrom.cast("string").alias("chrom"), p.alias("pos"), F.concat_ws("\t", chrom, p.cast("string"), F.coalesce(name, F.lit(".")), ref, alt, F.lit("."), F.lit("."), F.lit(".")).alias("line")).where("chrom IS NOT NULL AND pos IS NOT NULL")
    return kept.orderBy("chrom", "pos", "line")


def write_vcf(lines: DataFrame, path: str) -> None:
    """Sorted parts of text; the header is a part of its own that sorts before them, so the parts in order are the file."""
    spark = lines.sparkSession
    spark.createDataFrame([(h,) for h in VCF_HEAD], "value string").coalesce(1).write.text(f"{path}/part=0")
    lines.select(F.col("line").alias("value")).write.text(f"{path}/part=1")


def read_by_path(spark: SparkSession, path: str, schema: T.StructType, pattern: str, names: list[str]) -> DataFrame:
    """All delimited files below path with what their paths say: one column a group of the pattern."""
    raw = spark.read.option("recursiveFileLookup", "true").option("header", "true").schema(schema).csv(path)
    return raw.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1).alias(n) for i, n in enumerate(names)])


def calibrations(priors: DataFrame, ranges: DataFrame, dataset: list[str]) -> DataFrame:
    """One row a dataset: the columns of priors, and ranges, a map from points, as text for JSON, to their ranges in order; a dataset without ranges has an empty one."""
    tiers = ranges.groupBy(*dataset, F.col("points").cast("string").alias("points")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("rs"))
    packed = tiers.groupBy(*dataset).agg(F.map_from_entries(F.collect_list(F.struct("points", "rs"))).alias("ranges"))
    none = F.create_map().cast("map<string,array<struct<lo:double,hi:double>>>")
    return priors.join(packed, dataset, "left").withColumn("ranges", F.coalesce("ranges", none))
