"""The corpus pipeline: five stages over documents, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet to the folder in
spark.checkpoint.dir and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.llm.exact_dedup import keep_first_copies
from evigrade.llm.near_dedup import keep_one_of_near
from evigrade.llm.packing import pack
from evigrade.llm.pii import redact
from evigrade.llm.quality import keep_good
from evigrade.sources.staging import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nearest-neighbour voting; documents that score under the threshold go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, then the smallest id."""
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates of a similarity of 0.8 or more in five-word shingles, SimHash groups first: one of each group stays."""
    return keep_one_of_near(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens; one row per piece."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("pii", pii), ("packing", packing)]

#: Models are trained and tokens are packed on the way: not SQL. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
