"""Perturbed labels and what calibration makes of them: conditions are rows, every step is keyed by condition.

Defined results: a null score or label takes no part; a class with fewer rows than asked for keeps all of them; conditions
without both classes have no threshold and score nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the hash that orders rows, and those of them that make a bucket.
HASH_BITS, BUCKET_BITS = 28, 12


def lot(row_id: Column, condition: Column) -> Column:
    """A number that orders the rows of a condition: the same in any task."""
    return F.conv(F.substring(F.md5(F.concat(row_id.cast("string"), F.lit(":"), condition)), 1, HASH_BITS // 4), 16, 10).cast("long")


def smallest(rows: DataFrame, keys: list[str], order: str, tie: str, limit: str) -> DataFrame:
    """rows with ``chosen``: whether a row is among the ``limit`` smallest of its keys by order, then tie.

    Counts by bucket of the order tell all rows but those of one bucket; only these are ranked, so no task ranks a whole key.
    """
    bucket = F.shiftright(order, HASH_BITS - BUCKET_BITS).alias("bucket")
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("in_bucket"))
    below = F.sum("in_bucket").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumn("bucket", bucket).join(counts.withColumn("below", F.coalesce(below, F.lit(0))), [*keys, "bucket"])
    whole, none = F.col("below") + F.col("in_bucket") <= F.col(limit), F.col("below") >= F.col(limit)
    sure = told.where(whole | none).withColumn("chosen", whole)
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(order, tie))
    edge = told.where(~(whole | none)).withColumn("chosen", rank <= F.col(limit) - F.col("below"))
    return sure.unionByName(edge).drop("bucket", "in_bucket", "below")


def perturbed(rows: DataFrame, conditions: DataFrame, row_id: str) -> DataFrame:
    """rows (row_id, score, truth P or B) under each condition (kind, level, seed): some labels swapped, or at most so many of each class."""
    crossed = rows.crossJoin(F.broadcast(conditions)).withColumn("lot", lot(F.col(row_id), F.concat_ws("/", "kind", F.col("level").cast("string"), F.col("seed").cast("string"))))
    keys = ["kind", "level", "seed", "truth"]
    sizes = rows.groupBy("truth").agg(F.count("*").alias("n"))
    limit = F.when(F.col("kind") == "discordance", F.floor(F.col("level") * F.col("n") / 100)).otherwise(F.col("level"))
    chosen = smallest(crossed.join(F.broadcast(sizes), "truth").withColumn("most", limit), keys, "lot", row_id, "most")
    kept = chosen.where((F.col("kind") == "discordance") | F.col("chosen"))
    swapped = F.when((F.col("kind") == "discordance") & F.col("chosen"), F.when(F.col("truth") == "P", "B").otherwise("P")).otherwise(F.col("truth"))
    return kept.select("kind", "level", "seed", row_id, "score", "truth", swapped.alias("label"))


def thresholds(labelled: DataFrame) -> DataFrame:
    """kind, level, seed, mid, width: half way between the means of the classes, and a tier's width, of each condition."""
    mean = lambda c: F.avg(F.when(F.col("label") == c, F.col("score")))
    means = labelled.groupBy("kind", "level", "seed").agg(mean("P").alias("p"), mean("B").alias("b"))
    return means.select("kind", "level", "seed", F.round((F.col("p") + F.col("b")) / 2, 9).alias("mid"), F.round((F.col("p") - F.col("b")) / 4, 9).alias("width")).where("mid IS NOT NULL AND width <> 0")


def scored(reference: DataFrame, limits: DataFrame) -> DataFrame:
    """kind, level, seed, truth, points: the reference's scores under the ranges of each condition."""
    x = (F.col("score") - F.col("mid")) / F.col("width")
    points = F.when(x > 0, F.least(F.lit(8), F.floor(x))).otherwise(-F.least(F.lit(8), F.floor(-x)))
    return reference.crossJoin(F.broadcast(limits)).select("kind", "level", "seed", "truth", points.cast("long").alias("points"))
