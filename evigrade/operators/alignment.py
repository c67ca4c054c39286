"""Alignment of assays by the identity of their variants. DataFrame to DataFrame; keys are rows, groups are never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrade.operators.components import connected_components
from evigrade.sources.staging import cut


def keyed(rows: DataFrame, assay: str, genomic: Column, coding: Column, protein: Column, own_id: Column) -> DataFrame:
    """rows with strategy and keys: an assay is keyed by the first of genomic place, coding names, protein change and id that any of its rows has.

    coding and protein may list several names between bars. A row without a key of its assay's strategy falls back to its id.
    """
    named = rows.withColumns({"_genomic": genomic, "_coding": coding, "_protein": protein, "_id": own_id})
    has = named.groupBy(assay).agg(*[F.bool_or(F.col(c).isNotNull()).alias(f"any{c}") for c in ("_genomic", "_coding", "_protein")])
    strategy = F.when(F.col("any_genomic"), "genomic").when(F.col("any_coding"), "coding").when(F.col("any_protein"), "protein").otherwise("id")
    found = named.join(has.select(assay, strategy.alias("strategy")), assay)
    names = F.when(F.col("strategy") == "genomic", F.array("_genomic")).when(F.col("strategy") == "coding", F.split("_coding", r"\|")).when(F.col("strategy") == "protein", F.split("_protein", r"\|"))
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    keys = F.when(F.size(kept) > 0, F.transform(kept, lambda n: F.concat(F.substring("strategy", 1, 1), F.lit(":"), n))).otherwise(F.array(F.concat(F.lit("i:"), F.col("_id"))))
    return found.withColumn("keys", keys).drop("_genomic", "_coding", "_protein", "_id")


def with_variant(rows: DataFrame) -> DataFrame:
    """rows with variant, the smallest key that their keys reach over rows that share one: equality closed over all assays."""
    first = F.get("keys", F.lit(0))
    links = rows.where("size(keys) > 1").select(first.alias("a"), F.explode(F.slice("keys", 2, 1_000_000)).alias("b"))
    roots = cut(connected_components(links), "alignment-roots")
    keyed_rows = rows.withColumn("_first", first)
    return keyed_rows.join(roots.withColumnRenamed("node", "_first"), "_first", "left").withColumn("variant", F.coalesce("root", "_first")).drop("_first", "root")


def aligned(rows: DataFrame, assay: str, assays: list[str], score: str, order: str, flags: list[str], call: str) -> DataFrame:
    """One row a variant: a score an assay, the last measured one; any() of the flags; the call, Abnormal if any says so, else the first."""
    cells = {a: F.max(F.when((F.col(assay) == a) & F.col(score).isNotNull(), F.struct(F.col(order).alias("o"), F.col(score).alias("s"))))["s"] for a in assays}
    said = F.when(F.col(call).isNotNull(), F.struct(F.col(assay).alias("a"), F.col(order).alias("o"), F.col(call).alias("c")))
    wide = rows.groupBy("variant").agg(*[c.alias(a) for a, c in cells.items()], *[F.bool_or(f).alias(f) for f in flags], F.bool_or(F.lower(call) == "abnormal").alias("_bad"), F.min(said)["c"].alias("_first"))
    dims = sum((F.col(a).isNotNull().cast("long") for a in assays), F.lit(0).cast("long"))
    return wide.withColumn("dims", dims).where("dims > 0").withColumn("call", F.when(F.col("_bad"), "Abnormal").otherwise(F.col("_first"))).drop("_bad", "_first")


def by_priority(rows: DataFrame, lookups: list[tuple[Column, DataFrame]], found: str) -> DataFrame:
    """rows with ``found`` from the first of the lookups that knows the row's key; each has the columns key and value, one row a key."""
    out = rows
    for i, (key, table) in enumerate(lookups):
        out = out.join(table.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}")), key == F.col(f"_k{i}"), "left")
    names = [f"_v{i}" for i in range(len(lookups))]
    return out.withColumn(found, F.coalesce(*names)).drop(*names, *[f"_k{i}" for i in range(len(lookups))])


def without_leakage(predictor: DataFrame, assayed: DataFrame, key: str, labels: list[str], suffix: str = "_predictor_only") -> DataFrame:
    """Predictor rows whose variant an assay measured lose their labels, and come a second time, with their labels, under an id of their own."""
    hit = predictor.join(assayed.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    labelled = F.lit(False)
    for c in labels:
        labelled = labelled | F.coalesce(F.col(c), F.lit(False))
    cleared = hit.withColumns({c: F.col(c) & ~F.col("_hit") for c in labels})
    copies = hit.where(F.col("_hit") & labelled).withColumn(key, F.concat(key, F.lit(suffix)))
    return cleared.unionByName(copies).drop("_hit")
