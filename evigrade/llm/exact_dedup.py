"""Exact de-duplication by progressive refinement: length, then a prefix hash, then a full hash.

A row can only have a copy if another row has its normalised length; only rows of a length that repeats have their prefix
hashed, and only rows of a length and prefix hash that repeat have their whole content hashed and grouped. Each step is a
pass over the texts where they lie; what is shuffled is a length, a prefix hash or a digest with an id. Which rows survive a
step comes back as at most ``slots`` slots, a broadcast that is bounded whatever the data: a slot shared by chance costs the
hashing of one more text and changes nothing. Groups are never collected, each step is a count or a maximum with map-side
combine, so a group holding a third of all rows costs about one row a task.

Defined results: a null text is empty, and all empty texts are equal; a null id sorts after every other id; of rows with one
id and as many code points the one with the smallest hash of its text stays; repeated rows (same id and same text) are rows
of their own, of which one is kept; rows that share an id but not a text are separate documents; an empty table gives no
rows; extra columns are ignored, and where rows are kept they stay and may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .common import ASCII_SPACE, id_and_text, without

#: Code points of the normalised text that the second step hashes.
PREFIX_CHARS = 64
#: Slots of the survivors' filters; it bounds what is broadcast, whatever the size of the data.
SLOTS = 1 << 18


def normalised(text: Column) -> Column:
    """text without ASCII white space; replace() works on bytes and is far cheaper here than a pattern or translate()."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), ASCII_SPACE, text)


def _surviving(rows: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """rows with the slot of their keys in ``slots`` slots, where some combination of keys of that slot repeats."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("slot")
    repeat = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(slot).distinct(), "dedup-slots")
    return rows.withColumn("slot", slot).join(F.broadcast(repeat.withColumn("hit", F.lit(True))), "slot", "left").drop("slot")


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, slots: int = SLOTS, digest_all: bool = False) -> DataFrame:
    """doc_id, mark (a hash of the original text), chars, full and rest of every row.

    full is the digest of the normalised text of the rows that both steps left, and null where it was never needed. Those rows'
    digests are in rest if digest_all asks for them; nothing is grouped by it.
    """
    base = id_and_text(docs, id_col, text_col)
    norm = base.select("doc_id", F.xxhash64("text").alias("mark"), F.length("text").alias("chars"), normalised(F.col("text")).alias("norm")).withColumn("size", F.octet_length("norm"))
    first = _surviving(norm, ["size"], slots).withColumnRenamed("hit", "again")
    prefix = F.when(F.col("again"), F.xxhash64(F.substring("norm", 1, prefix_chars))).alias("prefix")
    rows = first.select("doc_id", "mark", "chars", "norm", "size", "again", prefix)
    both = F.pmod(F.xxhash64("size", "prefix"), F.lit(slots)).alias("slot")
    pairs = rows.where("again").groupBy("size", "prefix").agg(F.count("*").alias("n")).where("n > 1").select(both).distinct()
    second = rows.withColumn("slot", both).join(F.broadcast(cut(pairs, "dedup-pairs").withColumn("hit", F.lit(True))), "slot", "left")
    full, left = F.unhex(F.sha2("norm", 256)), F.coalesce(F.col("again") & F.col("hit"), F.lit(False))
    rest = F.when(~left, full) if digest_all else F.lit(None).cast("binary")
    return cut(second.select("doc_id", "mark", "chars", F.when(left, full).alias("full"), rest.alias("rest")), "dedup-rows")


def _order() -> Column:
    return F.struct(F.col("chars"), F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not("doc_id").alias("rev"), F.bitwise_not("mark").alias("rev_mark"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, slots: int = SLOTS, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Longest original text stays, then smallest id.

    text_sha256 is null where the full hash was never needed; digest_all fills it for every row.
    """
    rows = refined(docs, id_col, text_col, prefix_chars, slots, digest_all)
    one = F.lit(1).cast("long")
    alone = rows.where("full IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), F.col("rest").alias("full"))
    folded = cut(rows.where("full IS NOT NULL").groupBy("full", "doc_id", "chars", "mark").agg(F.count("*").alias("n_rows")), "dedup-folded")
    # Staged, so that both sides of the join are plain exchanges and a hot group's partition can be split.
    groups = cut(folded.groupBy("full").agg(F.max(_order()).alias("best"), F.sum("n_rows").alias("group_size")), "dedup-groups")
    best = _order() == F.col("best")
    of_row = F.explode(F.transform(F.sequence(one, F.col("n_rows")), lambda i: (i == 1))).alias("is_first")
    grouped = folded.join(groups, "full").select("doc_id", F.bitwise_not("best.rev").alias("keep_id"), "group_size", F.coalesce(best, F.lit(False)).alias("is_best"), "full", of_row)
    whole = alone.unionByName(grouped.select("doc_id", "keep_id", "group_size", (F.col("is_best") & F.col("is_first")).alias("kept"), "full"))
    return whole.withColumn("text_sha256", F.lower(F.hex("full"))).drop("full")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep; all columns stay, and texts of no group aren't hashed in full."""
    rows = refined(docs, id_col, text_col)
    groups = rows.where("full IS NOT NULL").groupBy("full").agg(F.max(_order()).alias("best"), F.count("*").alias("n")).where("n > 1")
    grouped = rows.join(cut(groups.select("full", "best"), "dedup-groups"), "full")
    stays = F.coalesce(_order() == F.col("best"), F.lit(False))
    dropped = cut(grouped.where(~stays).select("doc_id", "mark").distinct(), "dedup-dropped")
    repeated = cut(grouped.where(stays).groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark"), "dedup-repeated")
    return without(docs, id_col, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), dropped, repeated)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
