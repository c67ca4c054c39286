"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, (offset + j * skip) mod size, and the shards
take turns claiming their next free slot until the table is full. Shards get within one slot of each other, and when a
shard comes or goes few slots change hands. The table's size is a parameter, so the broadcast is bounded whatever the
data; placing a row is one hash and one look-up, without a shuffle.

Writing moves each row once, to one of ``files`` writers of its shard by a hash of its text, so that a hot id, which has to
stay in one shard, is still written by many tasks, and no shard gets a file of every task.

Defined results: a null id has a slot like any other value; equal ids share a shard; repeated rows are placed and written
each; an empty table gives no rows; extra columns are written as they are, but for those named slot and shard, which go.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import shared_folder, table

SHARDS, SLOTS = 64, 65537
#: Writers of a shard; at 100 TB and 64 shards, 4,096 of them make files of about 400 MB.
FILES = 4


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that each slot belongs to; slots must be a prime above the number of shards."""
    if not shards or slots <= len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above the number of shards, and there must be shards")
    offset = [zlib.crc32(f"offset:{s}".encode()) % slots for s in shards]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (slots - 1) + 1 for s in shards]
    found, at, filled = [-1] * slots, list(offset), 0
    while True:
        for k in range(len(shards)):
            while found[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            found[at[k]] = k
            filled += 1
            if filled == slots:
                return found


def place(docs: DataFrame, shards: list[str], id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """docs with the columns slot and shard; all other columns stay."""
    spark = docs.sparkSession
    places = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{id_col}`"), slots))
    return placed.join(F.broadcast(places), "slot")


def shard(docs: DataFrame, shards: list[str], id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """doc_id, slot and shard of every row."""
    return place(docs.select(F.col(f"`{id_col}`").alias("doc_id")), shards, "doc_id", slots)


def write_shards(docs: DataFrame, shards: list[str], path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, files: int = FILES) -> DataFrame:
    """Writes whole rows as Parquet to a folder a shard under path, at most ``files`` files each, and reads them back."""
    placed = place(docs, shards, id_col, slots)
    writer = F.pmod(F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{id_col}`")), F.lit(files))
    placed.repartition("shard", writer).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.select(*[f"`{c}`" for c in placed.columns if c != "shard"], "shard").schema).parquet(path)


def balance(written: DataFrame, text_col: str = "text") -> DataFrame:
    """shard, rows and bytes of text."""
    return written.groupBy("shard").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(f"`{text_col}`")), F.lit(0)).alias("bytes"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), F.lit(slots)).cast("int")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, as it was written to its shard."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    written = write_shards(table(spark, sf_dir, "documents"), [f"shard-{i:03d}" for i in range(SHARDS)], path)
    return written.select("doc_id", "slot", "shard", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
