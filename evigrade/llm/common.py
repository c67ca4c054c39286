"""Helpers shared by the training-data operators: input shaping, hashes, and rows that go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space of every contract here: space, tab, LF, VT, FF, CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Names of rows up to this number are broadcast, more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on; clashing or extra columns are left behind, a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches sized for whole texts: Spark's 10,000 rows a batch are for narrow rows.

    Both settings are the session's; one that the session was given itself stays.
    """
    conf = df.sparkSession.conf
    for key, usual, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1500"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(16 << 20))):
        if conf.get(key, None) in (usual, None, "-1", str(2**31 - 1), str(2**63 - 1)):
            conf.set(key, own)
    return df


def id_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As id_and_text, with the text as UTF-8 bytes for Arrow: nothing is decoded on the way."""
    return bounded_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def without(docs: DataFrame, id_col: str, mark: Column, dropped: DataFrame, repeated: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows named in ``dropped`` and with one row of each name in ``repeated``; all columns stay.

    A row's name is its id and ``mark``, a hash of its text. The two tables have the columns doc_id and mark; up to ``most``
    rows of them are broadcast, so that texts stay where they lie, and beyond that the rows are shuffled once. Of rows with
    one name that is repeated the greatest as JSON stays: they differ in other columns only.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named_rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), mark.alias("mark"))

    def named(table: DataFrame) -> DataFrame:
        few = table.count() <= most
        table = table.select(F.col("doc_id").alias("k_id"), F.col("mark").alias("k_mark"))
        return F.broadcast(table) if few else table

    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("mark") == F.col("k_mark"))
    left = named_rows.join(named(dropped), same, "left_anti")
    if not repeated.isEmpty():
        again = named(repeated)
        folded = left.join(again, same, "left_semi").groupBy("id", "mark").agg(F.max_by("row", F.to_json("row")).alias("row"))
        left = left.join(again, same, "left_anti").select("row").unionByName(folded.select("row"))
    return left.select("row.*")


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id gives null."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % n


def base32_of_sha1(hex_sha1: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hex SHA-1: each 5 hex digits are 4 base32 digits."""
    quads = [F.lpad(F.conv(F.substring(hex_sha1, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
