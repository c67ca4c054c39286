"""Bootstraps without copies of the rows: a row's draws in all seeds are an array, made from a hash of its id.

Drawing n of n rows with replacement takes a row k times with the law of Poisson with mean 1 as n grows; each row draws by
itself, so any task finds the same draws and nothing is shuffled. One MD5 gives the draws of eight seeds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a draw, and the draws that they are cut into: 0, 1, 2 and so on times, each as likely as Poisson with mean 1 says.
BITS = 16
STEPS = [round(2**BITS * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]


def _below(digest: Column, place: Column, step: int) -> Column:
    """Whether the two bytes at a place of a digest, 0 to 7, are less than a step; bytes compare as the number that they are."""
    return F.substring(digest, (1 + 2 * place).cast("int"), F.lit(2)) < F.lit(step.to_bytes(2, "big"))


def _times(digest: Column, place: Column) -> Column:
    found = F.lit(len(STEPS))
    for k in reversed(range(len(STEPS))):
        found = F.when(_below(digest, place, STEPS[k]), k).otherwise(found)
    return found


def _digest(row_id: Column, block: Column) -> Column:
    return F.unhex(F.md5(F.concat(row_id.cast("string"), F.lit(":"), block.cast("string"))))


def times_drawn(row_id: Column, seed: Column) -> Column:
    """How often the seed's bootstrap takes the row; a null id is never taken."""
    return F.when(row_id.isNotNull(), _times(_digest(row_id, F.floor(seed / 8)), seed % 8)).otherwise(0)


def with_block_draws(rows: DataFrame, row_id: str, seeds: int) -> DataFrame:
    """rows once for each block of eight seeds, with the number of the block and the draws d0 to d7 of its seeds.

    Sums by block have eight columns however many seeds there are, and copies of a row don't outlive the partial sums.
    """
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((seeds - 1) // 8)))).withColumn("_digest", _digest(F.col(row_id), F.col("block")))
    return each.withColumns({f"d{i}": F.when(F.col(row_id).isNotNull(), _times(F.col("_digest"), F.lit(i))).otherwise(0) for i in range(8)}).drop("_digest")


def seeds_of_blocks(sums: DataFrame, keep: list[str], fields: dict[str, list[Column]], seeds: int) -> DataFrame:
    """keep, seed and fields, each given as the columns of a block's eight seeds."""
    each = F.explode(F.array(*[F.struct((F.col("block") * 8 + i).cast("long").alias("seed"), *[of[i].alias(n) for n, of in fields.items()]) for i in range(8)])).alias("_of_seed")
    return sums.select(*keep, each).select(*keep, "_of_seed.*").where(F.col("seed") < seeds)


def with_unseen(rows: DataFrame, row_id: str, seeds: int) -> DataFrame:
    """rows with unseen, a bit mask of the seeds, at most 63, that never drew them. A digest is taken once for its eight seeds."""
    digests = rows.withColumns({f"_digest{b}": _digest(F.col(row_id), F.lit(b)) for b in range((seeds + 7) // 8)})
    bits = [F.when(F.col(row_id).isNull() | _below(F.col(f"_digest{s // 8}"), F.lit(s % 8), STEPS[0]), F.lit(1 << s).cast("long")).otherwise(F.lit(0).cast("long")) for s in range(seeds)]
    return digests.select(*rows.columns, sum(bits[1:], bits[0]).alias("unseen"))


def draws(row_id: Column, seeds: int) -> list[Column]:
    """times_drawn of each of the seeds."""
    return [times_drawn(row_id, F.lit(s)) for s in range(seeds)]


def draws_sql(row_id: str, seed: str) -> str:
    """The same as SQL of DuckDB, seed being a column or a number."""
    x = f"('0x' || substr(md5({row_id} || ':' || ({seed} // 8)), 1 + 4 * ({seed} % 8), 4))::INT"
    return "CASE " + " ".join(f"WHEN {x} < {s} THEN {k}" for k, s in enumerate(STEPS)) + f" ELSE {len(STEPS)} END"
