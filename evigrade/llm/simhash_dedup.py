"""SimHash near-duplicates through an inverted index over positional bytes, with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints at ``max_bits`` = 2 or fewer differing bits share at
least six of the eight, so the index needs every pair that shares six, and a posting on one byte alone (one 256th of all
fingerprints) would tally nearly all pairs. The postings are therefore keyed by four positional bytes each, six sets
chosen so that whichever two positions differ, one set avoids both: the guaranteed minimum of six shared bytes implies
one shared posting. Each pair met in a posting has its shared positional bytes tallied, pairs with fewer than the minimum go,
and the rest are verified by their differing bits. Copies fold into one fingerprint before any of this.

A posting longer than ``max_posting`` isn't paired. Its members are linked exactly another way: each stands at itself and
its 64 one-bit neighbours, and fingerprints within two bits of each other, and only they, meet at such a point. That is 65
rows a member whatever the posting's length, and at most 65 fingerprints a point.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any other; rows that
repeat stay rows; a null id gets its component's smallest non-null id (null where it has none); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.operators.components import connected_components
from evigrade.sources.staging import cut, table

from .common import id_and_bytes

WORDS, MAX_BITS, MAX_POSTING = 3, 2, 64
#: Pairs of two-byte blocks: two differing bits touch two blocks at most, and the other two blocks are one of these.
POSITION_SETS = tuple(combinations(range(4), 2))
HASH_SEED = 42
#: Shingles whose bits are counted at once; it bounds the memory of a very long text.
BLOCK = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of the word shingles of text; a bit is set if it is in over half of the shingles' XXH64."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(found) - words + 1)
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[s:e], HASH_SEED) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=False)], dtype=">u8")
        ones += bit_counts(h.view(np.uint8).reshape(-1, 8))
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows of bytes have each bit; 255 rows at once fit a byte's sum."""
    bits = np.unpackbits(rows, axis=1)
    return sum((bits[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255)), np.zeros(bits.shape[1], np.int64))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    return id_and_bytes(docs, id_col, text_col).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _mask(blocks: tuple[int, ...]) -> int:
    m = sum(0xFFFF << (16 * b) for b in blocks)
    return m - (1 << 64) if m >> 63 else m


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes a and b have in common."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(255 << 8 * i if i < 7 else -(1 << 56))) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(distinct: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fp``; a point that joins fingerprints of a long posting may be an end."""
    least = 8 - MAX_BITS
    posting = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("v")) for k, p in enumerate(POSITION_SETS)])).alias("p")
    index = cut(distinct.select("fp", posting).select("p.s", "p.v", "fp"), "simhash-index")
    sizes = cut(index.groupBy("s", "v").count().where("count > 1"), "simhash-sizes")
    short = index.join(sizes.where(F.col("count") <= max_posting).drop("count"), ["s", "v"])
    a, b = short.select("s", "v", F.col("fp").alias("a")), short.select("s", "v", F.col("fp").alias("b"))
    near = a.join(b, ["s", "v"]).where("a < b").where(shared_bytes(F.col("a"), F.col("b")) >= least).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    crowd = index.join(sizes.where(F.col("count") > max_posting).drop("count"), ["s", "v"], "left_semi").select("fp").distinct()
    points = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)]]
    at = cut(crowd.select("fp", F.explode(F.array(*points)).alias("point")), "simhash-points")
    met = at.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("point", "a")
    through = at.join(met, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.select("a", "b").unionByName(through)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_posting: int = MAX_POSTING) -> DataFrame:
    """One row per document: doc_id, fp, component_id, the smallest doc_id reachable over links of 2 or fewer bits."""
    fps = cut(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(links(distinct, max_posting)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Staged, so that a hot fingerprint's partition of the last join can be split.
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"), "simhash-named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
