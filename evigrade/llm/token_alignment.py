"""Alignment of two tokenizers by divide and conquer at shared cuts.

A text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B); both kinds of tokens are byte ranges over
the text behind one space. Where tokens of both end at one byte the text can be cut. Groups between neighbouring cuts are
found by divide and conquer: the ends of A are bisected for the one nearest the middle of an interval that B ends at too,
and both halves are worked in turn; an interval without a cut inside is a leaf, and a group.

Before a single space that stands between two visible characters both tokenizers end a token whatever stands around, so
texts are first split there. Each different stretch is encoded and aligned once and kept, up to a bound on their number;
a stretch of any length is worked whole.

How many documents hold an id pair linked is counted over all documents: each task folds the distinct pairs of its
documents before they are shuffled by pair. The counts of the commonest pairs, at most ``head``, are broadcast back; the
pairs below that bar are joined by a shuffle and summed by document. The highest count of each A id is one number per id
of the vocabulary and is broadcast.

Defined results: a null or an empty text, and one whose tokens don't spell it (it holds U+2581, which B writes for a
space), have no tokens: zeros and an empty groups_sha256; strings that look like special tokens are ordinary text; bytes
that aren't UTF-8 are read as U+FFFD; repeated rows are documents of their own and each counts; a null id stays null; an
empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .bpe import batches_of, public_path
from .common import id_and_bytes
from .packing import Units

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: B's ids stay below this power of two, so that a pair is one number: the id of A times it plus the id of B.
B_IDS = 1 << 15
#: Stretches kept by a worker process, and the longest one that is kept, in characters.
KEPT, LONGEST = 400_000, 64
#: Bytes of the texts that are aligned together.
BLOCK = 2 << 20
#: Pairs whose counts are broadcast, at most; the others are joined.
HEAD = 1 << 20
#: Distinct pairs of documents that a task folds at a time.
FOLD = 1 << 21
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_JOINED = np.dtype("<u4")


class Aligner:
    """Both tokenizers of one process, and the stretches that they have met."""

    def __init__(self, a_path: str, b_path: str, kept: int = KEPT) -> None:
        import sentencepiece

        a = Units(a_path, 0)
        self.encode_a = a.one
        self.a_bytes = [a.one.__self__.decode_single_token_bytes(i) for i in range(a.one.__self__.max_token_value + 1)]
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = b.encode
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b.id_to_piece(i) for i in range(b.get_piece_size()))]
        if len(self.b_bytes) > B_IDS:
            raise ValueError(f"more than {B_IDS} ids of the second tokenizer")
        self.sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.names = list(map(str, range(max(map(len, self.sizes)))))
        self.kept, self.known = kept, {}

    def stretch(self, text: str, b: list[int]) -> tuple | None:
        """(A ids, B ids, groups, written groups, linked pairs) of a stretch that begins with a space and its B ids; None if tokens don't spell it."""
        a, raw = self.encode_a(text), text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        ends_a, ends_b = (list(accumulate(map(sizes.__getitem__, ids))) for sizes, ids in zip(self.sizes, (a, b), strict=True))
        named_a, named_b = list(map(self.names.__getitem__, a)), list(map(self.names.__getitem__, b))
        groups, written, i, j = leaves(ends_a, ends_b), [], 0, 0
        for to_i, to_j in groups:
            written.append(",".join(named_a[i:to_i]) + "|" + ",".join(named_b[j:to_j]))
            i, j = to_i, to_j
        return len(a), len(b), len(groups), ";".join(written), array("I", linked(a, b, ends_a, ends_b)).tobytes()

    def align(self, texts: list[str]) -> list[tuple | None]:
        """(A ids, B ids, groups, written groups, linked pairs) of each text; None for an empty or a misspelt one."""
        if len(self.known) > self.kept:
            self.known.clear()
        cut, known = [stretches(" " + t) if t else [] for t in texts], self.known
        unseen = list(set().union(*cut).difference(known))
        known.update(zip(unseen, map(self.stretch, unseen, self.encode_b([s[1:] for s in unseen], num_threads=1)), strict=True))
        out = []
        for parts in cut:
            found = list(map(known.__getitem__, parts))
            if not found or None in found:
                out.append(None)
                continue
            n_a, n_b, n_groups, written, pairs = zip(*found, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(written), b"".join(pairs)))
        for s in unseen:
            if len(s) > LONGEST:
                del known[s]
        return out


def stretches(text: str) -> list[str]:
    """text split before each single space between two visible characters; every stretch but perhaps the first begins with it."""
    first, *rest = _CUT.split(text)
    return [first, *[" " + s for s in rest]]


def leaves(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Where groups end, as (tokens of A, tokens of B) before the cut, in order; both lists of ends close with the text's length.

    An interval is a range of A's tokens and one of B's. Its inner ends of A are tried outwards from the middle, each looked
    up among B's by bisection. A part without cuts is tried again only while it holds the middle of its interval, so all
    searches together take about n log n tries.
    """
    if len(ends_a) == 1 or len(ends_b) == 1:
        return [(len(ends_a), len(ends_b))]
    out: list[tuple[int, int]] = []
    todo = [(0, len(ends_a), 0, len(ends_b))]
    while todo:
        i, to_i, j, to_j = todo.pop()
        if to_i - i > 1 and to_j - j > 1:
            last, middle = to_j - 1, (i + to_i - 1) // 2
            for x in _outwards(i, to_i - 1, middle):
                end = ends_a[x]
                y = bisect_left(ends_b, end, j, last)
                if y < last and ends_b[y] == end:
                    todo += [(x + 1, to_i, y + 1, to_j), (i, x + 1, j, y + 1)]
                    break
            else:
                out.append((to_i, to_j))
        else:
            out.append((to_i, to_j))
    return out


def _outwards(i: int, to_i: int, middle: int) -> Iterator[int]:
    """range(i, to_i) from the middle outwards."""
    yield middle
    for step in range(1, max(middle - i, to_i - 1 - middle) + 1):
        if middle - step >= i:
            yield middle - step
        if middle + step < to_i:
            yield middle + step


def linked(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> list[int]:
    """Pairs of ids of the tokens whose byte ranges overlap, as one number each: the earlier end moves on."""
    out, i, j, n = [], 0, 0, len(a)
    while i < n:
        out.append(a[i] * B_IDS + b[j])
        end_a, end_b = ends_a[i], ends_b[j]
        i += end_a <= end_b
        j += end_b <= end_a
    return out


@lru_cache(2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of docs, as ALIGNED says: pairs are the distinct linked id pairs, times how often the text links each."""
    a_path, b_path = a_path or public_path(A_FILE), b_path or public_path(B_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for b in batches:
            for first, texts in batches_of(b.column(1), BLOCK):
                rows = []
                for i, found in enumerate(aligner.align(texts)):
                    n, written, pairs = (found[:3], hashlib.sha256(found[3].encode()).hexdigest(), found[4]) if found else ((0, 0, 0), "", b"")
                    pair, times = np.unique(np.frombuffer(pairs, _JOINED), return_counts=True)
                    rows.append((row, b.column(0)[first + i].as_py(), *n, len(pairs) // _JOINED.itemsize, written, pair.tobytes(), times.astype(_JOINED).tobytes()))
                    row += 1
                kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in ALIGNED.split(", ")])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, fold: int = FOLD) -> DataFrame:
    """pair and n, the number of documents that hold it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def folded() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

        for b in batches:
            for raw in b.column(0):
                waiting.append(np.frombuffer(raw.as_buffer(), _JOINED))
                size += len(waiting[-1])
                if size >= fold:
                    yield folded()
                    waiting, size = [], 0
        if waiting:
            yield folded()

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, head: int = HEAD) -> tuple[int, np.ndarray, np.ndarray]:
    """(bar, pairs, counts): all pairs whose count is at least the bar, at most ``head`` of them, ascending by pair.

    The bar is a power of two, the least that leaves few enough pairs above it: one row a power comes to the driver for it.
    """
    by_power = {r["power"]: r["n_pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("n_pairs")).collect()}
    power, above = 64, 0
    while power > 0 and above + by_power.get(power - 1, 0) <= head:
        power -= 1
        above += by_power.get(power, 0)
    if not above:
        return 1 << power, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.col("n") >= F.lit(1 << power)).toArrow()
    pair, n = (rows.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    return 1 << power, pair[order], n[order]


def aligned_and_counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, head: int = HEAD) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = cut(alignments(docs, id_col, text_col, a_path, b_path), "token-aligned")
    counts = cut(pair_counts(aligned), "token-pairs")
    bar, pairs, ns = head_of(counts, head)
    # At most one row for each id of A.
    tops = cut(counts.groupBy(F.floor(F.col("pair") / B_IDS).cast("long").alias("a")).agg(F.max("n").alias("top")), "token-tops")
    rows = tops.toArrow()
    best = np.zeros(1 + max(rows.column("a").to_pylist(), default=0), np.int64)
    best[rows.column("a").to_numpy()] = rows.column("top").to_numpy()
    shared = aligned.sparkSession.sparkContext.broadcast((pairs, ns, best))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked_up(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the row's place in b, pair, times, count) of all pairs of a batch; a count is 0 where the pair isn't among the commonest."""
        own, own_ns, _ = shared.value
        pair, times = (np.frombuffer(b"".join(b.column(c).to_pylist()), _JOINED).astype(np.int64) for c in ("pairs", "times"))
        at_row = np.repeat(np.arange(b.num_rows), [len(x.as_buffer()) // 4 for x in b.column("pairs")])
        if not len(own):
            return at_row, pair, times, np.zeros(len(pair), np.int64)
        at = np.minimum(np.searchsorted(own, pair), len(own) - 1)
        return at_row, pair, times, np.where(own[at] == pair, own_ns[at], 0)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value[2]
        for b in batches:
            at_row, pair, times, n = looked_up(b)
            until = np.searchsorted(at_row, np.arange(b.num_rows + 1))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[until]) for x in (times * ((n > 0) & (n == top[pair // B_IDS])), times * n)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(x, pa.int64()) for x in sums]], [*kept, "n_best", "count_sum"])

    def rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_row, pair, times, n = looked_up(b)
            row = b.column("row").to_numpy()[at_row]
            yield pa.RecordBatch.from_arrays([pa.array(x[n == 0], pa.int64()) for x in (row, pair, times)], ["row", "pair", "times"])

    common = aligned.mapInArrow(summed, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if bar > 1:
        rare = counts.where(F.col("n") < bar).withColumn("a", F.floor(F.col("pair") / B_IDS).cast("long")).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
        found = aligned.select("row", "pairs", "times").mapInArrow(rarer, "row long, pair long, times long").join(rare, "pair")
        more = found.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        common = common.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return common.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_and_counted(table(spark, sf_dir, "documents"))
