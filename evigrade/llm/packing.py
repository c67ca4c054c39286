"""Packing by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows, which need no packing, and a rest; the rest is cut into parts of at most
``part`` tokens, small enough for differencing to even windows out. Parts are packed in blocks of at most ``block``, in
the task that tokenised them and in the order of its rows, so nothing is shuffled, the memory of a task is bounded, and a
task that runs again gives the same sequences. In a block, k windows begin as k-tuples of sums with one part each; the
two tuples of the widest spread are merged again and again with opposing imbalances, the largest sum of one with the
smallest of the other. k begins at the least possible and rises while some window exceeds the capacity.

Defined results: a null text is empty, and its only id is the end mark 0; a token that the file adds to its vocabulary has
its one id wherever a text holds it, as the library has it; repeated rows are separate documents; an empty table gives no
rows; texts of any length are packed whole.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from evigrade.sources.staging import table

from .bpe import batches_of, public_path, units
from .common import id_and_bytes

TOKENIZER = "byte_bpe_50k.json"
#: Units that a store holds before it is put aside; a batch's units may come on top. It bounds memory, not what is encoded.
KEPT_UNITS = 60_000
WINDOW, PART, BLOCK, END = 1024, 256, 2048, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Units:
    """Ids of a tokenizer file, unit by unit: a unit has the same ids in any text, and those met before are kept, up to a bound.

    Beyond the bound the store is put aside, and units that come again move from there to the next one, so that common
    units are never encoded twice; what didn't come again goes when the next store is full.

    The tokenizers library takes over ten microseconds for a call or a row of a batch, whatever its length, so the few
    units that weren't met before go through the other library, with ranks read from the same file: a byte-level
    vocabulary's merges are in the order of the ids that they make.
    """

    def __init__(self, path: str, kept_units: int = KEPT_UNITS) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in told.get("added_tokens", [])}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte = _byte_alphabet()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if all(c in byte for c in t) and not t.startswith("<|")}
        self.one = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.finder = regex.compile(public_tokenizers.PATTERN).findall
        self.kept_units, self.known, self.aside = kept_units, dict(self.added), {}

    def cut(self, text: str) -> list[str]:
        """Units of text; the file's added tokens are units of their own wherever they stand."""
        if not any(t in text for t in self.added):
            return units(text, self.finder)
        return [u for part in self.at_added.split(text) for u in ([part] if part in self.added else units(part, self.finder))]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        if len(self.known) > self.kept_units:
            self.known, self.aside = dict(self.added), self.known
        known, one = self.known, self.one
        unseen = set().union(*cut).difference(known)
        again = list(unseen.intersection(self.aside))
        known.update(zip(again, map(self.aside.__getitem__, again), strict=True))
        new = list(unseen.difference(again))
        known.update(zip(new, [array("I", one(u)).tobytes() for u in new], strict=True))
        return [b"".join(map(known.__getitem__, us)) for us in cut]


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: a visible Latin-1 character is itself, the other bytes follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def _units(path: str) -> Units:
    return Units(path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of indices into sizes with near-equal sums, by multiway largest differencing.

    A partial partition holds only its non-empty groups, ascending by sum; the groups it lacks have sum 0.
    """
    heap = [(-(s if k > 1 else 0), i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # The largest of b meets the smallest of a: the k - len(a) empty groups first, then a's own from below.
        room, merged = k - len(a), []
        for at, (s, items) in enumerate(reversed(b)):
            if at < room:
                merged.append((s, items))
            else:
                t, own = a[at - room]
                own.extend(items)
                merged.append((s + t, own))
        merged += a[max(0, len(b) - room) :]
        merged.sort(key=itemgetter(0))
        least = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[-1][0], tick, merged))
        tick += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack_block(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Groups of sizes, each at most capacity; no size may exceed it."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while k:
        groups = differencing(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return groups
        k += 1
    return []


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, part: int = PART, block: int = BLOCK) -> DataFrame:
    """One row per piece, as SCHEMA says; sequence_id is the task's number times 2**32 plus a count within the task."""
    path = path or public_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, made, waiting = _units(path), TaskContext.get().partitionId() << 32, 0, []
        fields = SCHEMA.replace(" long", "").split(", ")

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], fields)

        def packed(parts: list[tuple]) -> Iterator[tuple]:
            nonlocal made
            for group in pack_block([p[2] for p in parts], window):
                at = 0
                for i in sorted(group):
                    yield (*parts[i], base + made, at)
                    at += parts[i][2]
                made += 1

        for b in batches:
            for first, texts in batches_of(b.column(1)):
                found = []
                for i, ids in enumerate(encoder.encode(texts)):
                    doc_id, ids = b.column(0)[first + i].as_py(), ids + END.to_bytes(4, "little")
                    n = len(ids) // 4
                    at = 0
                    while at < n:
                        size = min(n - at, window if n - at >= window else part)
                        piece = (doc_id, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n)
                        if size == window:
                            found.append((*piece, base + made, 0))
                            made += 1
                        else:
                            waiting.append(piece)
                        at += size
                while len(waiting) >= block:
                    found += packed(waiting[:block])
                    del waiting[:block]
                if found:
                    yield rows(found)
        if waiting:
            yield rows(list(packed(waiting)))

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
