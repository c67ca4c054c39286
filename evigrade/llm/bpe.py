"""Byte-level BPE by merge replay over the words of a block of the corpus.

The texts of a task's Arrow batch are one block of the corpus. Their unseen words are laid out as one long linked list of
byte tokens, and an inverted index holds, for each mergeable pair (by the rank of its joined bytes), the positions where
it stands. Merges are applied to all words of the block at once in rank order; one merge touches only the two neighbours
of its position and indexes the pairs that it makes. The work is in proportion to the bytes of *distinct* words and never
quadratic in a word's length. Words never influence each other, so blocks need no shuffle and no shared state, and a
block that is run again after a lost executor gives the same ids.

Texts are cut into units before every single space that stands between two visible characters. No match of the pattern
spans such a place, so a unit's ids are the same in any text, and they are kept, up to a stated number of units.

Defined results: a null text is empty; an empty text has no ids; texts of any length and words of any length are encoded
whole; strings that look like special tokens are ordinary text; repeated rows and clashing columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evigrade.sources.staging import table

from .common import id_and_bytes

RANKS = "byte_bpe_50k.tiktoken"
#: Units, and words, kept by a worker process; beyond this the store starts anew. It bounds memory, not what is encoded.
KEPT_WORDS = 500_000
#: White space of the pattern and of str.isspace, and what each makes with a plain space on either side.
_WHITE = [(c, f" {c}", f"{c} ") for c in map(chr, range(0x10000)) if c.isspace()]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_unsafe(text: str) -> bool:
    """Whether text has a plain space beside white space, where a cut before a space can fall inside a match, or a NUL.

    Most texts have few kinds of white space, and looking for one character is much faster than a pattern.
    """
    return "\x00" in text or any(c in text and (a in text or b in text) for c, a, b in _WHITE)


def units(text: str, finder) -> list[str]:
    """text cut where no match of the pattern can span; joined they are the text."""
    if is_unsafe(text):
        return finder(text)
    return text.replace(" ", "\x00 ").split("\x00")


class MergeReplay:
    """Encoder of one process: the merges, and the ids of the words and units that it has met."""

    #: Stands after each word and at places that a merge has used up; no pair has it.
    GONE = 0xFFFF

    def __init__(self, path: str, pattern: str, kept_units: int = KEPT_WORDS) -> None:
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.vocab[i] = t
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that joins to a token, as one integer, and the rank of that merge: the token's own id.
        self.merges = {ranks[t[:k]] << 16 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.first = np.full((256, 256), -1, np.int64)  # ranks of pairs of bytes
        for t, r in ranks.items():
            if len(t) == 2:
                self.first[t[0], t[1]] = r
        self.finder = regex.compile(pattern).findall
        self.kept_units = kept_units
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers, all merges applied in rank order across all words."""
        if not words:
            return []
        gone, merge = self.GONE, self.merges.get
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        start = self.byte_ids[raw]
        start[ends] = gone
        rank = self.first[raw[:-1], raw[1:]]
        rank[ends[:-1]] = rank[ends - 1] = -1
        if lengths[0] == 0:
            rank[0] = -1
        places = np.nonzero(rank >= 0)[0]
        by_rank = places[np.argsort(rank[places], kind="stable")]
        found, begins = np.unique(rank[by_rank], return_index=True)
        index = {r: p.tolist() for r, p in zip(found.tolist(), np.split(by_rank, begins[1:]), strict=True)} if len(found) else {}
        tok, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order = list(index)
        heapq.heapify(order)
        while order:
            r = heapq.heappop(order)
            places = index.pop(r)
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                if merge(tok[i] << 16 | tok[j]) != r:
                    continue  # a neighbour's merge has changed this place
                tok[i], tok[j] = r, gone
                after[i] = nxt = after[j]
                before[nxt] = i  # there is one: the end of the word
                sooner = False
                q = merge(r << 16 | tok[nxt])
                if q is not None:
                    if own := index.get(q):
                        own.append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(order, q)
                    sooner = q < r
                left = before[i]
                if left >= 0 and (q := merge(tok[left] << 16 | r)) is not None:
                    if own := index.get(q):
                        own.append(left)
                    else:
                        index[q] = [left]
                        heapq.heappush(order, q)
                    sooner |= q < r
                if sooner and k + 1 < len(places):  # a merge of an earlier rank came up: it goes first
                    if r in index:
                        index[r] += places[k + 1 :]
                    else:
                        index[r] = places[k + 1 :]
                        heapq.heappush(order, r)
                    break
        left = np.array(tok, np.int64)
        stay = left != gone
        ids, stops = left[stay].astype("<u4").tobytes(), (4 * np.cumsum(stay))[ends].tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [units(t, self.finder) for t in texts]
        for kept in (self.known, self.words):
            if len(kept) > self.kept_units:
                kept.clear()
        known, ids = self.known, self.words
        unseen = list(set().union(*cut).difference(known))
        words = [self.finder(u) for u in unseen]
        new = list(set().union(*words).difference(ids))
        ids.update(zip(new, self.replay([w.encode() for w in new]), strict=True))
        known.update(zip(unseen, [ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for ws in words], strict=True))
        return [b"".join(map(known.__getitem__, us)) for us in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def _encoder(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(path, pattern)


def batches_of(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in blocks of about ``most`` bytes, at least one text each."""
    start, size, block = 0, 0, []
    for i, b in enumerate(column):
        raw = b.as_py()
        if block and size + len(raw) > most:
            yield start, block
            start, size, block = i, 0, []
        block.append(raw.decode("utf-8", "replace"))
        size += len(raw)
    if block:
        yield start, block


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id and ids, the token ids as little-endian unsigned 32-bit integers."""
    return _mapped(docs, id_col, text_col, path, pattern, "doc_id long, ids binary", lambda e, ids: [pa.array(ids, pa.binary())], ["ids"])


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text (binary) of rows with doc_id and ids; null ids are an empty text."""
    import public_tokenizers

    path, pattern = path or public_path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x.as_py() or b"") for x in b.column(1)], pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def _mapped(docs: DataFrame, id_col: str, text_col: str, path: str | None, pattern: str | None, schema: str, columns, names: list[str]) -> DataFrame:
    import public_tokenizers

    path, pattern = path or public_path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, pattern)
        for b in batches:
            for start, texts in batches_of(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), *columns(e, e.encode(texts))], ["doc_id", *names])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes in the task that read the text: neither the ids nor the decoded text are moved."""

    def digests(e: MergeReplay, ids: list[bytes]) -> list[pa.Array]:
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(map(e.decode, ids))]

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _mapped(table(spark, sf_dir, "documents"), "doc_id", "text", None, None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests, names)
