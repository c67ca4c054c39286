"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are the shapes of its words (runs of small and capital letters and digits collapse, all else stays) and a
few coarse terms on length, repetition and lines. Term weights are log frequency times inverse document frequency, the
document frequencies counted over the whole corpus. A truncated SVD of at most ``sample`` labelled rows gives the latent
space; their vectors and labels are broadcast, a bound that is a parameter and not the data's. Every document's vector is
multiplied with all of them, block by block and exactly, and the ``neighbours`` nearest vote, weighted by cosine. Tasks make
the labelled rows' vectors, so what reaches the driver is ``sample`` lists of terms, whatever the texts' lengths.

Ids are no input of a score, so a labelled row of the sample is among its own neighbours and has one vote of 25 on itself;
held-out rows have none.

Defined results: a null or empty text has terms too (its length) and a score like any other; a document with several
labels takes the lowest, and of several texts of one labelled id the one with the smallest hash is learned from; null labels
and null ids aren't learned from; without any label every score is 1; a null id counts as held out; repeated rows are
separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import table

from .common import bounded_batches, crc_mod, id_and_bytes

TERMS, LATENT, SAMPLE, NEIGHBOURS, THRESHOLD = 4096, 48, 6000, 25, 0.3
#: Documents whose cosines are computed at once.
BLOCK = 256
#: Weight of a coarse term against that of one word's shape.
COARSE = 3.0
_CLASSES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"a{2,}|A{2,}|0{2,}")


@lru_cache(100_000)
def _slot(term: bytes) -> int:
    return zlib.crc32(term) % TERMS


def _level(x: float) -> int:
    """0 for 0, else 1 to 9 on a logarithmic scale from a thousandth to 1."""
    return 0 if x <= 0 else 1 + int(max(0, min(8, 8 + np.log(x) / np.log(2.5))))


def terms_of(text: bytes) -> dict[int, float]:
    """Term weights of a text, without document frequencies."""
    words = text.lower().split()
    n = len(words)
    shapes = Counter(_RUNS.sub(lambda m: m[0][:1] + b"+", text.translate(_CLASSES)).split())
    out: dict[int, float] = {}
    for shape, count in shapes.items():
        k = _slot(shape)
        out[k] = out.get(k, 0.0) + count
    out = {k: float(np.log1p(100.0 * c / n)) for k, c in out.items()}
    counts = Counter(words)
    lines = text.split(b"\n")
    coarse = [f"n{int(np.log2(n + 1))}"]
    if n:
        top = counts.most_common(3)
        coarse += [
            f"top{_level(top[0][1] / n if n > 5 else 0)}",
            f"top3{_level(sum(c for _, c in top) / n if n > 9 else 0)}",
            f"again{_level(sum(map(eq, words, words[1:])) / n if n > 5 else 0)}",
            f"distinct{int(np.log2(n + 1))}.{int(8 * len(counts) / n)}",
            f"lines{_level(1 - len(set(lines)) / len(lines))}",
            f"size{int(len(text) / n / 2)}",
            f"capital{_level(sum(c for s, c in shapes.items() if b'A+' in s) / n)}",
            f"plain{int(8 * sum(c for s, c in shapes.items() if s in (b'a', b'a+', b'Aa', b'Aa+', b'A', b'a+,', b'a+.')) / n)}",
        ]
    for c in coarse:
        k = _slot(c.encode())
        out[k] = out.get(k, 0.0) + COARSE
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(TERMS + 1, np.int64), 0
    for b in batches:
        for t in b.column(1):
            df[list(terms_of(t.as_py()))] += 1
            n += 1
    df[TERMS] = n
    used = np.nonzero(df)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used], pa.int64())], ["term", "n"])


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Inverse document frequencies of the terms over all of docs."""
    counts = id_and_bytes(docs, id_col, text_col).mapInArrow(_counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1)
    for r in counts:
        df[r.term] = r.n
    return np.log((df[TERMS] + 1) / (df[:TERMS] + 1)) + 0.1


def vectors(terms: list[dict[int, float]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(terms), TERMS), np.float32)
    for row, found in zip(out, terms, strict=True):
        keys = list(found)
        row[keys] = np.array([found[k] for k in keys]) * idf[keys]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """At most ``sample`` rows (text, label), those of the smallest hash of an id, so that the same rows come at each run."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null AND label is not null")
    given = given.groupBy("doc_id").agg(F.min("label").alias("label")).join(ids, "doc_id", "left_semi")
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [terms_of(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))], ["doc_id", "label", "terms", "weights"])


def train(docs: DataFrame, labelled: DataFrame, latent: int = LATENT) -> dict:
    """The space and the voters. labelled: doc_id, text, label, of a bounded number of rows."""
    made = bounded_batches(labelled).mapInArrow(_termed, "doc_id long, label int, terms array<int>, weights array<double>")
    rows = sorted(made.collect(), key=lambda r: r.doc_id)
    idf = document_frequencies(docs)
    if not rows:
        return {"idf": idf, "space": None}
    x = vectors([dict(zip(r.terms, r.weights, strict=True)) for r in rows], idf)
    rng = np.random.default_rng(7)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((TERMS, latent), dtype=np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    space = (q @ turn.T).astype(np.float32)
    return {"idf": idf, "space": space, "voters": unit(x @ space), "labels": np.array([min(1, max(0, r.label)) for r in rows], np.float32)}


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def votes(v: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of the rows of v: the nearest voters' labels, weighted by cosine."""
    cosines = unit(v @ model["space"]) @ model["voters"].T
    k = min(neighbours, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6)
    return (weight * model["labels"][near]).sum(1) / weight.sum(1)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                found = np.ones(part.num_rows) if m["space"] is None else votes(vectors([terms_of(t.as_py()) for t in part.column(1)], m["idf"]), m)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.float64))], ["doc_id", "score"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(id_col, 5) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    return train(docs, labelled_sample(docs, labels.where(~held_out()), sample))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents whose score is below threshold; all columns stay. Texts are scored where they lie."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                texts = [(t.as_py() or "").encode("utf-8", "replace") for t in part.column(place)]
                keep = np.ones(len(texts), bool) if m["space"] is None else votes(vectors(list(map(terms_of, texts)), m["idf"]), m) >= threshold
                yield part.filter(pa.array(keep))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
