"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word falls back to its character
n-grams, the longest order first: the first order of which the model knows any gram scores it, by the mean of the known
grams' log frequencies. A document's score is the mean over its words, and its probability the softmax of the languages.

Counts cover every training text. They are gathered a partition at a time with map-side sums and added up by a shuffle.
The ``max_words`` words and ``max_grams`` grams of the highest relative frequency are broadcast; relative, so that a language
with few documents is known as well as one with a third of them. The other words and grams stay tables: a task sums up the
words that it has and passes on the rest of each document, whose distinct words are looked up by a join and backed off
where they are unseen, those of their grams that weren't broadcast by another join. Both numbers bound memory and change
no score beyond rounding.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be
learned; a null language or null text isn't learned from; a null id counts as held out of learning; ties between
languages go to the first in order of their names; repeated rows are separate documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .common import bounded_batches, crc_mod, id_and_bytes

MAX_WORDS, MAX_GRAMS, ORDERS = 60_000, 300_000, (4, 3, 2, 1)
#: Distinct words and grams that a task gathers before it sends its sums on.
HELD = 400_000
#: The softmax is over this many times the mean log frequency of a word.
SHARPNESS = 2.0
#: Log frequency of a word of which no gram is known.
FLOOR = -20.0
_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters. Runs of word characters may hold others, such as powers, fractions and marks; they are cut there."""
    runs = _RUNS(text.lower())
    if text.isascii() or all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in ("".join(c if c.isalpha() else " " for c in r)).split()]


def grams_of(word: str, n: int) -> list[str]:
    w = f"_{word}_" if n > 1 else word
    return [w[i : i + n] for i in range(max(1, len(w) - n + 1))]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        lang = [x for x, words in held.items() for _ in words]
        words = [w for words in held.values() for w in words]
        n = [k for words in held.values() for k in words.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", "item", "n"])

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            held.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py().decode("utf-8", "replace")))
            if sum(map(len, held.values())) > HELD:
                yield out()
    if any(held.values()):
        yield out()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, k, g, n) for (lang, k), own in held.items() for g, n in own.items()]
        held.clear()
        lang, k, item, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(k, pa.int32()), pa.array(item), pa.array(n, pa.int64())], ["lang", "k", "item", "n"])

    for b in batches:
        for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for k in ORDERS:
                own = held.setdefault((lang, k), Counter())
                for g in grams_of(word, k):
                    own[g] += n
        if sum(map(len, held.values())) > HELD:
            yield out()
    if any(held.values()):
        yield out()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> dict:
    """The model: languages, words and grams with a log frequency for each language, ``table`` with all words and ``rare`` with the grams beyond ``max_grams``, if any.

    docs are training rows only.
    """
    given = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    words = cut(bounded_batches(given).mapInArrow(_words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "langid-words")
    grams = cut(words.mapInArrow(_grams, "lang string, k int, item string, n long").groupBy("lang", "k", "item").agg(F.sum("n").alias("n")), "langid-grams")
    counts = words.select("lang", F.lit(0).alias("k"), "item", "n").unionByName(grams)
    totals = {(r.lang, r.k): r.n for r in counts.groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    model = {"langs": langs, "words": {}, "grams": {k: {} for k in ORDERS}}
    if not langs:
        return model
    sums = counts.groupBy("lang", "k").agg(F.sum("n").alias("whole"))
    shares = counts.join(F.broadcast(sums), ["lang", "k"]).groupBy("k", "item").agg(F.max(F.col("n") / F.col("whole")).alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    by_word, by_gram = cut(shares.where("k = 0"), "langid-shares"), cut(shares.where("k > 0"), "langid-gram-shares")
    last = None
    for top in (by_word.orderBy(F.desc("share"), "item").limit(max_words), by_gram.orderBy(F.desc("share"), "k", "item").limit(max_grams)):
        for last in top.toLocalIterator():
            scores = [math.log((last.by.get(lang, 0) + 0.5) / (totals[lang, last.k] + 1)) if (lang, last.k) in totals else -25.0 for lang in langs]
            (model["grams"][last.k] if last.k else model["words"])[last.item] = scores
    each = lambda k: [F.log((F.coalesce(F.col("by")[lang], F.lit(0)) + 0.5) / F.lit(totals[lang, k] + 1.0)) if (lang, k) in totals else F.lit(-25.0) for lang in langs]
    listed = lambda k: F.array(*[x.cast("float") for x in each(k)])
    model["table"] = by_word.select("item", listed(0).alias("scores"))
    if sum(map(len, model["grams"].values())) < by_gram.count():
        beyond = F.lit(True)
        if last is not None and last.k:
            beyond = (F.col("share") < last.share) | ((F.col("share") == last.share) & (F.struct("k", "item") > F.struct(F.lit(last.k).alias("k"), F.lit(last.item).alias("item"))))
        model["rare"] = by_gram.where(beyond).select("k", F.col("item").alias("gram"), F.coalesce(*[F.when(F.col("k") == k, listed(k)) for k in ORDERS]).alias("scores"))
    return model


class Scorer:
    """Scores of a task: the model's words and grams as rows of matrices."""

    def __init__(self, model: dict) -> None:
        self.wide = len(model["langs"])
        self.row = {w: i for i, w in enumerate(model["words"])}
        self.matrix = np.array(list(model["words"].values()) or np.zeros((0, self.wide)), np.float32)
        grams = [(k, g, v) for k in ORDERS for g, v in model["grams"][k].items()]
        self.gram = {k: {} for k in ORDERS}
        for i, (k, g, _) in enumerate(grams):
            self.gram[k][g] = i
        self.gram_matrix = np.array([v for *_, v in grams] or np.zeros((0, self.wide)), np.float32)

    def back_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: of each the mean over the known grams of the longest order that has any."""
        hits: list[int] = []
        starts, found, out = [], [], np.full((len(words), self.wide), FLOOR, np.float32)
        for i, w in enumerate(words):
            for k in ORDERS:
                own = self.gram[k]
                if got := [own[g] for g in grams_of(w, k) if g in own]:
                    starts.append(len(hits))
                    found.append(i)
                    hits += got
                    break
        if hits:
            sums = np.add.reduceat(self.gram_matrix[hits], starts, axis=0)
            out[found] = sums / np.diff([*starts, len(hits)])[:, None]
        return out

    def split(self, words: list[str]) -> list[tuple[str, int, str | None, int, np.ndarray | None]]:
        """(word, order, gram, count, scores): of each word and order the known grams in sum, without a gram's name, and each gram that isn't known."""
        out = []
        for w in words:
            for k in ORDERS:
                own, grams = self.gram[k], Counter(grams_of(w, k))
                if hits := [(own[g], n) for g, n in grams.items() if g in own]:
                    rows, n = zip(*hits, strict=True)
                    out.append((w, k, None, sum(n), np.array(n) @ self.gram_matrix[list(rows)]))
                out += [(w, k, g, n, None) for g, n in grams.items() if g not in own]
        return out

    def known(self, text: str) -> tuple[int, np.ndarray, Counter]:
        """How many words text has, the sums over those of the matrix, and the other words."""
        words, get = words_of(text), self.row.get
        rows = [get(w, w) for w in words]
        return len(words), self.matrix[[w for w in rows if w.__class__ is int] or np.zeros(0, int)].sum(axis=0, dtype=np.float64), Counter(w for w in rows if w.__class__ is str)


def _lists(rows: list, width: int, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.array(rows).ravel(), kind))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    given, langs = id_and_bytes(docs, id_col, text_col), model["langs"]
    if not langs:
        return given.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    wide = len(langs)
    sent = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k not in ("table", "rare")})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            if not b.num_rows:
                continue
            n, sums, rest = zip(*(scorer.known(t.as_py().decode("utf-8", "replace")) for t in b.column(2)), strict=True)
            items = pa.StructArray.from_arrays([pa.array([w for x in rest for w in x], pa.string()), pa.array([c for x in rest for c in x.values()], pa.int64())], ["item", "n"])
            ends = pa.array(np.cumsum([0, *map(len, rest)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), _lists(sums, wide, pa.float64()), pa.ListArray.from_arrays(ends, items)], ["row", "doc_id", "n", "sums", "rest"])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            if b.num_rows:
                scores = b.column(1).to_pylist()
                new = [i for i, x in enumerate(scores) if x is None]
                for i, x in zip(new, scorer.back_off(b.column(0).take(pa.array(new, pa.int64())).to_pylist()), strict=True):
                    scores[i] = x
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(scores, wide, pa.float32())], ["item", "scores"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            if rows := scorer.split(b.column(0).to_pylist()):
                item, k, gram, n, sums = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((item, k, gram, n, sums), kinds, strict=True)], ["item", "k", "gram", "n", "sums"])

    def backed_off(unseen: DataFrame) -> DataFrame:
        """item and scores of words that the model doesn't know, where some grams are in the table of rare ones only."""
        parts = cut(unseen.select("item").mapInArrow(split, "item string, k int, gram string, n long, sums array<double>"), "langid-split")
        rare = parts.where("gram IS NOT NULL").drop("sums").join(model["rare"], ["k", "gram"]).select("item", "k", "n", F.transform("scores", lambda v: v * F.col("n")).alias("sums"))
        both = parts.where("gram IS NULL").select("item", "k", "n", "sums").unionByName(rare)
        order = both.groupBy("item", "k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(wide)]).alias("sums"))
        longest = order.groupBy("item").agg(F.max_by(F.transform("sums", lambda v: (v / F.col("n")).cast("float")), "k").alias("scores"))
        return unseen.select("item").join(longest, "item", "left").select("item", F.coalesce("scores", F.array(*[F.lit(FLOOR).cast("float")] * wide)).alias("scores"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.column(1).to_numpy()
                mean = np.column_stack([b.column(2 + i).to_numpy() for i in range(wide)]) / np.maximum(n, 1)[:, None]
                p = np.exp(SHARPNESS * (mean - mean.max(axis=1, keepdims=True)))
                top = mean.argmax(axis=1)
                score = np.where(n > 0, p[np.arange(len(n)), top] / p.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([langs[i] if k else "und" for i, k in zip(top, n, strict=True)], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    numbered = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = cut(numbered.mapInArrow(known, "row long, doc_id long, n long, sums array<double>, rest array<struct<item:string,n:long>>"), "langid-known")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.item", "r.n")
    found = rest.select("item").distinct().join(model["table"], "item", "left")
    if "rare" in model:
        found = cut(found.select("item", "scores"), "langid-found")
        found = found.where("scores IS NOT NULL").unionByName(backed_off(found.where("scores IS NULL")))
    scored = cut(found.select("item", "scores").mapInArrow(looked_up, "item string, scores array<float>"), "langid-scores")
    more = rest.join(scored, "item").groupBy("row").agg(*[F.sum(F.col("n") * F.col("scores")[i].cast("double")).alias(f"s{i}") for i in range(wide)])
    whole = rows.join(cut(more, "langid-more"), "row", "left")
    totals = whole.select("doc_id", "n", *[(F.col("sums")[i] + F.coalesce(f"s{i}", F.lit(0.0))).alias(f"t{i}") for i in range(wide)])
    return totals.mapInArrow(best, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(id_col, 3) == 1, F.lit(True))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
