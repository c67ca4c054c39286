"""Quality rules by weak supervision, in DataFrame functions only.

Nine rules look at a text's counts (words, symbols, lines, repeats, capitals, word shapes) and vote for it, against it or
not at all; a rule abstains where its count says little. Votes are counted by pattern of votes, a table bounded by the
rules and not by the data, and expectation-maximisation over those counts estimates how often each rule votes for good
and for poor texts. The posterior probability of a good text replaces a filter that every rule must pass. Texts that
fail the base test go whatever the rules say, and they teach nothing.

Everything is computed in the row: windows of three words are hashed to 64 bits, and only a text that has a window twice
sorts them, so the work is n log n in a text's words and nothing is shuffled but the counts of patterns.

Defined results: a null text has no words and fails; a text without words has ratios of 0; a text of fewer than three
words has no window; ties and repeated rows are judged alike; an empty table gives no rows and trains nothing; a null id
stays null; extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .common import id_and_text
from .exact_dedup import normalised

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT = 50, 50
#: The posterior from which a text is kept.
KEEP = 0.5
#: Rules: the measure, the bound from which it votes against, the bound from which it votes for, and the least size to vote at all.
#: Where the first bound is above the second one a high measure is bad, else a low one.
RULES = {
    "symbols": ("n_symbols / n_words", 0.10, 0.02, "n_words >= 5"),
    "shouting": ("n_capitals / n_letters", 0.30, 0.12, "n_letters >= 20"),
    "exclaiming": ("n_marks / n_words", 0.15, 0.05, "n_words >= 5"),
    "lines": ("n_dup_lines / n_lines", 0.30, 0.10, "n_lines >= 3"),
    "repeats": ("n_repeat_words / n_words", 0.20, 0.10, "n_words >= 20"),
    "variety": ("n_distinct / n_words", 0.08, 0.20, "n_words >= 20"),
    "short_words": ("word_chars / n_words", 2.5, 3.2, "n_words >= 5"),
    "long_words": ("word_chars / n_words", 14.0, 10.5, "n_words >= 5"),
    "plain_words": ("n_plain / n_words", 0.50, 0.80, "n_words >= 5"),
}
#: Distinct words are counted in blocks of this many and added up, since their share falls with a text's length.
VARIETY_BLOCK = 1000
ROUNDS, PRIOR = 100, 0.8
#: Chances to vote for a good and for a poor text, where estimation begins and how near to 0 and 1 it may come.
BEGIN, EDGE = (0.95, 0.6), 0.01


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that rules look at, one row per row of docs, as longs."""
    text, words, windows = F.col("text"), F.col("words"), F.col("windows")
    split = id_and_text(docs, id_col, text_col).select("doc_id", "text", F.array_remove(F.split("text", SPACES), "").alias("words"), F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("rows"))
    window = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    wide = split.withColumn("windows", window)
    # The places of windows that come twice or more, in order: neighbours in the sorted array that are equal.
    placed = F.when(F.size(windows) > F.size(F.array_distinct(windows)), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    wide = wide.withColumn("placed", placed)
    same = lambda x, i, step: F.coalesce(F.get("placed", i + step)["h"] == x["h"], F.lit(False))
    twice = F.filter("placed", lambda x, i: same(x, i, -1) | same(x, i, 1))
    wide = wide.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x["at"])))
    # A window covers three words, but for those that the next one covers too.
    covered = F.aggregate("twice", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, at: F.struct(at.alias("last"), (a["n"] + F.least(F.lit(3), at - a["last"])).alias("n")), lambda a: a["n"])

    blocks = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(VARIETY_BLOCK))
    distinct = F.aggregate(blocks, F.lit(0), lambda n, at: n + F.size(F.array_distinct(F.slice("words", at, VARIETY_BLOCK))))

    def chars(pattern: str) -> Column:
        """Characters that pattern, a class, doesn't exclude."""
        return F.length(F.regexp_replace(text, pattern, ""))

    counts = {
        "n_words": F.size(words), "word_chars": F.length(normalised(text)), "n_symbols": chars(r"[^#*$%&|<>]+"), "n_dup_lines": F.size("rows") - F.size(F.array_distinct("rows")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_lines": F.size("rows"), "n_distinct": distinct, "n_capitals": chars(r"\P{Lu}+"), "n_letters": chars(r"\P{L}+"),
        "n_marks": chars(r"[^!?]+"), "n_plain": F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{L}+[.,;:]?$")))),
    }
    return wide.select("doc_id", *[c.cast("long").alias(name) for name, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def votes() -> list[Column]:
    """A vote of each rule: 1 for, -1 against, 0 where it abstains."""
    out = []
    for name, (measure, against, favour, enough) in RULES.items():
        top, _, bottom = measure.partition(" / ")
        ratio = F.expr(f"CASE WHEN {bottom} > 0 THEN {top} / {bottom} ELSE 0.0 END")
        bad, good = (ratio >= against, ratio <= favour) if against > favour else (ratio <= against, ratio >= favour)
        out.append(F.when(~F.expr(enough), 0).when(bad, -1).when(good, 1).otherwise(0).alias(name))
    return out


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The share of good texts and, per rule, its chances to vote for a good and for a poor text.

    patterns: one row a pattern, one column a rule, of 1, 0 and -1; an abstention carries no information.
    """
    for_it, against = (patterns == 1).astype(float), (patterns == -1).astype(float)
    prior, chance = PRIOR, np.tile(np.array(BEGIN), (patterns.shape[1], 1))
    for _ in range(rounds if counts.sum() else 0):
        good = posterior(for_it, against, prior, chance)
        mass = counts * good, counts * (1 - good)
        prior = float(np.clip(mass[0].sum() / counts.sum(), 0.05, 0.99))
        for k, m in enumerate(mass):
            yes, no = m @ for_it, m @ against
            # One imagined vote each as the rules began.
            chance[:, k] = np.clip((yes + BEGIN[k]) / (yes + no + 1), EDGE, 1 - EDGE)
    return prior, chance


def posterior(for_it: np.ndarray, against: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    good, poor = (np.log(p) + for_it @ np.log(chance[:, k]) + against @ np.log(1 - chance[:, k]) for k, p in enumerate((prior, 1 - prior)))
    return 1 / (1 + np.exp(poor - good))


def trained(voted: DataFrame) -> tuple[float, np.ndarray]:
    """As estimated, on the votes of the rows that pass the base test: at most 3 to the number of rules patterns come to the driver."""
    rows = voted.where(~F.col("base_failed")).groupBy(*RULES).count().collect()
    patterns = np.array([[r[name] for name in RULES] for r in rows], dtype=float).reshape(-1, len(RULES))
    return estimated(patterns, np.array([r["count"] for r in rows], dtype=float))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, a vote of each rule, posterior and kept."""
    counted = measured(docs, id_col, text_col)
    voted = cut(counted.select("*", base_failed().alias("base_failed"), *votes()), "quality-votes")
    prior, chance = trained(voted)
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for name, (good, poor) in zip(RULES, chance.tolist(), strict=True):
        odds = odds + F.when(F.col(name) == 1, float(np.log(good / poor))).when(F.col(name) == -1, float(np.log((1 - good) / (1 - poor)))).otherwise(0.0)
    scored = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return judged(table(spark, sf_dir, "documents")).select(*columns)

