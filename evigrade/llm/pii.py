"""Personal data by weak supervision, in DataFrame functions only.

Candidates are found by patterns: the four base kinds, and looser ones (numbers written like telephone or card numbers,
addresses spelled out with "at" and "dot", long keys). Five labelers look at each and vote for, against or not at all: two
on its form (regex), one on words of a gazetteer just before it, two on its context. Votes are counted by pattern of votes,
a table whose size is bounded by the labelers and not by the data; expectation-maximisation over those counts estimates
each labeler's reliability and each pattern's probability, and a logistic span classifier is trained on these as soft labels.
It decides on the looser candidates. Base spans always stay.

Positions come from splitting a text by the pattern that found the matches: gaps and matches alternate, so their lengths
add up to every start and end. Patterns are possessive and anchored at the edges of their runs, so that a text of one
enormous word or number is scanned once.

Defined results: a null text is empty; a text without spans has the digest of the empty string; matches of one kind never
overlap, those of different kinds may; a null id and repeated rows are rows like any other; an empty table gives no rows,
and a corpus without candidates trains nothing and adds nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .common import id_and_text

#: Base kinds in the order of the contract, with their patterns. Possessive, equal in what they match to the plain forms:
#: no quantifier here could give anything back and still match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be worth its scan.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Looser candidates, by the kind that they would be.
LOOSE = {
    "email_text": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|[ ]at[ ]) ?[a-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|[ ]dot[ ]) ?[a-z0-9-]{1,63}+){1,4}",
    "phone_text": r"(?<![0-9.+() -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "card_text": r"(?<![0-9A-Za-z.-])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+",
}
LOOSE_HINT = {
    "email_text": r"(?i)(?:[ \[(])dot[ \])]",
    "phone_text": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "card_text": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "secret": r"(?=[a-zA-Z+/_-]{0,40}[0-9])[A-Za-z0-9+/_-]{24}",
}
KINDS = (*BASE, *LOOSE)
#: Gazetteer: words that stand before personal data, whatever its kind.
GAZETTEER = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|reach|write|card|visa|account|iban|token|secret|key|password|passwd|bearer|auth|address)\W{0,4}\w{0,3}\W{0,4}$"
#: Context that speaks against: versions, sections, prices, measures, paths and markup.
AGAINST = r"(?i)(?:version|v\.|section|sec\.|fig\.|figure|table|page|isbn|doi|no\.|[$€£#/\\]|https?:|www\.)\W{0,3}$"
LABELERS = ("form", "strict", "gazetteer", "before", "after")
#: Code points of context that labelers see.
CONTEXT = 24
ROUNDS, PRIOR = 60, 0.5


#: Elements that one step of a fold appends. An array grows by copying it, so the elements of so many items are gathered by
#: themselves and the blocks flattened: the work on a text with very many matches stays in proportion to them.
FOLD = 64
#: Matches from the arrays f (what matched) and g (the gaps around): s and e in code points, e exclusive, and the context in the gaps beside.
_MATCHES = """
CASE WHEN size(f) > 0 THEN aggregate(
  transform(sequence(0, CAST(floor((size(f) - 1) / {fold}) AS INT)),
    i -> arrays_zip(slice(f, i * {fold} + 1, {fold}), slice(g, i * {fold} + 1, size(slice(f, i * {fold} + 1, {fold}))), slice(g, i * {fold} + 2, size(slice(f, i * {fold} + 1, {fold}))))),
  named_struct('at', 0, 'out', CAST(array() AS array<{kind}>)),
  (acc, part) -> named_struct(
    'at', aggregate(part, acc.at, (at, x) -> at + length(x['0']) + length(x['1'])),
    'out', concat(acc.out, array(aggregate(part, named_struct('at', acc.at, 'out', CAST(array() AS {kind})),
      (a, x) -> named_struct('at', a.at + length(x['0']) + length(x['1']), 'out', concat(a.out, array(named_struct(
        's', a.at + length(x['1']), 'e', a.at + length(x['1']) + length(x['0']), 'm', x['0'], 'before', substring(x['1'], -{context}, {context}), 'after', substring(x['2'], 1, 2))))),
      a -> a.out)))),
  acc -> flatten(acc.out)) ELSE CAST(array() AS {kind}) END"""


def matches(rows: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with an array of the leftmost non-overlapping matches for each kind of patterns, a pattern and its hint by kind, in the column of that name."""
    hit = {k: F.when(hinted(F.col(text), hint), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (p, hint) in patterns.items()}
    found = rows.withColumns({f"f_{k}": c for k, c in hit.items()})
    split = found.withColumns({f"g_{k}": F.when(F.size(f"f_{k}") > 0, F.split(text, p, -1)) for k, (p, _) in patterns.items()})
    fold = _MATCHES.format(fold=FOLD, context=CONTEXT, kind="array<struct<s:int,e:int,m:string,before:string,after:string>>")
    named = lambda k: re.sub(r"\b([fg])(?=[,)])", rf"\1_{k}", fold)
    return split.withColumns({k: F.expr(named(k)) for k in patterns}).drop(*[f"{x}_{k}" for x in "fg" for k in patterns])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    n = F.length(digits(m))
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def hinted(text: Column, hint: str) -> Column:
    return F.contains(text, F.lit(hint)) if len(hint) == 1 else F.rlike(text, F.lit(hint))


def candidates(rows: DataFrame, text: str) -> DataFrame:
    """rows with base (array of k, s, e and a vote of each labeler) and loose, the same for looser candidates that touch no base span.

    text names a column without nulls; columns of rows must not be named as kinds are.
    """
    patterns = {k: (p, HINT[k]) for k, p in BASE.items()} | {k: (p, LOOSE_HINT[k]) for k, p in LOOSE.items()}

    def voted(kind: str) -> Column:
        return F.transform(F.filter(kind, lambda x: (valid if kind in BASE else _plausible)(kind, x["m"])), lambda x: _voted(x, kind))

    found = matches(rows, text, patterns).withColumns({"base": F.concat(*map(voted, BASE)), "loose": F.concat(*map(voted, LOOSE))}).drop(*patterns)
    apart = F.expr("filter(loose, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e))")
    return found.withColumn("loose", F.when((F.size("loose") > 0) & (F.size("base") > 0), apart).otherwise(F.col("loose")))


def _plausible(kind: str, m: Column) -> Column:
    return F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]")) if kind == "secret" else F.lit(True)


def _voted(x: Column, kind: str) -> Column:
    m, n = x["m"], F.length(digits(x["m"]))
    before, after = x["before"], x["after"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    hexed = F.rlike(m, F.lit("^[0-9a-fA-F]{32,}$"))
    mixed = F.length(F.regexp_replace(m, "[^0-9]", "")) * 6 >= F.length(m)
    form = {
        "email": vote(F.rlike(m, F.lit(r"\.[A-Za-z]{2,}$")), F.lit(True)), "ip": vote(~F.rlike(m, F.lit(r"^0|\.0[0-9]")), F.lit(True)),
        "card": vote(n.isin(13, 14, 15, 16, 19), F.lit(True)), "phone": vote(n.between(10, 13), never),
        "email_text": vote(F.rlike(m, F.lit(r"(?i)dot\W{1,2}(?:com|org|net|edu|io|de|fr|es|uk)$")), F.lit(True)), "phone_text": vote(F.rlike(m, F.lit(r"^\(?[2-9]")), F.lit(True)),
        "card_text": vote(F.rlike(m, F.lit("^[3-6]")), F.lit(True)), "secret": vote(hexed | mixed, ~mixed),
    }[kind]
    strict = {
        "card_text": vote(F.call_function("luhn_check", digits(m)), F.lit(True)), "secret": vote(hexed, never), "email_text": vote(F.rlike(m, F.lit(r"[\[(]")), never),
        "phone_text": vote(F.rlike(m, F.lit(r"^\(|-")), never), "email": vote(F.rlike(m, F.lit(r"[A-Za-z0-9]@")), F.lit(True)), "ip": vote(F.lit(True), never),
        "card": vote(F.lit(True), never), "phone": vote(F.rlike(m, F.lit(r"[() -]")), never),
    }[kind]
    votes = (form, strict, vote(F.rlike(before, F.lit(GAZETTEER)), never), vote(F.rlike(before, F.lit(r"(?:^|[\s\"'=:(<,;|])$")), F.rlike(before, F.lit(AGAINST)) | F.rlike(before, F.lit(r"[\w/]$"))), vote(F.rlike(after, F.lit(r"^(?:$|[\s\"'),.;:>|!?])")), F.rlike(after, F.lit(r"^[\w%/]"))))
    return F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), *[v.cast("int").alias(name) for v, name in zip(votes, LABELERS, strict=True)])


def vote_counts(found: DataFrame) -> list:
    """Counts by kind and pattern of votes: at most len(KINDS) * 3 ** len(LABELERS) rows, whatever the corpus."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.k", *[f"x.{v}" for v in LABELERS])
    return each.groupBy("k", *LABELERS).count().collect()


def reliabilities(counts: list) -> tuple[dict, dict]:
    """Expectation-maximisation over patterns: each labeler's chances to vote 1, 0 or -1 on personal data and on other, and each pattern's probability.

    Labelers begin better than chance, which settles which of the two classes is personal data.
    """
    chance = {v: {1: [0.2, 0.6], 0: [0.4, 0.3], -1: [0.4, 0.1]} for v in LABELERS}
    rows = [(tuple(r[v] for v in LABELERS), r["count"]) for r in counts]
    prior, belief = PRIOR, {}
    for _ in range(ROUNDS):
        for votes, _n in rows:
            like = [1 - prior, prior]
            for v, x in zip(LABELERS, votes, strict=True):
                like = [p * c for p, c in zip(like, chance[v][x], strict=True)]
            belief[votes] = like[1] / (like[0] + like[1])
        mass = [sum(n * (1 - belief[v]) for v, n in rows) + 1, sum(n * belief[v] for v, n in rows) + 1]
        prior = min(0.95, max(0.05, mass[1] / (mass[0] + mass[1])))
        for i, v in enumerate(LABELERS):
            for x in (1, 0, -1):
                got = [sum(n * (1 - belief[u]) for u, n in rows if u[i] == x) + 0.5, sum(n * belief[u] for u, n in rows if u[i] == x) + 0.5]
                # Never surer than nineteen in twenty: labelers aren't independent.
                chance[v][x] = [min(0.95, max(0.05, g / m)) for g, m in zip(got, mass, strict=True)]
    return chance, belief


def train(counts: list, rounds: int = 400, rate: float = 0.5) -> dict:
    """Weights of the span classifier: a bias by kind and a weight by labeler, fitted to the patterns' probabilities."""
    _, belief = reliabilities(counts)
    weights = {("bias", ""): 0.0, **{(v, ""): 0.0 for v in LABELERS}, **{("kind", k): 0.0 for k in KINDS}}
    total = sum(r["count"] for r in counts) or 1
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for r in counts:
            votes = tuple(r[v] for v in LABELERS)
            z = weights["bias", ""] + weights["kind", r["k"]] + sum(weights[v, ""] * x for v, x in zip(LABELERS, votes, strict=True))
            miss = (belief[votes] - 1 / (1 + math.exp(-z))) * r["count"] / total
            slope["bias", ""] += miss
            slope["kind", r["k"]] += miss
            for v, x in zip(LABELERS, votes, strict=True):
                slope[v, ""] += miss * x
        for key in weights:
            weights[key] += rate * (slope[key] - 0.001 * weights[key])
    return weights


def accepted(x: Column, weights: dict) -> Column:
    """Whether the classifier takes the candidate x for personal data."""
    z = F.lit(weights["bias", ""])
    for k in LOOSE:
        z = z + F.when(x["k"] == k, F.lit(weights["kind", k])).otherwise(0.0)
    for v in LABELERS:
        z = z + F.lit(weights[v, ""]) * x[v]
    return z >= 0


def chosen(weights: dict) -> tuple[Column, Column]:
    """base and added, arrays of (s, o, e, k) sorted by start and order of kind, from the columns base and loose."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    plain = lambda x: F.struct(x["s"].alias("s"), order[x["k"]].alias("o"), x["e"].alias("e"), F.split_part(x["k"], F.lit("_"), F.lit(1)).alias("k"))
    return F.array_sort(F.transform("base", plain)), F.array_sort(F.transform(F.filter("loose", lambda x: accepted(x, weights)), plain))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and added, arrays of (s, o, e, k) sorted by start and order of kind."""
    found = cut(candidates(id_and_text(docs, id_col, text_col), "text").drop("text"), "pii-candidates")
    base, added = chosen(train(vote_counts(found)))
    return found.select("doc_id", base.alias("base"), added.alias("added"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


#: text with its sorted spans replaced by their kinds in brackets; overlapping spans go under the first one's kind. Each
#: block of spans is cut out of its own stretch of text, so that a long text isn't counted through for every span.
_REPLACED = """
CASE WHEN size(spans) > 0 THEN aggregate(
  transform(sequence(0, CAST(floor((size(spans) - 1) / {fold}) AS INT)), i -> slice(spans, i * {fold} + 1, {fold})),
  named_struct('at', 0, 'out', CAST(array() AS array<string>)),
  (acc, part) -> named_struct(
    'at', greatest(acc.at, array_max(transform(part, x -> x.e))),
    'out', concat(acc.out, array(aggregate(part, named_struct('at', 0, 'out', CAST(array() AS array<string>), 'own', substring(text, acc.at + 1, greatest(acc.at, array_max(transform(part, x -> x.e))) - acc.at)),
      (a, x) -> named_struct('at', greatest(a.at, x.e - acc.at),
        'out', CASE WHEN x.s - acc.at >= a.at THEN concat(a.out, array(concat(substring(a.own, a.at + 1, x.s - acc.at - a.at), '[', upper(x.k), ']'))) ELSE a.out END, 'own', a.own),
      a -> array_join(a.out, ''))))),
  acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1))) ELSE text END"""


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; a null text stays null.

    One pass counts the votes and one replaces, each where the texts lie, so no row needs a name and nothing is joined.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, t = docs.toDF(*names), F.col(names[docs.columns.index(text_col)])
    found = candidates(own.withColumn("text", F.coalesce(t.cast("string"), F.lit(""))), "text")
    base, added = chosen(train(vote_counts(found)))
    clean = found.withColumn("spans", F.array_sort(F.concat(base, added)))
    clean = clean.withColumn("clean", F.when(t.isNotNull(), F.expr(_REPLACED.format(fold=FOLD))))
    return clean.select(*[(F.col("clean") if c == text_col else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _of_kind(kind: str):
    return lambda x: x["k"] == kind


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))
