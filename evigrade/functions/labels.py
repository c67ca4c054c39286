"""Labels and filters of a variant as column expressions. Missing values are null and never pass a test by being missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Review status by number of stars, from none to three; the first of a level stands for its number.
STATUSES = (
    ("no assertion criteria provided", "no assertion provided", "no interpretation for the single variant", "no classification provided", "-"),
    ("criteria provided, single submitter", "criteria provided, conflicting interpretations", "criteria provided, conflicting classifications"),
    ("criteria provided, multiple submitters, no conflicts",),
    ("reviewed by expert panel",),
)
#: Significances of the two classes and of those in between.
PATHOGENIC, BENIGN, UNCERTAIN = ("Pathogenic", "Likely pathogenic", "Pathogenic/Likely pathogenic"), ("Benign", "Likely benign", "Benign/Likely benign"), ("Uncertain significance",)
#: Calls by their normalised text, and those that determine nothing.
CALLS = {"normal": "Normal", "abnormal": "Abnormal", "not specified": "Indeterminate"}
INDETERMINATE = ("NOT SPECIFIED", "INDETERMINATE", "IGNORE")


def consequence_flags(consequence: Column, ref: Column, alt: Column) -> dict[str, Column]:
    low, no = F.lower(consequence), F.lit(False)
    return {
        "is_synonymous": F.coalesce((low == "synonymous") | (consequence == "synonymous_variant"), no),
        "is_missense": F.coalesce((low == "missense") | (consequence == "missense_variant"), no),
        "is_snv": F.coalesce((F.length(ref) == 1) & (F.length(alt) == 1) & (ref != alt), no),
    }


def is_coding_change(ref: Column, alt: Column, protein: Column, aa_ref: Column, aa_alt: Column) -> Column:
    """One base on both sides, and a changed residue or none known."""
    return F.coalesce((F.length(ref) == 1) & (F.length(alt) == 1) & (protein.isNull() | ~aa_ref.eqNullSafe(aa_alt)), F.lit(False))


def review_status(value: Column) -> Column:
    """A number of stars as its review status; a text stays, and so does a number that no status has."""
    n = value.try_cast("double")
    return F.coalesce(F.get(F.array(*[F.lit(s[0]) for s in STATUSES]), F.when((n > -1) & (n < len(STATUSES)), n.cast("int"))), value)


def has_stars(status: Column, least: int) -> Column:
    """Whether a review status has at least so many stars; a missing one has none, one that isn't listed has all."""
    below = [s for level in STATUSES[:least] for s in level]
    return F.lit(True) if not below else F.coalesce(~status.isin(below), F.lit(False))


def significance_flags(sig: Column, status: Column, sig_now: Column, status_now: Column, least: int) -> dict[str, Column]:
    """Classes by significance at sufficient quality; the uncertain class always goes by the present release."""
    no = F.lit(False)
    return {
        "is_pathogenic": F.coalesce(has_stars(status, least) & sig.isin(*PATHOGENIC), no), "is_benign": F.coalesce(has_stars(status, least) & sig.isin(*BENIGN), no),
        "is_conflicting": F.coalesce(sig == "Conflicting classifications of pathogenicity", no), "is_vus": F.coalesce(has_stars(status_now, least) & sig_now.isin(*UNCERTAIN), no),
    }


def is_seen(frequency: Column) -> Column:
    return F.coalesce(frequency.isNotNull() & ~F.isnan(frequency), F.lit(False))


def population_rules(seen: Column, snv: Column, missense: Column) -> dict[str, Column]:
    """Membership of the population by its type; that of all changes in coding bases takes any single base, as it is in use."""
    return {"all_variants": F.lit(True), "all_nsSNV": snv, "all_missense_nsSNV": missense & snv, "gnomAD": seen, "gnomAD_nsSNV": seen & snv, "gnomAD_missense_nsSNV": seen & snv & missense}


def regularisation_rules(snv: Column, coding: Column, missense: Column) -> dict[str, Column]:
    return {"all_assayed": F.lit(True), "all_snv": snv, "all_nsSNV": coding, "all_missense_snv": missense & snv}


def standard_class(c: Column) -> Column:
    """Capitalised; a text that says missing is Indeterminate."""
    return F.when(F.lower(F.trim(c)).isin("nan", "not specified"), "Indeterminate").otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000))))


def interval_list(pairs: list[tuple[Column, Column]]) -> Column:
    """Array of (lo, hi, lo_closed, hi_closed, class) of the texts that are intervals, in order; bounds may be infinite."""
    pattern = r"^\s*([\[(])\s*([^,]+?)\s*,\s*([^\])]+?)\s*([\])])\s*$"
    part = lambda t, i: F.regexp_extract(t, pattern, i)

    def bound(text: Column) -> Column:
        low = F.lower(F.ltrim(text, F.lit("+")))
        return F.when(low.isin("inf", "infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(text.try_cast("double"))

    made = [F.struct(bound(part(t, 2)).alias("lo"), bound(part(t, 3)).alias("hi"), (part(t, 1) == "[").alias("lo_closed"), (part(t, 4) == "]").alias("hi_closed"), c.alias("class")) for t, c in pairs]
    return F.filter(F.array(*made), lambda x: x["lo"].isNotNull() & x["hi"].isNotNull())


def call_by_intervals(score: Column, intervals: Column) -> Column:
    """Call of the first interval that holds score; Indeterminate where none does or its class isn't a call."""
    inside = F.filter(intervals, lambda x: ((score > x["lo"]) | (x["lo_closed"] & (score == x["lo"]))) & ((score < x["hi"]) | (x["hi_closed"] & (score == x["hi"]))))
    calls = F.create_map(*[F.lit(x) for pair in CALLS.items() for x in pair])
    return F.coalesce(calls[F.lower(F.trim(F.get(inside, F.lit(0))["class"]))], F.lit("Indeterminate"))


def author_call(standard: Column, has_standard: Column, is_mapped: Column, mapped: Column, reported: Column, score: Column, intervals: Column) -> Column:
    """The author's call.

    Where the table has a standard class, that class decides, and a missing one is Indeterminate. Else, in a dataset that has a
    map of reported classes, the map decides, then the normalised text, then the intervals; in any other dataset the
    intervals decide at once. Without a score or an interval the call is Indeterminate.
    """
    calls, unknown = F.create_map(*[F.lit(x) for pair in CALLS.items() for x in pair]), F.lit("Indeterminate")
    by_interval = F.when(score.isNotNull() & (F.size(intervals) > 0), call_by_intervals(score, intervals))
    by_text = F.when(is_mapped & reported.isNotNull(), F.coalesce(mapped, calls[F.lower(F.trim(reported))]))
    return F.when(has_standard, F.coalesce(standard_class(standard), unknown)).otherwise(F.coalesce(by_text, by_interval, unknown))


def in_sample(sample: Column, category: str) -> Column:
    """Whether a list with bars holds the category."""
    return F.coalesce(F.array_contains(F.split(sample, r"\|"), category), F.lit(False))


def determinate(call: Column) -> Column:
    """The call in capitals where it determines anything, else null."""
    return F.when(~F.upper(call).isin(*INDETERMINATE), F.upper(call))


def code_of_call(call: Column) -> Column:
    return F.when(F.upper(call) == "NORMAL", 0).when(F.upper(call) == "ABNORMAL", 2).otherwise(1)
