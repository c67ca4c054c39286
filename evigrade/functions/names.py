"""Identifiers and coded lists as column expressions: variants, datasets, conditions, codes. A missing part gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales that a file name may carry as one token, and benign references that may follow the components.
SCALES, REFERENCES = ("tavtigian", "piecewise", "continuous"), ("avg", "benign", "synonymous")
#: Codes of functional evidence, by the criterion.
FUNCTIONAL = r"^[PB]S3(?:_Supporting|_Moderate|_Strong|_Very)?$"
#: Strength of a criterion by its kind; a suffix names another strength.
STRENGTHS = {"PVS": "Very", "PS": "Strong", "PM": "Moderate", "PP": "Supporting", "BS": "Strong", "BP": "Supporting"}
CODE = r"^(PVS|PS|PM|PP|BS|BP)([0-9])(?:_(Supporting|Moderate|Strong|Very))?$"
CODES_OF_KIND = {"PVS": 1, "PS": 4, "PM": 6, "PP": 5, "BS": 4, "BP": 7}


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def caret_list(text: Column) -> Column:
    """Values between carets; a missing text is one missing value."""
    return F.coalesce(F.split(text, r"\^"), F.array(F.lit(None).cast("string")))


def clean_significances(text: Column) -> Column:
    """Each value of a caret list up to its first semicolon."""
    return F.transform(caret_list(text), lambda x: F.substring_index(x, ";", 1))


def last_alleles(names: Column) -> tuple[Column, Column]:
    """Reference and alternate base at the end of the first name of a list with bars."""
    first = F.substring_index(names, "|", 1)
    return _part(first, "([ACGT])>([ACGT])$", 1), _part(first, "([ACGT])>([ACGT])$", 2)


def coding_name(variant_id: Column) -> Column:
    """The transcript and coding change at the end of an id."""
    return _part(variant_id, r"(N[MR]_[0-9]+\.[0-9]+:c\..*)$", 1)


def variant_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


def physical_key(variant: Column, gene: Column, level: Column, aa_ref: Column, aa_pos: Column, aa_alt: Column) -> Column:
    """Identity of a variant whatever the assay: its residue change on the protein level, else what follows the last mention of the gene."""
    marker = F.concat(F.lit("_"), gene, F.lit("_"))
    protein = (level == "aa") & aa_ref.isNotNull() & aa_pos.isNotNull() & aa_alt.isNotNull()
    tail = F.concat(gene, F.lit("_"), F.call_function("substring_index", variant, marker, F.lit(-1)))
    return F.when(protein, F.concat(gene, F.lit("_aa_"), aa_ref, aa_pos.cast("string"), aa_alt)).when(F.contains(variant, marker), tail).otherwise(variant)


def genomic_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """chrom:pos:ref:alt, null if any is missing or the position isn't a number."""
    return F.concat(chrom, F.lit(":"), pos.try_cast("double").cast("long").cast("string"), F.lit(":"), ref, F.lit(":"), alt)


def gene_of(dataset: Column) -> Column:
    """Text before the first underscore; a dataset of three genes has a name of its own."""
    return F.when(F.startswith(dataset, F.lit("CALM1_CALM2_CALM3")), "CALM1/2/3").otherwise(F.substring_index(dataset, "_", 1))


def year_of(dataset: Column) -> Column:
    """The first token that is a year; null for what is unpublished."""
    return F.when(~F.array_contains(F.split(dataset, "_"), "unpublished"), _part(dataset, "(?:^|_)((?:19|20)[0-9]{2})(?:_|$)", 1))


def author_of(dataset: Column) -> Column:
    """The token before the year."""
    name = _part(dataset, "^(?:.*?_)?([^_]*)_(?:19|20)[0-9]{2}(?:_|$)", 1)
    three = F.startswith(dataset, F.lit("CALM1_CALM2_CALM3"))
    return F.when(~F.array_contains(F.split(dataset, "_"), "unpublished"), F.concat(F.when(three, "Weile").otherwise(name), F.lit(" et al.")))


def condition_of(name: Column) -> dict[str, Column]:
    """Dataset, kind, level and seed of a robustness condition: fewer controls (ds), swapped labels (disc) or the control."""
    pattern = r"^(.+)_(?:ds([0-9]+)|disc([0-9]+\.[0-9]+))_s([0-9]+)(?:_clinvar_2018)?$"
    control = _part(name, "^(.+)_control(?:_clinvar_2018)?$", 1)
    base, n, share, seed = (_part(name, pattern, i) for i in (1, 2, 3, 4))
    plain = base.isNull() & control.isNotNull()
    return {
        "base": F.coalesce(base, control), "kind": F.when(n.isNotNull(), "downsample").when(share.isNotNull(), "discordance").when(plain, "control"),
        "level": F.coalesce(n, share, F.when(plain, "0")).cast("double"), "seed": F.coalesce(seed, F.when(plain, "0")).cast("long"),
    }


def stem_parts(stem: Column, suffix: str) -> dict[str, Column]:
    """Dataset, scale and component of an output file's stem."""
    pattern = rf"^(.+?)(?:_({'|'.join(SCALES)}))?_([0-9]+c(?:_(?:{'|'.join(REFERENCES)}))?){suffix}$"
    dataset = _part(stem, pattern, 1)
    return {"dataset": dataset, "method": F.when(dataset.isNotNull(), F.coalesce(_part(stem, pattern, 2), F.lit("default"))), "component": _part(stem, pattern, 3)}


def remapped(codes: Column, names: dict[str, str], drop: list[str]) -> Column:
    """Sorted distinct codes of a comma list, some dropped and some renamed."""
    kept = F.filter(F.transform(F.split(codes, ","), lambda c: F.trim(c)), lambda c: (c != "") & ~c.isin(drop))
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(kept, lambda c: F.coalesce(pairs[c], c))))


def memberships(codes: Column, samples: int) -> list[Column]:
    """Whether a comma list of sample numbers holds each of the samples."""
    listed = F.transform(F.split(codes, ","), lambda c: F.trim(c))
    return [F.coalesce(F.array_contains(listed, str(i)), F.lit(False)) for i in range(samples)]


def strength_of(code: Column) -> Column:
    """P or B and the strength of a criterion's code, null for an unknown one and for the stand-alone benign one, which no rule counts."""
    kind, number, other = F.regexp_extract(code, CODE, 1), F.regexp_extract(code, CODE, 2), F.regexp_extract(code, CODE, 3)
    own = F.create_map(*[F.lit(x) for pair in STRENGTHS.items() for x in pair])[kind]
    count = F.create_map(*[F.lit(x) for pair in CODES_OF_KIND.items() for x in pair])[kind]
    known = (number.try_cast("int").between(1, count)) & ((other != own) | (kind == "PVS"))
    return F.when(known, F.concat(F.substring(kind, 1, 1), F.lit(":"), F.when(other == "", own).otherwise(other)))


def without_functional(codes: Column) -> Column:
    """Codes of a comma list but for those of functional evidence."""
    return F.filter(F.transform(F.split(codes, ","), lambda c: F.trim(c)), lambda c: ~F.rlike(c, F.lit(FUNCTIONAL)))
