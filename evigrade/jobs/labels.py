"""Queries on names, labels and filters, each with its SQL. VARIANTS derives the fields of a variant from a line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.functions import labels as lb
from evigrade.functions import names as nm
from evigrade.operators.evidence import combined_class
from evigrade.sources.staging import table

BASE = "substr('ACGT', CAST(1 + ({}) % 4 AS INT), 1)"
STATUS = "CASE l_partkey % 8 WHEN 0 THEN '2' WHEN 1 THEN '1.0' WHEN 2 THEN 'criteria provided, multiple submitters, no conflicts' WHEN 3 THEN 'reviewed by expert panel' WHEN 4 THEN 'no assertion criteria provided' WHEN 5 THEN 'practice guideline' WHEN 6 THEN NULL ELSE 'criteria provided, conflicting classifications' END"
SIG = "CASE (l_partkey + l_suppkey) % 7 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic' WHEN 2 THEN 'Benign' WHEN 3 THEN 'Benign/Likely benign' WHEN 4 THEN 'Conflicting classifications of pathogenicity' WHEN 5 THEN 'Uncertain significance' END"
#: Name of a field: its expression over lineitem, in words that both dialects share.
VARIANTS = {
    "line": "l_orderkey * 10 + l_linenumber",
    "assay": "concat('A', CAST(l_suppkey % 6 AS STRING))",
    "gene": "concat('G', CAST(l_partkey % 40 AS STRING))",
    "dataset": "concat('G', CAST(l_partkey % 40 AS STRING), '_Kim', CAST(l_suppkey % 6 AS STRING), CASE WHEN l_suppkey % 6 = 5 THEN '_unpublished' ELSE concat('_', CAST(2015 + l_suppkey % 6 AS STRING)) END, CASE WHEN l_suppkey % 3 = 0 THEN '_exon1' ELSE '' END)",
    "chrom": "CASE WHEN l_partkey % 11 > 0 THEN CAST(l_partkey % 22 + 1 AS STRING) END",
    "pos": "CASE WHEN l_partkey % 13 > 0 THEN CAST(1000 + l_partkey AS STRING) ELSE 'x' END",
    "ref": BASE.format("l_partkey"),
    "alt": f"CASE WHEN l_linenumber = 6 THEN 'AC' ELSE {BASE.format('l_partkey + l_linenumber')} END",
    "coding": f"concat('NM_', CAST(l_partkey % 90 AS STRING), '.', CAST(l_suppkey % 3 AS STRING), ':c.', CAST(l_partkey AS STRING), {BASE.format('l_partkey')}, CASE WHEN l_linenumber = 6 THEN 'dup' ELSE concat('>', {BASE.format('l_partkey + 1')}) END)",
    "aa_ref": "substr('ARND', CAST(1 + l_partkey % 4 AS INT), 1)",
    "aa_alt": "substr('ARND', CAST(1 + (l_partkey + l_linenumber) % 4 AS INT), 1)",
    "aa_pos": "CAST(l_partkey AS BIGINT)",
    "protein": "CASE WHEN l_linenumber <> 2 THEN concat('p.', CAST(l_partkey AS STRING)) END",
    "level": "CASE WHEN l_suppkey % 6 = 4 THEN 'aa' ELSE 'nt' END",
    "consequence": "CASE l_linenumber WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'Synonymous' WHEN 3 THEN 'synonymous_variant' WHEN 4 THEN 'MISSENSE' WHEN 5 THEN 'stop_gained' END",
    "sig": SIG, "status": STATUS, "sig_now": SIG.replace("% 7", "% 6"), "status_now": STATUS.replace("l_partkey", "l_suppkey"),
    "frequency": "CASE WHEN l_tax > 0.04 THEN l_tax END",
    "standard": "CASE WHEN l_linenumber = 1 THEN 'nORMAL' WHEN l_linenumber = 2 AND l_partkey % 2 = 0 THEN ' Not Specified' END",
    "has_standard": "l_linenumber <= 2",
    "reported": "CASE l_linenumber WHEN 3 THEN ' Abnormal ' WHEN 4 THEN 'depleted' WHEN 5 THEN 'not specified' END",
    "score": "CASE WHEN l_partkey % 17 > 0 THEN CAST(l_discount AS DOUBLE) * 100 END",
    "range1": "CASE WHEN l_suppkey % 6 < 4 THEN '[-Inf, 3)' END", "class1": "'Abnormal'",
    "range2": "CASE WHEN l_suppkey % 6 < 2 THEN '[3, 6]' ELSE '(4, inf)' END", "class2": "CASE WHEN l_suppkey % 6 = 1 THEN 'nan' ELSE 'normal ' END",
    "points": "CAST(CASE WHEN l_discount >= 0.08 THEN 4 WHEN l_discount >= 0.06 THEN 1 WHEN l_discount <= 0.01 THEN -4 WHEN l_discount <= 0.03 THEN -1 ELSE 0 END AS BIGINT)",
    "oob_points": "CAST(CASE WHEN l_linenumber % 3 > 0 THEN CASE WHEN l_discount >= 0.07 THEN 2 WHEN l_discount <= 0.02 THEN -2 ELSE 0 END END AS BIGINT)",
    "sample": "concat_ws('|', CASE WHEN l_returnflag = 'R' THEN 'Pathogenic/Likely Pathogenic' END, CASE WHEN l_returnflag = 'A' THEN 'Benign/Likely Benign' END, CASE WHEN l_tax > 0.04 THEN 'gnomAD' END)",
    "is_vus": "l_returnflag = 'N' AND l_linestatus = 'O'",
    "call": "CASE WHEN l_suppkey % 6 = 3 THEN 'Not specified' WHEN l_linenumber < 3 THEN 'normal' WHEN l_linenumber = 3 THEN 'Abnormal' WHEN l_linenumber = 4 THEN 'ignore' END",
}
#: Classes that a dataset gives to the calls its author reported; a dimension table, joined by broadcast.
REPORTED_CLASSES = [("Kim1", "depleted", "Abnormal"), ("Kim2", "depleted", "Normal"), ("Kim0", "not specified", "Indeterminate")]


def variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS `{n}`" for n, e in VARIANTS.items()])


def with_calls(rows: DataFrame) -> DataFrame:
    """rows with the author's call in the column author."""
    c, spark = F.col, rows.sparkSession
    classes = spark.createDataFrame(REPORTED_CLASSES, "kind string, reported string, mapped string")
    joined = rows.withColumn("kind", F.regexp_extract("dataset", "_(Kim[0-9])", 1)).join(F.broadcast(classes), ["kind", "reported"], "left")
    intervals = lb.interval_list([(c("range1"), c("class1")), (c("range2"), c("class2"))])
    return joined.withColumn("author", lb.author_call(c("standard"), c("has_standard"), c("kind").isin([k for k, *_ in REPORTED_CLASSES]), c("mapped"), c("reported"), c("score"), intervals)).drop("kind", "mapped")


def variant_names(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of each variant: its own, the physical one, the genomic one, and the parts of its coding name."""
    c = F.col
    vid = nm.variant_id(F.concat(F.lit("V"), c("aa_pos").cast("string")), c("gene"), c("chrom"), c("coding"))
    rows = variants(spark, sf).withColumn("id", vid)
    ref, alt = nm.last_alleles(F.concat_ws("|", "coding", "protein"))
    key = nm.physical_key(c("id"), c("gene"), c("level"), c("aa_ref"), c("aa_pos"), c("aa_alt"))
    return rows.select("line", "id", key.alias("key"), nm.genomic_id(c("chrom"), c("pos"), c("ref"), c("alt")).alias("genomic"), nm.coding_name(c("id")).alias("coding"), ref.alias("coding_ref"), alt.alias("coding_alt"))


def dataset_names(spark: SparkSession, sf: str) -> DataFrame:
    """What the names of datasets, robustness conditions and output files say."""
    name = "CASE WHEN p_partkey % 9 = 0 THEN 'CALM1_CALM2_CALM3_Weile_2017' WHEN p_partkey % 9 = 1 THEN concat('G', CAST(p_size AS STRING), '_unpublished') ELSE concat('G', CAST(p_size AS STRING), '_', p_type, '_', CAST(1900 + p_partkey % 130 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '_exon2' ELSE '' END) END"
    condition = "concat('B_', CAST(p_size AS STRING), CASE p_partkey % 4 WHEN 0 THEN concat('_ds', CAST(p_size AS STRING), '_s', CAST(p_partkey % 10 AS STRING)) WHEN 1 THEN concat('_disc0.', CAST(p_size AS STRING), '_s7_clinvar_2018') WHEN 2 THEN '_control' ELSE '_logs' END)"
    stem = "concat(p_brand, CASE p_partkey % 3 WHEN 0 THEN '_tavtigian' WHEN 1 THEN '_piecewise' ELSE '' END, CASE p_size % 4 WHEN 0 THEN '_2c' WHEN 1 THEN '_3c_avg' WHEN 2 THEN '_3c' ELSE '_x' END, '_calibration')"
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{name} AS name", f"{condition} AS condition", f"{stem} AS stem")
    own = {"gene": nm.gene_of(F.col("name")), "author": nm.author_of(F.col("name")), "year": nm.year_of(F.col("name"))}
    parsed = {f"condition_{n}": e for n, e in nm.condition_of(F.col("condition")).items()} | {f"stem_{n}": e for n, e in nm.stem_parts(F.col("stem"), "_calibration").items()}
    return rows.select("p_partkey", *[e.alias(n) for n, e in (own | parsed).items()])


def distinct_significances(spark: SparkSession, sf: str) -> DataFrame:
    """Every significance that occurs in the caret lists of the parts' types, and how often."""
    text = "CASE WHEN p_partkey % 7 > 0 THEN concat(p_type, ';x^', p_brand, CASE WHEN p_size > 20 THEN ';y;z' ELSE '' END, '^', p_type) END"
    rows = table(spark, sf, "part").selectExpr(f"{text} AS sig")
    return rows.select(F.explode(nm.clean_significances(F.col("sig"))).alias("significance")).groupBy("significance").agg(F.count("*").alias("n"))


def sample_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Comma lists of sample numbers: as flags, and remapped."""
    codes = "concat(CAST(p_size % 5 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN concat(', ', CAST(p_partkey % 4 AS STRING)) ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ',9' ELSE '' END)"
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"CASE WHEN p_partkey % 11 > 0 THEN {codes} END AS codes")
    return rows.select("p_partkey", *[m.alias(f"in_{i}") for i, m in enumerate(nm.memberships(F.col("codes"), 4))], F.array_join(nm.remapped(F.col("codes"), {"3": "1", "4": "0"}, ["9"]), ",").alias("remapped"))


def evidence_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Criteria of an evidence list without the functional ones, and the class that the combining rules give what is left."""
    codes = "concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'PS3' ELSE 'PVS1_Strong' END, CASE WHEN p_partkey % 3 = 0 THEN 'PM2_Supporting' ELSE 'PM2' END, CASE p_partkey % 5 WHEN 0 THEN 'PM1, PM5' WHEN 1 THEN 'BS1' WHEN 2 THEN 'BP4, BP7' WHEN 3 THEN 'PVS1' END, CASE WHEN p_size % 7 = 0 THEN 'BA1, BS3_Supporting' WHEN p_size % 7 = 1 THEN 'PS1_Strong, XX9, BS2' END)"
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"CASE WHEN p_partkey % 13 > 0 THEN {codes} END AS codes")
    kept = rows.select("p_partkey", nm.without_functional(F.col("codes")).alias("kept"))
    strengths = kept.select("p_partkey", "kept", F.transform("kept", nm.strength_of).alias("s"))
    count = lambda what: F.coalesce(F.size(F.filter("s", lambda x: x == what)), F.lit(0))
    n = {"pvs": count("P:Very"), "ps": count("P:Strong"), "pm": count("P:Moderate"), "pp": count("P:Supporting"), "ba": F.lit(0), "bs": count("B:Strong"), "bm": count("B:Moderate"), "bp": count("B:Supporting")}
    return strengths.select("p_partkey", F.coalesce(F.array_join("kept", ","), F.lit("")).alias("kept"), F.when(F.col("kept").isNull(), "VUS").otherwise(combined_class(n)).alias("class"))


def dataset_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Components, benign reference and an override from a dataset's entry, a JSON object."""
    entry = """concat('{"n_c": "', CAST(p_size % 3 + 1 AS STRING), 'c"', CASE WHEN p_partkey % 2 = 0 THEN ', "benign_method": "synonymous"' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN ', "liberal_monotonicity": false' ELSE '' END, '}')"""
    parsed = F.from_json("entry", "n_c string, benign_method string, liberal_monotonicity boolean").alias("e")
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{entry} AS entry").select("p_partkey", parsed)
    return rows.select("p_partkey", "e.n_c", F.coalesce("e.benign_method", F.lit("avg")).alias("benign_method"), "e.liberal_monotonicity")


def variant_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every flag of a variant that its consequence, alleles, significance and frequency decide."""
    c = F.col
    rows = variants(spark, sf).withColumns({"status": lb.review_status(c("status")), "status_now": lb.review_status(c("status_now"))})
    rows = rows.withColumns(lb.consequence_flags(c("consequence"), c("ref"), c("alt")) | {"is_coding": lb.is_coding_change(c("ref"), c("alt"), c("protein"), c("aa_ref"), c("aa_alt")), "is_seen": lb.is_seen(c("frequency"))})
    of = {f"pop_{n}": e for n, e in lb.population_rules(c("is_seen"), c("is_snv"), c("is_missense")).items()} | {f"reg_{n}": e for n, e in lb.regularisation_rules(c("is_snv"), c("is_coding"), c("is_missense")).items()}
    sig = lb.significance_flags(c("sig"), c("status"), c("sig_now"), c("status_now"), 1)
    stars = {f"stars_{k}": lb.has_stars(c("status"), k) for k in range(5)}
    return rows.select("line", "status", "is_synonymous", "is_missense", "is_snv", "is_coding", "is_seen", *[e.alias(n) for n, e in (sig | stars | of).items()])


def author_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The author's call of each variant, its code, whether it is in each sample, and the points that count for it."""
    rows = with_calls(variants(spark, sf))
    c = F.col
    return rows.select("line", "author", lb.determinate(c("author")).alias("determinate"), lb.code_of_call(c("author")).cast("long").alias("code"), lb.in_sample(c("sample"), "gnomAD").alias("in_gnomad"), lb.in_sample(c("sample"), "Pathogenic/Likely Pathogenic").alias("in_plp"), F.coalesce("oob_points", "points").alias("effective_points"))


QUERIES = {f.__name__: f for f in (variant_names, dataset_names, distinct_significances, sample_codes, evidence_codes, dataset_configs, variant_flags, author_calls)}

V = "v AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in VARIANTS.items()) + " FROM lineitem)"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_STAR = "CASE WHEN try_cast({0} AS DOUBLE) > -1 AND try_cast({0} AS DOUBLE) < 4 THEN [" + ", ".join(f"'{s[0]}'" for s in lb.STATUSES) + "][trunc(try_cast({0} AS DOUBLE))::INT + 1] ELSE {0} END"
_STARS = lambda col, k: "true" if k == 0 else f"coalesce({col} NOT IN {_IN([s for level in lb.STATUSES[:k] for s in level])}, false)"
#: The author's call, over v with its reported class joined as mapped.
_BOUND = "CASE lower({0}) WHEN 'inf' THEN 'inf'::DOUBLE WHEN '-inf' THEN '-inf'::DOUBLE ELSE try_cast({0} AS DOUBLE) END"
_CALL = "CASE lower(trim({0})) WHEN 'normal' THEN 'Normal' WHEN 'abnormal' THEN 'Abnormal' WHEN 'not specified' THEN 'Indeterminate' END"


def _inside(i: int) -> str:
    t = f"range{i}"
    lo, hi = _BOUND.format(f"trim(split_part(substr({t}, 2), ',', 1))"), _BOUND.format(f"trim(rtrim(split_part({t}, ',', 2), ')]'))")
    return f"({t} IS NOT NULL AND (score > {lo} OR ({t}[1] = '[' AND score = {lo})) AND (score < {hi} OR ({t}[-1] = ']' AND score = {hi})))"


CALLS = f"""m AS (SELECT * FROM (VALUES {", ".join(str(r) for r in REPORTED_CLASSES)}) t(kind, reported, mapped)),
c AS (SELECT v.*, CASE WHEN has_standard THEN CASE WHEN standard IS NULL OR lower(trim(standard)) IN ('nan', 'not specified') THEN 'Indeterminate' ELSE upper(standard[1]) || lower(standard[2:]) END
  ELSE coalesce(CASE WHEN regexp_extract(dataset, '_(Kim[0-9])', 1) IN (SELECT kind FROM m) THEN coalesce(mapped, {_CALL.format("v.reported")}) END,
  CASE WHEN score IS NOT NULL THEN CASE WHEN {_inside(1)} THEN coalesce({_CALL.format("class1")}, 'Indeterminate') WHEN {_inside(2)} THEN coalesce({_CALL.format("class2")}, 'Indeterminate') END END, 'Indeterminate') END AS author
  FROM v LEFT JOIN m ON m.kind = regexp_extract(dataset, '_(Kim[0-9])', 1) AND m.reported = v.reported)"""
_EXP = {
    "name": "CASE WHEN p_partkey % 9 = 0 THEN 'CALM1_CALM2_CALM3_Weile_2017' WHEN p_partkey % 9 = 1 THEN concat('G', p_size, '_unpublished') ELSE concat('G', p_size, '_', p_type, '_', 1900 + p_partkey % 130, CASE WHEN p_partkey % 2 = 0 THEN '_exon2' ELSE '' END) END",
    "codes": "CASE WHEN p_partkey % 11 > 0 THEN concat(p_size % 5, CASE WHEN p_partkey % 2 = 0 THEN concat(', ', p_partkey % 4) ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ',9' ELSE '' END) END",
}
SQL = {
    "variant_names": f"""WITH {V}, i AS (SELECT *, concat_ws('_', 'V' || aa_pos, gene, coalesce(chrom, 'nan'), coding) AS id FROM v)
SELECT line, id, CASE WHEN level = 'aa' THEN concat(gene, '_aa_', aa_ref, aa_pos, aa_alt) ELSE concat(gene, '_', list_last(string_split(id, '_' || gene || '_'))) END AS key,
  CASE WHEN chrom IS NOT NULL AND try_cast(pos AS DOUBLE) IS NOT NULL THEN concat_ws(':', chrom, pos::BIGINT, ref, alt) END AS genomic, coding, nullif(regexp_extract(coding, '([ACGT])>([ACGT])$', 1), '') AS coding_ref, nullif(regexp_extract(coding, '([ACGT])>([ACGT])$', 2), '') AS coding_alt FROM i""",
    "dataset_names": f"""WITH n AS (SELECT p_partkey, p_size, p_brand, {_EXP['name']} AS name FROM part),
t AS (SELECT *, string_split(name, '_') AS parts, list_position(list_transform(string_split(name, '_'), lambda x: regexp_full_match(x, '(19|20)[0-9][0-9]')), true) AS pos FROM n)
SELECT p_partkey, CASE WHEN starts_with(name, 'CALM1_CALM2_CALM3') THEN 'CALM1/2/3' ELSE parts[1] END AS gene, CASE WHEN pos > 1 AND NOT list_contains(parts, 'unpublished') THEN parts[pos - 1] || ' et al.' END AS author,
  CASE WHEN NOT list_contains(parts, 'unpublished') THEN parts[nullif(pos, 0)] END AS year,
  CASE WHEN p_partkey % 4 < 3 THEN concat('B_', p_size) END AS condition_base, CASE p_partkey % 4 WHEN 0 THEN 'downsample' WHEN 1 THEN 'discordance' WHEN 2 THEN 'control' END AS condition_kind,
  CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN concat('0.', p_size)::DOUBLE WHEN 2 THEN 0 END AS condition_level, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 10 WHEN 1 THEN 7 WHEN 2 THEN 0 END::BIGINT AS condition_seed,
  CASE WHEN p_size % 4 < 3 THEN p_brand END AS stem_dataset, CASE WHEN p_size % 4 < 3 THEN CASE p_partkey % 3 WHEN 0 THEN 'tavtigian' WHEN 1 THEN 'piecewise' ELSE 'default' END END AS stem_method, CASE p_size % 4 WHEN 0 THEN '2c' WHEN 1 THEN '3c_avg' WHEN 2 THEN '3c' END AS stem_component FROM t""",
    "distinct_significances": "WITH s AS (SELECT unnest(CASE WHEN p_partkey % 7 > 0 THEN [p_type, p_brand, p_type] ELSE [NULL] END) AS significance FROM part) SELECT significance, count(*) AS n FROM s GROUP BY 1",
    "sample_codes": f"""WITH c AS (SELECT p_partkey, list_transform(string_split({_EXP['codes']}, ','), lambda x: trim(x)) AS l FROM part)
SELECT p_partkey, {", ".join(f"coalesce(list_contains(l, '{i}'), false) AS in_{i}" for i in range(4))}, array_to_string(list_sort(list_distinct(list_transform(list_filter(l, lambda x: x <> '9'), lambda x: CASE x WHEN '3' THEN '1' WHEN '4' THEN '0' ELSE x END))), ',') AS remapped FROM c""",
    "evidence_codes": r"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 13 > 0 THEN list_filter(flatten([CASE WHEN p_size % 2 = 0 THEN [] ELSE ['PVS1_Strong'] END, CASE WHEN p_partkey % 3 = 0 THEN ['PM2_Supporting'] ELSE ['PM2'] END,
  CASE p_partkey % 5 WHEN 0 THEN ['PM1', 'PM5'] WHEN 1 THEN ['BS1'] WHEN 2 THEN ['BP4', 'BP7'] WHEN 3 THEN ['PVS1'] ELSE [] END, CASE WHEN p_size % 7 = 0 THEN ['BA1'] WHEN p_size % 7 = 1 THEN ['PS1_Strong', 'XX9', 'BS2'] ELSE [] END]), lambda x: x <> '') END AS kept FROM part),
n AS (SELECT p_partkey, kept, len(list_filter(kept, lambda x: x = 'PVS1')) AS pvs, len(list_filter(kept, lambda x: x = 'PVS1_Strong')) AS ps, len(list_filter(kept, lambda x: x IN ('PM2', 'PM1', 'PM5'))) AS pm,
  len(list_filter(kept, lambda x: x = 'PM2_Supporting')) AS pp, len(list_filter(kept, lambda x: x IN ('BS1', 'BS2'))) AS bs, len(list_filter(kept, lambda x: x IN ('BP4', 'BP7'))) AS bp FROM c)
SELECT p_partkey, coalesce(array_to_string(kept, ','), '') AS kept, CASE WHEN kept IS NULL THEN 'VUS' WHEN pvs >= 1 AND (ps >= 1 OR pm >= 2) THEN 'P' WHEN ps >= 2 THEN 'P' WHEN ps = 1 AND pm >= 2 THEN 'P' WHEN pvs = 1 AND pm >= 1 THEN 'LP'
  WHEN ps = 1 AND pm = 1 THEN 'LP' WHEN pm >= 3 THEN 'LP' WHEN pm = 2 AND pp >= 2 THEN 'LP' WHEN bs >= 2 THEN 'B' WHEN bs = 1 AND bp >= 1 THEN 'LB' ELSE 'VUS' END AS class FROM n""",
    "dataset_configs": "SELECT p_partkey, concat(p_size % 3 + 1, 'c') AS n_c, CASE WHEN p_partkey % 2 = 0 THEN 'synonymous' ELSE 'avg' END AS benign_method, CASE WHEN p_partkey % 3 = 0 THEN false END AS liberal_monotonicity FROM part",
    "variant_flags": f"""WITH {V}, s AS (SELECT * REPLACE ({_STAR.format("status")} AS status, {_STAR.format("status_now")} AS status_now),
  coalesce(lower(consequence) = 'synonymous' OR consequence = 'synonymous_variant', false) AS is_synonymous, coalesce(lower(consequence) = 'missense' OR consequence = 'missense_variant', false) AS is_missense,
  length(ref) = 1 AND length(alt) = 1 AND ref <> alt AS is_snv, length(ref) = 1 AND length(alt) = 1 AND (protein IS NULL OR aa_ref <> aa_alt) AS is_coding, frequency IS NOT NULL AS is_seen FROM v)
SELECT line, status, is_synonymous, is_missense, is_snv, is_coding, is_seen, coalesce({_STARS("status", 1)} AND sig IN {_IN(lb.PATHOGENIC)}, false) AS is_pathogenic, coalesce({_STARS("status", 1)} AND sig IN {_IN(lb.BENIGN)}, false) AS is_benign,
  coalesce(sig = 'Conflicting classifications of pathogenicity', false) AS is_conflicting, coalesce({_STARS("status_now", 1)} AND sig_now = 'Uncertain significance', false) AS is_vus, {", ".join(f"{_STARS('status', k)} AS stars_{k}" for k in range(5))},
  true AS pop_all_variants, is_snv AS "pop_all_nsSNV", is_missense AND is_snv AS "pop_all_missense_nsSNV", is_seen AS "pop_gnomAD", is_seen AND is_snv AS "pop_gnomAD_nsSNV", is_seen AND is_snv AND is_missense AS "pop_gnomAD_missense_nsSNV",
  true AS reg_all_assayed, is_snv AS reg_all_snv, is_coding AS "reg_all_nsSNV", is_missense AND is_snv AS reg_all_missense_snv FROM s""",
    "author_calls": f"""WITH {V}, {CALLS} SELECT line, author, CASE WHEN author <> 'Indeterminate' THEN upper(author) END AS determinate, CASE author WHEN 'Normal' THEN 0 WHEN 'Abnormal' THEN 2 ELSE 1 END::BIGINT AS code,
  list_contains(string_split(sample, '|'), 'gnomAD') AS in_gnomad, list_contains(string_split(sample, '|'), 'Pathogenic/Likely Pathogenic') AS in_plp, coalesce(oob_points, points) AS effective_points FROM c""",
}
