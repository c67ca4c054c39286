"""Queries on bootstraps of exact size and on patterns of missing scores, each with its SQL.

A variant in several dimensions is a user and a sixteenth of their events; a dimension is a kind of event, of which some count from a value on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.jobs.calibration import SCORED, _scores
from evigrade.jobs.fits import log_cdf_sql
from evigrade.operators import monotone as mono
from evigrade.operators import multivariate as mv
from evigrade.operators import patterns as op
from evigrade.operators.stratified import sized_draws, sized_draws_sql
from evigrade.sources.staging import cut, table

SEEDS, LEAST = 8, 30
DIMS = ["view", "click", "error", "purchase", "signup"]
KEYS = {"id": "user_id * 16 + event_id % 16", "sample": "CASE user_id % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'B' ELSE 'population' END"}
VALUE = "CASE WHEN event_type = 'signup' AND value < 260 THEN NULL WHEN event_type = 'error' AND value < 150 THEN NULL ELSE value END"


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in KEYS.items()], "event_type", f"{VALUE} AS value")
    return op.wide(rows, list(KEYS), "event_type", "value", DIMS)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return cut(op.pattern_counts(_wide(spark, sf), DIMS, ["sample"]), "pattern-counts")


def _by_seed(draws: DataFrame, strata: list[str], row_id: str) -> DataFrame:
    each = draws.select(*strata, row_id, F.posexplode("times").alias("seed", "n"))
    sums = {"rows": F.count("*"), "drawn": F.sum("n"), "unseen": F.count_if(F.col("n") == 0), "again": F.count_if(F.col("n") > 1), "mixed": F.sum(F.col("n") * (F.col(row_id) % 101))}
    return each.groupBy(*strata, F.col("seed").cast("long").alias("seed")).agg(*[c.cast("long").alias(n) for n, c in sums.items()])


def sample_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """By language, sample and seed: rows, rows drawn (as many), rows unseen and rows drawn twice or more."""
    member = F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in (("is_plp", "P"), ("is_blb", "B"), ("is_pop", "population"))]), lambda s: s.isNotNull())
    rows = _scores(spark, sf).select("lang", "doc_id", F.explode(member).alias("sample"))
    return _by_seed(sized_draws(rows, ["lang", "sample"], "doc_id", SEEDS), ["lang", "sample"], "doc_id")


def pattern_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The same by sample and pattern of gaps, so that every seed has each pattern as often as the data."""
    rows = _wide(spark, sf).select("id", "sample", op.pattern(DIMS).alias("mask"))
    return _by_seed(sized_draws(rows, ["sample", "mask"], "id", SEEDS), ["sample", "mask"], "id")


def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


def dimension_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    found = op.overlaps(_counts(spark, sf), len(DIMS))
    return found.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n")


def connected_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions that are linked by shared rows, a share of all rows at least, and the group to calibrate together."""
    counts = _counts(spark, sf)
    least = max(LEAST, counts.agg(F.sum("n")).first()[0] // 5)
    return op.connected_dims(counts, len(DIMS), least)


def supported_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """For each pattern the largest part of it that both classes have often enough."""
    return op.supported_subsets(_counts(spark, sf), len(DIMS), "sample", ["P", "B"], LEAST)


#: A literal fit over two of the dimensions, in hundreds: components by sample.
PAIR = ["view", "signup"]
MODEL = {"mu": [[0.5, 3.0], [1.6, 2.7]], "delta": [[0.6, 0.3], [0.8, -0.2]], "gamma": [[[0.3, 0.05], [0.05, 0.2]], [[0.6, -0.1], [-0.1, 0.3]]], "w": [[0.8, 0.2], [0.25, 0.75], [0.5, 0.5]]}
PRIOR, ENOUGH = 0.2, 40
FITTED, STEPS = 2, 15
#: Cells of a grid of 11 columns, their log ratio, and the bars of its regions.
GRID, CELL = 11, {"i": "CAST(floor((l_quantity - 1) / 5) AS BIGINT)", "j": "CAST(floor(l_discount * 100 + 0.5) AS BIGINT)"}
RETURNED = "ln((count(CASE WHEN l_returnflag = 'R' THEN 1 END) + 0.5) / (count(CASE WHEN l_returnflag = 'A' THEN 1 END) + 0.5))"
BARS = [(1, "l >= -0.05"), (2, "l >= 0.0"), (3, "l >= 0.05")]


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    """Few rows of the second class have both dimensions."""
    rows = _wide(spark, sf).select("id", "sample", *[F.round(F.col(c) / 100, 6).alias(c) for c in PAIR])
    return rows.withColumn("view", F.when((F.col("sample") != "B") | F.col("signup").isNull() | (F.col("id") % 5 == 0), F.col("view")))


def pattern_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Each variant's log ratio from both dimensions or the one it has, in each mode for patterns that a class lacks."""
    rows = _pair(spark, sf)
    told = cut(mv.support(op.pattern_counts(rows, PAIR, ["sample"]), len(PAIR), ENOUGH), "pattern-support")
    found = [mv.pattern_ratios(rows, PAIR, "id", MODEL, told, PRIOR, m).select("id", "mask", F.lit(m).alias("mode"), F.round("l", 5).alias("l")) for m in mv.MODES]
    return reduce(DataFrame.unionByName, found)


def pattern_prior(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the first class in the population, over all patterns together."""
    prior = mv.pattern_prior(_pair(spark, sf).where("sample = 'population'"), PAIR, MODEL)
    return spark.range(1).select(F.round(F.lit(None if prior != prior else prior).cast("double"), 4).alias("prior"))


def multivariate_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Components of two bootstraps by sample and pattern, fitted to two dimensions with gaps: a row a seed and component."""
    rows = _pair(spark, sf).withColumn("mask", op.pattern(PAIR))
    drawn = sized_draws(rows.select("id", "sample", "mask"), ["sample", "mask"], "id", FITTED).select("id", F.transform("times", lambda v: v.cast("int")).alias("times"))
    member = F.array(F.when(F.col("sample") == "P", 0).when(F.col("sample") == "B", 1).otherwise(2)).alias("samples")
    given = cut(rows.select("id", *PAIR, member).join(drawn, "id"), "pair-rows")
    fits = mv.fit(given, PAIR, 3, 2, FITTED, STEPS)
    made = [(f["seed"], c, f["mu"][c].tolist(), f["delta"][c].tolist(), f["gamma"][c].tolist(), f["w"][:, c].tolist(), len(f["trace"]), float(f["trace"][-1])) for f in fits for c in range(2)]
    return spark.createDataFrame(made, "seed long, component long, mu array<double>, delta array<double>, gamma array<array<double>>, weights array<double>, steps long, ll double")


def score_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Which way the first class lies in each dimension."""
    return mono.directions(_wide(spark, sf), DIMS, "sample", "P", "B")


def monotone_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of the literal fit made monotone along both dimensions, strictly and liberally."""
    rows = _pair(spark, sf)
    told = cut(mv.support(op.pattern_counts(rows, PAIR, ["sample"]), len(PAIR), ENOUGH), "pattern-support")
    ratios = cut(rows.join(mv.pattern_ratios(rows, PAIR, "id", MODEL, told, PRIOR, "trust_global").select("id", F.round("l", 5).alias("l")), "id"), "pair-ratios")
    ways = mono.directions(rows, PAIR, "sample", "P", "B")
    found = [mono.repaired(ratios, "id", PAIR, "l", ways, liberal, STEPS).select("id", F.lit(liberal).alias("liberal"), F.round("l", 4).alias("l")) for liberal in (False, True)]
    return found[0].unionByName(found[1])


def monotone_regions(spark: SparkSession, sf: str) -> DataFrame:
    """On a grid of quantity and discount, the main region of each bar of the log ratio of returns, each inside the one before."""
    cells = table(spark, sf, "lineitem").groupBy(*[F.expr(e).alias(n) for n, e in CELL.items()]).agg(F.expr(f"round({RETURNED}, 6)").alias("l"))
    return mono.nested_regions(cut(cells, "ratio-cells"), GRID, BARS)


QUERIES = {f.__name__: f for f in (sample_bootstrap, pattern_bootstrap, pattern_counts, dimension_overlaps, connected_dims, supported_subsets, pattern_ratios, pattern_prior, multivariate_fits, score_directions, monotone_ratios, monotone_regions)}

_WIDE = f"""x AS (SELECT {", ".join(f"{e} AS {n}" for n, e in KEYS.items())}, event_type, {VALUE} AS value FROM events),
wide AS (SELECT id, sample, {", ".join(f"avg(value) FILTER (WHERE event_type = '{d}') AS {d}" for d in DIMS)} FROM x GROUP BY ALL),
masked AS (SELECT id, sample, ({" + ".join(f"CASE WHEN {d} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, d in enumerate(DIMS))})::BIGINT AS mask FROM wide), counts AS (SELECT sample, mask, count(*) AS n FROM masked GROUP BY ALL)"""
_SUMS = lambda strata, i: f"SELECT {strata}, seed, count(*) AS rows, sum(times)::BIGINT AS drawn, count(*) FILTER (WHERE times = 0) AS unseen, count(*) FILTER (WHERE times > 1) AS again, sum(times * ({i} % 101))::BIGINT AS mixed FROM drawn GROUP BY {strata}, seed"
_PAIRS = f"pairs AS (SELECT i, j, sum(n)::BIGINT AS n FROM counts, range({len(DIMS)}) a(i), range({len(DIMS)}) b(j) WHERE i < j AND mask & (1 << i) > 0 AND mask & (1 << j) > 0 GROUP BY ALL)"


def _component(c: int) -> str:
    """Log density of a component at (x, y), of which either may be null."""
    (m0, m1), (d0, d1), ((g00, g01), (_, g11)) = MODEL["mu"][c], MODEL["delta"][c], MODEL["gamma"][c]
    o00, o01, o11 = g00 + d0 * d0, g01 + d0 * d1, g11 + d1 * d1
    det = o00 * o11 - o01 * o01
    s0, s1 = (o11 * d0 - o01 * d1) / det, (o00 * d1 - o01 * d0) / det
    r0, r1 = f"(x - {m0})", f"(y - {m1})"
    one = lambda r, o, d: f"ln(2) - ln(2 * pi() * {o}) / 2 - {r} * {r} / {2 * o} + ({log_cdf_sql(f'({r} * {d / o / (1 - d * d / o) ** 0.5})')})"
    both = f"ln(2) - ln(2 * pi()) - ln({det}) / 2 - ({o11} * {r0} * {r0} - {2 * o01} * {r0} * {r1} + {o00} * {r1} * {r1}) / {2 * det} + ({log_cdf_sql(f'(({s0} * {r0} + {s1} * {r1}) / {(1 - d0 * s0 - d1 * s1) ** 0.5})')})"
    return f"CASE WHEN x IS NULL AND y IS NULL THEN 0 WHEN y IS NULL THEN {one(r0, o00, d0)} WHEN x IS NULL THEN {one(r1, o11, d1)} ELSE {both} END"


_MIXED = lambda w: f"greatest(c0 + ln({w[0]}), c1 + ln({w[1]})) + ln(exp(c0 + ln({w[0]}) - greatest(c0 + ln({w[0]}), c1 + ln({w[1]}))) + exp(c1 + ln({w[1]}) - greatest(c0 + ln({w[0]}), c1 + ln({w[1]}))))"
_PAIR = f"""{_WIDE}, hundreds AS (SELECT id, sample, round(view / 100, 6) AS v, round(signup / 100, 6) AS y FROM wide), pair AS (SELECT id, sample, CASE WHEN sample <> 'B' OR y IS NULL OR id % 5 = 0 THEN v END AS x, y FROM hundreds),
of_mask AS (SELECT *, ((x IS NOT NULL)::INT + 2 * (y IS NOT NULL)::INT)::BIGINT AS mask FROM pair)"""
_DENSE = lambda t: f"(SELECT *, {', '.join(f'{_MIXED(w)} AS {n}' for w, n in zip(MODEL['w'], ('log_p', 'log_b', 'log_pop'), strict=True))} FROM (SELECT *, {_component(0)} AS c0, {_component(1)} AS c1 FROM {t}))"
_LEFT = lambda share, own: f"(log_pop + ln(greatest((1 - {share} * exp({own} - log_pop)) / (1 - {share}), 1e-10)))"
SQL = {
    "sample_bootstrap": f"""WITH RECURSIVE {SCORED}, members AS (SELECT lang, doc_id, unnest(list_filter([CASE WHEN is_plp THEN 'P' END, CASE WHEN is_blb THEN 'B' END, 'population'], lambda v: v IS NOT NULL)) AS sample FROM s),
{sized_draws_sql("members", ["lang", "sample"], "doc_id", SEEDS)} {_SUMS("lang, sample", "doc_id")}""",
    "pattern_bootstrap": f"WITH RECURSIVE {_WIDE}, {sized_draws_sql('masked', ['sample', 'mask'], 'id', SEEDS)} {_SUMS('sample, mask', 'id')}",
    "pattern_counts": f"WITH {_WIDE} SELECT sample, mask, n FROM counts",
    "dimension_overlaps": f"WITH {_WIDE}, {_PAIRS} SELECT i, j, n FROM pairs",
    "connected_dims": f"""WITH RECURSIVE {_WIDE}, {_PAIRS}, linked AS (SELECT i AS a, j AS b FROM pairs WHERE n >= greatest({LEAST}, (SELECT sum(n) FROM counts) // 5)), both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
roots AS (SELECT a AS dim, least(a, min(b)) AS root FROM reach GROUP BY a), sized AS (SELECT dim, root, count(*) OVER (PARTITION BY root) AS size FROM roots)
SELECT dim, root, size, root = (SELECT root FROM sized ORDER BY size DESC, root LIMIT 1) AS chosen FROM sized""",
    "supported_subsets": f"""WITH {_WIDE}, p AS (SELECT DISTINCT mask FROM counts WHERE mask > 0), sub AS (SELECT mask, subset FROM p, range(1, {1 << len(DIMS)}) r(subset) WHERE subset & mask = subset),
fine AS (SELECT subset FROM (SELECT subset, sample, sum(n) AS n FROM (SELECT DISTINCT subset FROM sub) q JOIN counts c ON c.mask & subset = subset WHERE sample IN ('P', 'B') GROUP BY ALL) WHERE n >= {LEAST} GROUP BY subset HAVING count(*) = 2),
ranked AS (SELECT mask, subset, row_number() OVER (PARTITION BY mask ORDER BY bit_count(subset) DESC, list_filter(range({len(DIMS)}), lambda i: subset & (1 << i) > 0)) AS i FROM sub JOIN fine USING (subset))
SELECT mask, subset AS supported FROM p LEFT JOIN (SELECT mask, subset FROM ranked WHERE i = 1) USING (mask)""",
    "pattern_ratios": f"""WITH {_PAIR}, masks AS (SELECT sample, mask, count(*) AS n FROM of_mask GROUP BY ALL),
has AS (SELECT s.mask, {", ".join(f"coalesce(sum(n) FILTER (WHERE sample = '{n}'), 0) >= {ENOUGH} AS has_{k}" for n, k in (("P", "p"), ("B", "b"), ("population", "pop")))} FROM (SELECT DISTINCT mask FROM masks WHERE mask > 0) s JOIN masks m ON m.mask & s.mask = s.mask GROUP BY s.mask),
whole AS (SELECT h.mask, has_p, has_b, has_pop, (SELECT arg_min(t.mask, {{'size': -bit_count(t.mask), 'mask': t.mask}}) FROM has t WHERE t.mask & h.mask = t.mask AND t.has_p AND t.has_b) AS sub FROM has h),
each AS (SELECT id, p.mask, mode, has_p, has_b, has_pop, CASE WHEN mode <> 'project' OR coalesce(sub, p.mask) & 1 > 0 THEN x END AS x, CASE WHEN mode <> 'project' OR coalesce(sub, p.mask) & 2 > 0 THEN y END AS y
  FROM of_mask p LEFT JOIN whole USING (mask), (VALUES {", ".join(f"('{m}')" for m in mv.MODES)}) t(mode)), dense AS {_DENSE("each")}
SELECT id, mask, mode, round(CASE WHEN mask = 0 OR (mode = 'gate' AND NOT has_b) THEN NULL WHEN mode = 'local_unmixing' AND has_p AND NOT has_b AND has_pop THEN log_p - {_LEFT(PRIOR, "log_p")}
  WHEN mode = 'local_unmixing' AND NOT has_p AND has_b AND has_pop THEN {_LEFT(1 - PRIOR, "log_b")} - log_b ELSE log_p - log_b END, 5) + 0 AS l FROM dense""",
    "pattern_prior": f"""WITH RECURSIVE {_PAIR}, dense AS {_DENSE("of_mask")}, r AS (SELECT round(greatest(-30.0, least(30.0, log_p - log_b)), 3) AS l, count(*) AS n FROM dense WHERE sample = 'population' AND mask > 0 GROUP BY 1),
it AS (SELECT list(exp(least(l, 0)) ORDER BY l) AS f1, list(exp(-greatest(l, 0)) ORDER BY l) AS f2, list(n ORDER BY l) AS n, 0.5::DOUBLE AS prior, 1.0::DOUBLE AS diff, 0 AS step FROM r
  UNION ALL SELECT f1, f2, n, new, abs(new - prior), step + 1 FROM (SELECT *, list_sum(list_transform(range(1, len(n) + 1), lambda i: n[i] * prior * f1[i] / (prior * f1[i] + (1 - prior) * f2[i]))) / list_sum(n) AS new FROM it WHERE diff >= 1e-6 AND step < 10000 AND prior > 0 AND prior < 1))
SELECT round(CASE WHEN last > 0.001 AND last < 0.999 THEN last END, 4) AS prior FROM (SELECT arg_max(prior, step) AS last FROM it)""",
    "score_directions": f"WITH {_WIDE}, m AS (SELECT {', '.join(f'avg({d}) FILTER (WHERE sample = {chr(39)}{c}{chr(39)}) AS {d}_{c}' for d in DIMS for c in 'PB')} FROM wide) " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS dim, CASE WHEN {d}_P <= {d}_B THEN -1 ELSE 1 END::BIGINT AS up FROM m" for i, d in enumerate(DIMS)),
    "monotone_ratios": f"""WITH {_PAIR}, dense AS {_DENSE("of_mask")}, rated AS (SELECT id, x, y, CASE WHEN mask > 0 THEN round(log_p - log_b, 5) END AS l FROM dense),
ways AS (SELECT CASE WHEN avg(x) FILTER (WHERE sample = 'P') <= avg(x) FILTER (WHERE sample = 'B') THEN -1 ELSE 1 END AS ux, CASE WHEN avg(y) FILTER (WHERE sample = 'P') <= avg(y) FILTER (WHERE sample = 'B') THEN -1 ELSE 1 END AS uy FROM pair),
long_form AS (SELECT id, l, 0 AS dim, x * ux AS v FROM rated, ways WHERE x IS NOT NULL AND l IS NOT NULL UNION ALL SELECT id, l, 1, y * uy FROM rated, ways WHERE y IS NOT NULL AND l IS NOT NULL),
ends AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM long_form GROUP BY dim HAVING max(v) > min(v) AND count(*) >= {mono.LEAST}),
placed AS (SELECT id, l, dim, least({STEPS} - 1, floor((v - lo) / (hi - lo) * {STEPS})) AS place FROM long_form LEFT JOIN ends USING (dim)),
means AS (SELECT dim, place, avg(greatest(l, 0)) AS up, avg(greatest(-l, 0)) AS down, count(*) AS n FROM placed WHERE place IS NOT NULL GROUP BY ALL),
spans AS (SELECT a.dim, a.place AS a, b.place AS b, sum(m.up * m.n) / sum(m.n) AS up, sum(m.down * m.n) / sum(m.n) AS down FROM means a JOIN means b ON a.dim = b.dim AND a.place <= b.place JOIN means m ON m.dim = a.dim AND m.place BETWEEN a.place AND b.place GROUP BY ALL),
tops AS (SELECT m.dim, m.place, s.a, min(s.up) AS up FROM means m JOIN spans s ON s.dim = m.dim AND s.a <= m.place AND s.b >= m.place GROUP BY ALL), downs AS (SELECT m.dim, m.place, s.b, min(s.down) AS down FROM means m JOIN spans s ON s.dim = m.dim AND s.a <= m.place AND s.b >= m.place GROUP BY ALL),
fits AS (SELECT dim, place, max(up) - (SELECT max(down) FROM downs d WHERE d.dim = t.dim AND d.place = t.place) AS w FROM tops t GROUP BY dim, place),
valued AS (SELECT id, coalesce(w, l) AS w FROM placed LEFT JOIN fits USING (dim, place)),
whole AS (SELECT id, min(w) FILTER (WHERE w > 0) AS low, max(w) FILTER (WHERE w < 0) AS high, max(w) AS top FROM valued GROUP BY id)
SELECT r.id, liberal, round(CASE WHEN w.id IS NULL THEN l WHEN liberal THEN top WHEN low IS NOT NULL AND high IS NOT NULL THEN 0 ELSE coalesce(low, high, 0) END, 4) + 0 AS l FROM rated r LEFT JOIN whole w USING (id), (VALUES (false), (true)) v(liberal)""",
    "monotone_regions": "WITH RECURSIVE cells AS MATERIALIZED (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CELL.items()) + f", round({RETURNED}, 6) AS l FROM lineitem GROUP BY 1, 2), "
    + ", ".join(f"""k{p} AS MATERIALIZED (SELECT i, j, i * {GRID} + j AS cell FROM cells WHERE {c}), e{p} AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM k{p} a JOIN k{p} b ON abs(a.i - b.i) + abs(a.j - b.j) = 1),
r{p} AS (SELECT cell AS a, cell AS b FROM k{p} UNION SELECT r.a, e.b FROM r{p} r JOIN e{p} e ON e.a = r.b), o{p} AS (SELECT a AS cell, min(b) AS root FROM r{p} GROUP BY a),
m{p} AS (SELECT i, j FROM k{p} JOIN o{p} USING (cell) WHERE root = (SELECT root FROM o{p} GROUP BY root ORDER BY count(*) DESC, root LIMIT 1){f" AND (i, j) IN (SELECT (i, j) FROM m{p - 1})" if p > 1 else ""})""" for p, c in BARS)
    + " " + " UNION ALL ".join(f"SELECT {p}::BIGINT AS points, i, j FROM m{p}" for p, _ in BARS),
}
