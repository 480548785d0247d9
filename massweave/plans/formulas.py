"""Formula queries: generated grids, parsed names, searches against line items as peaks, classes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.functions import formula as fm
from massweave.functions.chem import ELECTRON, MONO
from massweave.operators import filters, priority, report, search
from massweave.plans.registry import query, sig, sig_sql, tables

RANGES = [("C", 1, 30), ("H", 4, 62), ("O", 0, 10), ("N", 0, 2), ("S", 0, 1)]
C, H, O, N, S = (MONO[x] for x in ("C", "H", "O", "N", "S"))  # noqa: E741
GRID = f"""
c AS (SELECT unnest(range(1, 31)) AS C), h AS (SELECT unnest(range(4, 63)) AS H), o AS (SELECT unnest(range(0, 11)) AS O), n AS (SELECT unnest(range(0, 3)) AS N), s AS (SELECT unnest(range(0, 2)) AS S),
m AS (SELECT *, round(C * {C} + H * {H} + O * {O} + N * {N} + S * {S}, 9) AS mass, 1 + C * 1.0 + H * -0.5 + N * 0.5 AS dbe FROM c, h, o, n, s),
f AS (SELECT * FROM m WHERE mass BETWEEN 50 AND 600 AND dbe BETWEEN 0 AND 25 AND dbe = floor(dbe) AND H * 1.0 / C BETWEEN 0.3 AND 3.0 AND (O = 0 OR (O * 1.0 / C > 0.0 AND O * 1.0 / C < 1.2)))"""


def grid(spark: SparkSession) -> DataFrame:
    return search.candidates(spark, RANGES, (50.0, 600.0), (0.0, 25.0))


@query(f"""WITH {GRID}, p AS (SELECT CAST(floor(l_extendedprice / 100) AS BIGINT) AS nominal, count(*) AS peaks FROM lineitem GROUP BY 1)
SELECT nominal, any_value(peaks) AS peaks, count(mass) AS formulas, {sig_sql('sum(mass)', 'mass')}, {sig_sql('avg(dbe)', 'dbe')} FROM p LEFT JOIN f ON CAST(floor(mass) AS BIGINT) = nominal GROUP BY nominal""")
def q_formula_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nominal mass of every peak: its peaks and the formulas of the grid that it may be searched in."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    peaks = lines.groupBy(F.floor(F.col("l_extendedprice") / 100).alias("nominal")).agg(F.count("*").alias("peaks"))
    own = grid(spark).groupBy(F.floor("mass").alias("nominal")).agg(F.count("*").alias("formulas"), F.sum("mass").alias("mass"), F.avg("dbe").alias("dbe"))
    return peaks.join(own, "nominal", "left").select("nominal", "peaks", F.coalesce("formulas", F.lit(0)).cast("long").alias("formulas"), sig("mass", "mass"), sig("dbe", "dbe"))


@query(f"""WITH f AS (SELECT p_partkey, 1 + p_size AS C, 4 + p_partkey % 59 AS H, p_partkey % 11 AS O, p_partkey % 3 AS N, p_size % 2 AS S FROM part),
i AS (SELECT *, 1 + C * 1.0 + H * -0.5 + N * 0.5 AS dbe, C * {C} + H * {H} + O * {O} + N * {N} + S * {S} AS mass, 1 + C - O - S - 0.5 * (H + N) AS ai_top, C - O - S - N AS ai_low, 1 + C - O * 0.5 - S - 0.5 * (H + N) AS am_top, C - O * 0.5 - S - N AS am_low FROM f)
SELECT p_partkey, {sig_sql('dbe', 'dbe')}, {sig_sql('4 - (4 * C + H - 3 * N - 2 * O - 2 * S) * 1.0 / C', 'nosc')}, {sig_sql('H * 1.0 / C', 'h_c')},
{sig_sql('greatest(0.0, least(1.0, CASE WHEN ai_low = 0 THEN 0 ELSE ai_top / ai_low END))', 'ai')}, {sig_sql('greatest(0.0, least(1.0, CASE WHEN am_low = 0 THEN 0 ELSE am_top / am_low END))', 'ai_mod')},
{sig_sql(f'mass + {MONO["H"]} - {ELECTRON}', 'protonated')} FROM i""")
def q_formula_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices and masses of a formula that each part writes."""
    (part,) = tables(spark, sf_dir, "part")
    n = {"C": 1 + F.col("p_size"), "H": 4 + F.col("p_partkey") % 59, "O": F.col("p_partkey") % 11, "N": F.col("p_partkey") % 3, "S": F.col("p_size") % 2}
    a = F.col("atoms")
    rows = part.select("p_partkey", fm.parse(F.concat_ws(" ", *[F.concat(F.lit(x), c.cast("string")) for x, c in n.items()])).alias("atoms"))
    return rows.select("p_partkey", sig(fm.dbe(a), "dbe"), sig(fm.nosc(a), "nosc"), sig(fm.ratio(a, "H", "C"), "h_c"), sig(fm.aromaticity(a), "ai"), sig(fm.aromaticity(a, True), "ai_mod"), sig(fm.mz(fm.neutral_mass(a), F.lit(1), F.lit("protonated")), "protonated"))


@query(f"""WITH {GRID}, b AS (SELECT DISTINCT round(l_extendedprice / 100, 4) AS mz FROM lineitem WHERE l_extendedprice / 100 BETWEEN 50 AND 600),
x AS (SELECT C, H, O, N, S, mass + {MONO['H']} - {ELECTRON} AS z FROM f),
r AS (SELECT mz, C, H, O, N, S, (mz - z) / z * 1e6 AS err, row_number() OVER (PARTITION BY mz ORDER BY N + S, abs((mz - z) / z * 1e6), C, H, O) AS k FROM b JOIN x ON mz BETWEEN z * 0.99999 AND z * 1.00001 WHERE abs(mz - z) <= z * (5.0 * 1e-6))
SELECT mz, CAST(C AS INTEGER) AS c, CAST(H AS INTEGER) AS h, CAST(O AS INTEGER) AS o, CAST(N AS INTEGER) AS n, CAST(S AS INTEGER) AS s, {sig_sql('round(err, 3)', 'error_ppm')}, {sig_sql('round(exp(-(err * err) / (2 * 1.66 * 1.66)), 5)', 'mz_score')} FROM r WHERE k = 1""")
def q_formula_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks against all candidate formulas within 5 ppm; the candidate with fewest N and S, then least error."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    peaks = lines.where((F.col("l_extendedprice") / 100).between(50, 600)).select(F.round(F.col("l_extendedprice") / 100, 4).alias("mz")).distinct()
    rated = search.searched(peaks, grid(spark), [("protonated", None)], 1, (-5.0, 5.0))
    best = search.best_candidate(rated, ["mz"], "N_S_P_lowest_error", ["C", "H", "O"])
    return best.select("mz", *[F.col(x).alias(x.lower()) for x in "CHONS"], sig(F.round("error_ppm", 3), "error_ppm"), sig(F.round("mz_score", 5), "mz_score"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {sig_sql('l_extendedprice * (14.0 / 14.01565006446)', 'kendrick_mass')}, CAST(floor(l_extendedprice * (14.0 / 14.01565006446)) AS BIGINT) AS nominal FROM lineitem""")
def q_kendrick(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables(spark, sf_dir, "lineitem")
    km, _, nominal = fm.kendrick(F.col("l_extendedprice"))
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", sig(km, "kendrick_mass"), nominal.cast("bigint").alias("nominal"))


@query("""WITH p AS (SELECT p_partkey, p_size % 5 AS o, p_size % 3 AS n, 1 + p_size AS c FROM part)
SELECT p_partkey, concat_ws(' ', 'C' || c, 'H' || 2 * c, CASE WHEN o > 0 THEN 'O' || o END, CASE WHEN n > 0 THEN 'N' || n END) AS formula,
CASE WHEN o = 0 AND n = 0 THEN 'HC' ELSE concat_ws(' ', CASE WHEN o > 0 THEN 'O' || o END, CASE WHEN n > 0 THEN 'N' || n END) END || ' -R' AS class FROM p""")
def q_formula_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas written, parsed and written again, with their class labels."""
    (part,) = tables(spark, sf_dir, "part")
    c, o, n = 1 + F.col("p_size"), F.col("p_size") % 5, F.col("p_size") % 3
    written = F.concat_ws(" ", F.when(n > 0, F.concat(F.lit("N"), n.cast("string"))), F.concat(F.lit("H"), (2 * c).cast("string")), F.when(o > 0, F.concat(F.lit("O"), o.cast("string"))), F.concat(F.lit("C"), c.cast("string")))
    atoms = part.select("p_partkey", fm.parse(written).alias("atoms"))
    return atoms.select("p_partkey", fm.text(F.col("atoms")).alias("formula"), fm.class_label(F.col("atoms"), F.lit("radical")).alias("class"))


@query(f"""WITH a AS (SELECT l_linenumber AS scan, CASE WHEN l_returnflag = 'N' THEN 'unassigned' ELSE l_returnflag || l_linestatus END AS class, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT *, 100 * q / sum(q) OVER (PARTITION BY scan) AS p, 100.0 * n / sum(n) OVER (PARTITION BY scan) AS c FROM a)
SELECT scan, class, n, {sig_sql('q', 'abundance')}, {sig_sql('p', 'abundance_percent')}, {sig_sql('c', 'count_percent')} FROM b WHERE p > 5.0""")
def q_class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_linenumber").alias("scan"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("class"), F.col("l_quantity").alias("abundance"))
    got = search.class_table(rows, ["scan"], "class", 5.0)
    return got.select("scan", "class", "n", sig("abundance", "abundance"), sig("abundance_percent", "abundance_percent"), sig("count_percent", "count_percent"))


@query("""WITH x AS (SELECT l_partkey, l_suppkey, l_orderkey, l_quantity, l_linenumber, count(DISTINCT l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey) AS n_spectra,
row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem)
SELECT l_partkey AS mf_id, l_suppkey AS ref_mol_id, l_orderkey AS scan, l_quantity AS entropy_similarity, n_spectra FROM x WHERE r = 1""")
def q_best_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_partkey").alias("mf_id"), F.col("l_suppkey").alias("ref_mol_id"), F.col("l_orderkey").alias("scan"), F.col("l_quantity").alias("entropy_similarity"), F.col("l_linenumber").alias("ref_ms_id"))
    return report.best_per_feature(rows).select("mf_id", "ref_mol_id", "scan", "entropy_similarity", F.col("n_spectra").cast("bigint").alias("n_spectra"))


@query("""WITH b AS (SELECT l_partkey AS mf_id, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag AS species, l_linestatus AS class FROM lineitem),
g AS (SELECT mf_id, count(DISTINCT species) AS s, count(DISTINCT class) AS c FROM b GROUP BY mf_id),
t AS (SELECT b.*, CASE WHEN s = 1 THEN 'species' WHEN c = 1 THEN 'class' ELSE 'none' END AS consensus FROM b JOIN g USING (mf_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY mf_id ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber, l_suppkey) AS k FROM t)
SELECT mf_id, consensus, l_quantity AS score FROM r WHERE k = 1""")
def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_partkey").alias("mf_id"), F.col("l_returnflag").alias("species"), F.col("l_linestatus").alias("class"), F.col("l_quantity").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return report.consensus(rows, ["species", "class"], "score", "tie").select("mf_id", "consensus", "score")


@query("""WITH f AS (SELECT p_partkey AS mf_id FROM part), a AS (SELECT p_partkey AS mf_id, CASE WHEN p_size > 10 THEN p_brand END AS ion_formula FROM part),
b AS (SELECT DISTINCT l_partkey AS mf_id, CASE WHEN l_linestatus = 'O' THEN p_brand ELSE 'other' END AS ion_formula, l_suppkey AS ref FROM lineitem JOIN part ON p_partkey = l_partkey),
j AS (SELECT f.mf_id, a.ion_formula FROM f LEFT JOIN a USING (mf_id))
SELECT j.mf_id, j.ion_formula, b.ref FROM j LEFT JOIN b ON j.mf_id = b.mf_id AND j.ion_formula = b.ion_formula WHERE j.ion_formula IS NOT NULL
UNION ALL SELECT j.mf_id, b.ion_formula, b.ref FROM j LEFT JOIN b ON j.mf_id = b.mf_id WHERE j.ion_formula IS NULL""")
def q_combined_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = tables(spark, sf_dir, "part", "lineitem")
    ms1 = part.select(F.col("p_partkey").alias("mf_id"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("ion_formula"))
    ms2 = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_partkey").alias("mf_id"), F.when(F.col("l_linestatus") == "O", F.col("p_brand")).otherwise("other").alias("ion_formula"), F.col("l_suppkey").alias("ref")).distinct()
    return report.combined(part.select(F.col("p_partkey").alias("mf_id")), ms1, ms2).select("mf_id", "ion_formula", "ref")


@query("""SELECT l_orderkey, CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS BIGINT) AS a, CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS BIGINT) AS n, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS r FROM lineitem GROUP BY l_orderkey""")
def q_pivot_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables(spark, sf_dir, "lineitem")
    return report.counted(lines, ["l_orderkey"], "l_returnflag", ["A", "N", "R"]).select("l_orderkey", *[F.col(x).alias(x.lower()) for x in "ANR"])


@query(f"""WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT event_id, user_id, CAST(r AS INTEGER) AS place, {sig_sql('value', 'score')} FROM e WHERE r <= 3""")
def q_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of every peak: a report of three a peak."""
    (events,) = tables(spark, sf_dir, "events")
    return search.top_candidates(events, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).select("event_id", "user_id", "place", sig("value", "score"))


@query(f"""WITH o AS (SELECT user_id, event_id, value - 50 AS err, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events)
SELECT event_id, {sig_sql("coalesce(avg(err) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)", "center")} FROM o""")
def q_adaptive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    rows = events.withColumn("err", F.col("value") - 50)
    return search.adaptive_errors(rows, ["user_id"], "ts", "err", "average").select("event_id", sig("center", "center"))


@query("""SELECT c, h FROM (SELECT unnest(range(1, 41)) AS c) x, (SELECT unnest(range(4, 83)) AS h) y WHERE h <= 2 * c + 2
EXCEPT SELECT CAST(p_size AS BIGINT), CAST(2 * p_size AS BIGINT) FROM part""")
def q_grid_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carbon and hydrogen pairs that the stored formulas don't have yet."""
    (part,) = tables(spark, sf_dir, "part")
    pairs = search.atom_grid(spark, [("c", 1, 40), ("h", 4, 82)]).where("h <= 2 * c + 2").select(F.col("c").cast("bigint").alias("c"), F.col("h").cast("bigint").alias("h"))
    return pairs.exceptAll(part.select(F.col("p_size").cast("bigint").alias("c"), (2 * F.col("p_size")).cast("bigint").alias("h")).distinct()).distinct()


@query()
def q_priority_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line number a spectrum whose peaks are the formulas its parts write, off by a few ppm: classes assigned in turns."""
    lines, part = tables(spark, sf_dir, "lineitem", "part")
    n = {"C": 1 + F.col("p_size") % 30, "H": 4 + F.col("p_partkey") % 47, "O": F.col("p_partkey") % 11, "N": F.col("p_size") % 2}
    mass = fm.mz(fm.neutral_mass(F.create_map(*[x for k, c in n.items() for x in (F.lit(k), c.cast("int"))])), F.lit(1), F.lit("protonated"))
    off = lines.groupBy(F.col("l_linenumber").alias("spectrum"), F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("_off"), F.sum("l_quantity").alias("abundance"))
    peaks = off.join(part.select("p_partkey", mass.alias("_mz")), "p_partkey").select("spectrum", F.col("p_partkey").alias("peak_idx"), (F.col("_mz") * (1 + F.col("_off") * 4e-5)).alias("mz"), "abundance")
    forms = search.candidates(spark, [("C", 1, 30), ("H", 4, 62), ("O", 0, 10), ("N", 0, 1)], (50.0, 600.0), (0.0, 25.0))
    got = priority.assigned(peaks, forms, ["spectrum"], [("protonated", None)], 1, (-5.0, 5.0), 3.0, 3)
    return got.select("spectrum", "peak_idx", fm.text(F.col("atoms")).alias("formula"), "class", "turn", "best", sig(F.round("error_ppm", 3), "error_ppm"))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT l_linenumber AS scan, row_number() OVER (PARTITION BY l_linenumber ORDER BY mz) - 1 AS i, mz FROM (SELECT DISTINCT l_linenumber, l_extendedprice / 100.0 AS mz FROM lineitem)),
m AS (SELECT a.scan, a.i, b.i AS j, abs(b.mz - (a.mz + {filters.CH2})) AS gap FROM p a JOIN p b ON a.scan = b.scan AND b.mz BETWEEN a.mz + {filters.CH2} - 0.002 AND a.mz + {filters.CH2} + 0.002),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY scan, i ORDER BY gap, j) = 1), l AS MATERIALIZED (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY scan, j ORDER BY gap, i) = 1),
w(scan, chain, i, place) AS (SELECT scan, i, i, 0::BIGINT FROM p WHERE (scan, i) NOT IN (SELECT (scan, j) FROM l) UNION ALL SELECT w.scan, w.chain, l.j, w.place + 1 FROM w JOIN l ON l.scan = w.scan AND l.i = w.i)
SELECT scan, i AS peak_idx, chain, place, count(*) OVER (PARTITION BY scan, chain) AS length FROM w""")
def q_kendrick_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of a line number one CH2 apart, chained."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    peaks = lines.select(F.col("l_linenumber").alias("scan"), (F.col("l_extendedprice") / 100.0).alias("mz")).distinct()
    return filters.kendrick_chains(filters.indexed(peaks, ["scan"]), ["scan"], tolerance=0.002)


_SWAPS = ", ".join(f"({k}, '{name}', {r!r}::DOUBLE, {d!r}::DOUBLE)" for k, (name, _, r, d) in enumerate(search.SWAPS) if name in "CHONS")


@query(f"""WITH f AS (SELECT p_partkey, 1 + p_size AS C, 4 + p_partkey % 59 AS H, p_partkey % 11 AS O, p_partkey % 3 AS N, p_size % 2 AS S FROM part), w(k, name, r, d) AS (VALUES {_SWAPS}),
s AS MATERIALIZED (SELECT p_partkey, k, name, r, d, CASE name WHEN 'C' THEN C WHEN 'O' THEN O WHEN 'N' THEN N WHEN 'S' THEN S END AS n FROM f, w), o AS (SELECT * FROM s WHERE n > 0),
i AS (SELECT p_partkey, n * r AS ratio, d FROM o UNION ALL SELECT p_partkey, n * (n - 1) / 2 * r * r, 2 * d FROM o WHERE n > 1
 UNION ALL SELECT a.p_partkey, a.n * a.r * b.r * CASE WHEN a.name = b.name THEN a.n - 1 ELSE b.n END, a.d + b.d FROM o a JOIN o b ON a.p_partkey = b.p_partkey AND a.k < b.k WHERE a.name <> b.name OR a.n > 1)
SELECT p_partkey, count(*) AS n, {sig_sql('sum(ratio)', 'ratio')}, {sig_sql('max(ratio)', 'top')}, {sig_sql('sum(ratio * d)', 'shift')} FROM i WHERE ratio >= 0.0001 GROUP BY p_partkey""")
def q_isotopologues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected isotopologues of the formula that each part writes: how many, their ratios and mean shift."""
    (part,) = tables(spark, sf_dir, "part")
    n = {"C": 1 + F.col("p_size"), "H": 4 + F.col("p_partkey") % 59, "O": F.col("p_partkey") % 11, "N": F.col("p_partkey") % 3, "S": F.col("p_size") % 2}
    rows = part.select("p_partkey", F.map_filter(F.create_map(*[x for k, c in n.items() for x in (F.lit(k), c.cast("int"))]), lambda _, v: v > 0).alias("atoms"), F.lit(0.0).alias("mz_calc"), F.lit(1.0).alias("abundance"))
    got = search.isotopologues(rows, 10_000.0)
    return got.groupBy("p_partkey").agg(F.count("*").alias("n"), sig(F.sum("prob_ratio"), "ratio"), sig(F.max("prob_ratio"), "top"), sig(F.sum(F.col("prob_ratio") * F.col("iso_mz")), "shift"))
