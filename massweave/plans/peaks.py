"""Calibration, peak tables, chromatograms and feature associations over whole tables.

Line items of a number are a spectrum: price as m/z (in hundreds), quantity as abundance. Events of a user are a
run: hours as retention time, value as m/z, their type as the kind of scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massweave.operators import calibration as cal
from massweave.operators import fits, joins, lc, overlap, profile, workflow
from massweave.operators import recalibration as rc
from massweave.operators import spectrum as sp
from massweave.plans.registry import query, seconds, sig, sig_sql, tables

SPECTRUM = "SELECT l_linenumber AS scan, l_orderkey, l_extendedprice / 100.0 AS mz, l_quantity AS abundance, l_discount, l_tax FROM lineitem"
#: A calibrant's frequency in units of 100 kHz is 1000 / m/z, off by a discount in ppm; so is its reference's m/z by a tax.
POINTS = f"SELECT *, 1000.0 / (mz * (1 + l_discount * 1e-4)) AS f, mz * (1 + l_tax * 1e-5) AS mz_calc FROM ({SPECTRUM})"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_linenumber").alias("scan"), "l_orderkey", (F.col("l_extendedprice") / 100.0).alias("mz"), F.col("l_quantity").alias("abundance"), "l_discount", "l_tax")


def calibrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    mz = F.col("mz")
    return spectra(spark, sf_dir).withColumns({"frequency": cal.SCALE * (1000.0 / (mz * (1 + F.col("l_discount") * 1e-4))), "mz_calc": mz * (1 + F.col("l_tax") * 1e-5)})


def _rms(kind: str, fit: str) -> str:
    return f"""WITH p AS (SELECT *, 1 / f AS u FROM ({POINTS})), s AS ({fit}), m AS (SELECT scan, mz_calc, a * u + b * u * u + c AS mz_cal FROM p JOIN s USING (scan))
SELECT scan, count(*) AS n, round(sqrt(avg(power((mz_cal - mz_calc) / mz_calc * 1e6, 2))), 3) AS rms_ppm FROM m GROUP BY scan"""


def _calibrated(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    points = calibrants(spark, sf_dir)
    out = cal.frequency_calibrated(points, cal.frequency_fit(points, ["scan"], kind), ["scan"])
    return out.groupBy("scan").agg(F.count("*").alias("n"), F.round(cal.rms_ppm(), 3).alias("rms_ppm"))


@query(_rms("linear", "SELECT scan, regr_slope(mz_calc, u) AS a, 0.0 AS b, regr_intercept(mz_calc, u) AS c FROM p GROUP BY scan"))
def q_calibrate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "linear")


@query(_rms("ledford", """SELECT scan, (sum(u * mz_calc) * sum(power(u, 4)) - sum(u * u * mz_calc) * sum(power(u, 3))) / (sum(u * u) * sum(power(u, 4)) - power(sum(power(u, 3)), 2)) AS a,
(sum(u * u) * sum(u * u * mz_calc) - sum(power(u, 3)) * sum(u * mz_calc)) / (sum(u * u) * sum(power(u, 4)) - power(sum(power(u, 3)), 2)) AS b, 0.0 AS c FROM p GROUP BY scan"""))
def q_calibrate_ledford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "ledford")


# Centred sums: the covariance form of the same fit.
_QUADRATIC = """SELECT scan, (suy * svv - svy * suv) / (suu * svv - suv * suv) AS a, (svy * suu - suy * suv) / (suu * svv - suv * suv) AS b,
ay - (suy * svv - svy * suv) / (suu * svv - suv * suv) * au - (svy * suu - suy * suv) / (suu * svv - suv * suv) * av AS c FROM
(SELECT scan, avg(u) AS au, avg(u * u) AS av, avg(mz_calc) AS ay, covar_pop(u, u) AS suu, covar_pop(u * u, u * u) AS svv, covar_pop(u, u * u) AS suv, covar_pop(u, mz_calc) AS suy, covar_pop(u * u, mz_calc) AS svy FROM p GROUP BY scan)"""


@query(_rms("quadratic", _QUADRATIC))
def q_calibrate_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "quadratic")


@query(f"""WITH p AS (SELECT scan, l_orderkey, mz, mz / 1000.0 AS u, (l_discount - l_tax) * 100 AS y FROM ({SPECTRUM})), s AS ({_QUADRATIC.replace("mz_calc", "y")})
SELECT scan, l_orderkey, round(mz / (1 + (a * u + b * u * u + c) * 1e-6), 5) AS mz_cal FROM p JOIN s USING (scan)""")
def q_error_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order trend of the ppm error over m/z, taken off every peak."""
    points = spectra(spark, sf_dir).withColumn("error_ppm", (F.col("l_discount") - F.col("l_tax")) * 100)
    fit = cal.error_fit(points, ["scan"], 2)
    return cal.error_corrected(points, fit, ["scan"]).select("scan", "l_orderkey", F.round("mz_cal", 5).alias("mz_cal"))


@query(f"""WITH e AS (SELECT scan, regr_slope((l_discount - l_tax) * 100, mz) AS s, regr_intercept((l_discount - l_tax) * 100, mz) AS i FROM ({SPECTRUM}) GROUP BY scan)
SELECT scan, l_orderkey, round(mz / (1 + (s * mz + i) * 1e-6), 5) AS mz_cal FROM ({SPECTRUM}) JOIN e USING (scan)""")
def q_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spectra(spark, sf_dir).withColumn("error_ppm", (F.col("l_discount") - F.col("l_tax")) * 100)
    return sp.calibrated(points, points, ["scan"]).select("scan", "l_orderkey", F.round("mz_cal", 5).alias("mz_cal"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS r FROM orders), p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS mz, o_orderkey, r, (l_extendedprice - r) / r * 1e6 AS e FROM lineitem JOIN o ON l_extendedprice BETWEEN r * (1 - 1.1e-5) AND r * (1 + 1.1e-5) WHERE l_quantity >= 10),
k AS (SELECT * FROM p WHERE e > -10 AND e < 10 AND abs(mz - r) <= r * 1e-5) SELECT o_orderkey, l_orderkey, l_linenumber, round(e, 5) AS error_ppm FROM k WHERE r IN (SELECT r FROM k GROUP BY r HAVING count(*) = 1)""")
def q_calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = tables(spark, sf_dir, "lineitem", "orders")
    peaks = lines.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("s2n"))
    refs = orders.select("o_orderkey", F.col("o_totalprice").alias("ref_mz"))
    return sp.calibration_points(peaks, refs, (-10.0, 10.0), 10.0).select("o_orderkey", "l_orderkey", "l_linenumber", F.round("error_ppm", 5).alias("error_ppm"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY mz, l_orderkey) - 1 AS i FROM ({SPECTRUM})), k AS (SELECT scan, l_orderkey, mz, row_number() OVER (PARTITION BY scan ORDER BY mz, l_orderkey) - 1 AS j FROM n WHERE abundance >= 10)
SELECT scan, CAST(floor(mz) AS INTEGER) AS nominal, min(j) AS first_idx, max(j) AS last_idx, count(*) AS n, CAST(CAST(floor(mz) AS BIGINT) % 2 AS INTEGER) AS odd FROM k GROUP BY scan, floor(mz)""")
def q_nominal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak peaks dropped by their index, the others numbered anew, then counted by nominal mass."""
    order = ["mz", "l_orderkey"]
    peaks = sp.numbered(spectra(spark, sf_dir), ["scan"], order)
    left = sp.without(peaks, peaks.where("abundance < 10"), ["scan"], order)
    out = sp.nominal_ranges(left, ["scan"])
    return out.select("scan", "nominal", F.col("first_idx").cast("long").alias("first_idx"), F.col("last_idx").cast("long").alias("last_idx"), "n", F.col("odd").cast("int").alias("odd"))


@query(f"SELECT scan, count(*) AS n, {sig_sql('sum(abundance)', 'abundance')} FROM ({SPECTRUM}) WHERE abundance * 20000 < 1.274e7 * 1 * 15.0 * 1.5 / mz GROUP BY scan")
def q_max_resolving_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = spectra(spark, sf_dir).withColumns({"resolving_power": F.col("abundance") * 20000, "ion_charge": F.lit(1)})
    return sp.below_resolving_power(peaks, 15.0, 1.5).groupBy("scan").agg(F.count("*").alias("n"), sig(F.sum("abundance"), "abundance"))


RUN = "SELECT user_id, event_id, event_type, epoch(ts) / 3600.0 AS t, value FROM events"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "event_type", (seconds() / 3600.0).alias("t"), "value")


PADDED = """WITH pts AS (SELECT user_id, epoch(ts) / 3600.0 AS x, max(value) AS y FROM events WHERE value IS NOT NULL GROUP BY ALL),
side AS (SELECT user_id, count(*) AS n, min(x) AS a0, min(x) FILTER (k = 2) AS a1, max(x) AS b0, min(x) FILTER (r = 2) AS b1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS k, row_number() OVER (PARTITION BY user_id ORDER BY x DESC) AS r FROM pts) GROUP BY user_id),
every AS (SELECT * FROM pts UNION ALL SELECT user_id, a0 - k * (a1 - a0), 0 FROM side, range(1, 4) g(k) WHERE n > 1 UNION ALL SELECT user_id, b0 + k * (b0 - b1), 0 FROM side, range(1, 4) g(k) WHERE n > 1),
p AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(y) OVER w AS yp, lead(y) OVER w AS yn, lag(x) OVER w AS xp, lead(x) OVER w AS xn FROM every WINDOW w AS (PARTITION BY user_id ORDER BY x)),
runs AS MATERIALIZED (SELECT *, max(CASE WHEN yp IS NULL OR NOT y > yp THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS start_i, max(CASE WHEN yp IS NULL OR y < yp THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS left_i,
 min(CASE WHEN yn IS NULL OR NOT yn < y THEN i END) OVER (PARTITION BY user_id ORDER BY i DESC) AS final_i, min(CASE WHEN yn IS NULL OR yn > y THEN i END) OVER (PARTITION BY user_id ORDER BY i DESC) AS right_i FROM p),
apex AS MATERIALIZED (SELECT r.*, l.y AS left_y, g.y AS right_y FROM runs r JOIN p l ON l.user_id = r.user_id AND l.i = r.left_i JOIN p g ON g.user_id = r.user_id AND g.i = r.right_i WHERE r.y > r.yp AND r.y > r.yn)"""
HALVES = """low AS (SELECT a.user_id, a.i, max(p.i) AS j FROM apex a JOIN p ON p.user_id = a.user_id AND p.i < a.i AND p.y < a.y / 2 GROUP BY ALL),
high AS (SELECT a.user_id, a.i, min(p.i) AS j FROM apex a JOIN p ON p.user_id = a.user_id AND p.i > a.i AND p.y < a.y / 2 GROUP BY ALL),
wide AS (SELECT a.user_id, a.i, lo.x + (lo.xn - lo.x) * (a.y / 2 - lo.y) / (lo.yn - lo.y) AS left_x, ro.xp + (ro.x - ro.xp) * (a.y / 2 - ro.yp) / (ro.y - ro.yp) AS right_x
 FROM apex a JOIN low USING (user_id, i) JOIN high h USING (user_id, i) JOIN p lo ON lo.user_id = a.user_id AND lo.i = low.j JOIN p ro ON ro.user_id = a.user_id AND ro.i = h.j)"""


@query(f"""{PADDED}, {HALVES},
low_points AS (SELECT user_id, y FROM (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS e FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY x)) WHERE y < b AND y <= e),
noise AS (SELECT user_id, median(y) * 2 AS noise, stddev_pop(y) * 3 AS noise_std FROM low_points GROUP BY user_id), top AS (SELECT user_id, max(y) AS top FROM pts GROUP BY user_id),
fits AS (SELECT *, (y - yp) / (x - xp) AS d01, ((yn - y) / (xn - x) - (y - yp) / (x - xp)) / (xn - xp) AS curve FROM apex),
placed AS (SELECT *, CASE WHEN (xp + x) / 2 - d01 / (2 * curve) < 1 OR trunc((xp + x) / 2 - d01 / (2 * curve)) <> trunc(x) THEN x ELSE (xp + x) / 2 - d01 / (2 * curve) END AS mz FROM fits)
SELECT user_id, i - 3 AS apex_idx, start_i - 3 AS start_idx, final_i - 3 AS final_idx, round(mz, 4) AS mz, {sig_sql("yp + d01 * (mz - xp) + curve * (mz - xp) * (mz - x)", "height")},
 {sig_sql("CASE WHEN i >= 5 AND n - i >= 5 THEN x / (right_x - left_x) END", "resolving_power")}, {sig_sql("(yp + d01 * (mz - xp) + curve * (mz - xp) * (mz - x)) / nullif(noise_std, 0)", "s2n")}
FROM placed LEFT JOIN wide USING (user_id, i) JOIN noise USING (user_id) JOIN top USING (user_id)
WHERE final_i - start_i >= 5 AND y >= noise - 1.0 * noise_std AND (y - greatest(left_y, right_y)) / top * 100 > 0.1""")
def q_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's trace as a profile spectrum: centroids above the noise of its minima."""
    points = run(spark, sf_dir).where("value is not null").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    minima = sp.extremes(points, ["user_id"], "t", "value", minima=True).withColumnRenamed("value", "abundance")
    out = profile.centroids(points, ["user_id"], "t", "value", sp.minima_noise(minima, ["user_id"]), threshold=-1.0)
    return out.select("user_id", "apex_idx", "start_idx", "final_idx", F.round("mz", 4).alias("mz"), sig("centroid_abundance", "height"), sig("resolving_power", "resolving_power"), sig("s2n", "s2n"))


@query(f"""WITH p AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS b, lead(value) OVER w AS e FROM ({RUN}) WINDOW w AS (PARTITION BY user_id ORDER BY t)), a AS (SELECT user_id, i, t, value, event_id FROM p WHERE value > b AND value >= e),
l AS (SELECT a.event_id, max(p.i) AS j FROM a JOIN p ON p.user_id = a.user_id AND p.i < a.i AND p.value < a.value / 2 GROUP BY a.event_id),
r AS (SELECT a.event_id, min(p.i) AS j FROM a JOIN p ON p.user_id = a.user_id AND p.i > a.i AND p.value < a.value / 2 GROUP BY a.event_id),
x AS (SELECT a.event_id, lo.t + (li.t - lo.t) * (a.value / 2 - lo.value) / (li.value - lo.value) AS left_t, ro.t + (ri.t - ro.t) * (a.value / 2 - ro.value) / (ri.value - ro.value) AS right_t FROM a
 LEFT JOIN l USING (event_id) LEFT JOIN r USING (event_id) LEFT JOIN p lo ON lo.user_id = a.user_id AND lo.i = l.j LEFT JOIN p li ON li.user_id = a.user_id AND li.i = l.j + 1
 LEFT JOIN p ro ON ro.user_id = a.user_id AND ro.i = r.j LEFT JOIN p ri ON ri.user_id = a.user_id AND ri.i = r.j - 1)
SELECT event_id, round(left_t, 4) AS left_t, round(right_t, 4) AS right_t FROM x""")
def q_half_height_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.half_height_widths(run(spark, sf_dir), ["user_id"], "t", "value")
    return out.select("event_id", F.round("left", 4).alias("left_t"), F.round("right", 4).alias("right_t"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, scan (day), mz, intensity."""
    return run(spark, sf_dir).select(F.col("user_id").alias("sample"), F.floor(F.col("t") / 24).alias("scan"), F.col("value").alias("mz"), (F.col("value") * 2).alias("intensity"))


DAYS = f"SELECT user_id AS sample, CAST(floor(t / 24) AS BIGINT) AS scan, value AS mz, value * 2 AS intensity FROM ({RUN})"


@query(f"SELECT sample, scan, {sig_sql('sum(intensity)', 'tic')}, {sig_sql('max(intensity)', 'base_peak')} FROM ({DAYS}) GROUP BY sample, scan")
def q_total_ion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.total_ion(points(spark, sf_dir)).select("sample", "scan", sig("tic", "tic"), sig("base_peak", "base_peak"))


@query(f"SELECT sample, scan, CAST(floor(mz / 4 + 0.5) * 4 AS INTEGER) AS cell, {sig_sql('sum(intensity)', 'intensity')} FROM ({DAYS}) GROUP BY ALL")
def q_gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.gridded(points(spark, sf_dir), 4.0).select("sample", "scan", F.col("mz").cast("int").alias("cell"), sig("intensity", "intensity"))


@query(f"""WITH d AS ({DAYS}), c AS (SELECT sample, scan, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT sample, scan FROM (SELECT *, sum(n) OVER w AS every, count(*) OVER w AS scans FROM c WINDOW w AS (PARTITION BY sample)) WHERE n * scans >= every), n AS (SELECT sample, count(*) AS n FROM s GROUP BY sample)
SELECT sample, CAST(floor(mz / 4 + 0.5) * 4 AS INTEGER) AS cell, {sig_sql('sum(intensity) / any_value(n)', 'intensity')} FROM d JOIN s USING (sample, scan) JOIN n USING (sample) GROUP BY sample, cell""")
def q_average_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    # The scans with at least the sample's mean number of points.
    counts = own.groupBy("sample", "scan").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample")
    scans = counts.where("n > 0").withColumns({"every": F.sum("n").over(w), "scans": F.count("*").over(w)}).where("n * scans >= every").select("sample", "scan")
    return lc.average_spectrum(own, scans, 4.0).select("sample", F.col("mz").cast("int").alias("cell"), sig("intensity", "intensity"))


@query(f"""WITH d AS ({DAYS}), g AS (SELECT unnest(range(1, 21)) AS target), h AS (SELECT sample, target, scan, sum(intensity) AS v FROM d JOIN g ON abs(mz - 10.0 * target) <= 10.0 * target * 0.02 GROUP BY ALL),
s AS (SELECT DISTINCT sample, scan FROM d), k AS (SELECT DISTINCT sample, target FROM h) SELECT sample, CAST(target AS INTEGER) AS target, scan, {sig_sql('coalesce(v, 0)', 'intensity')} FROM s JOIN k USING (sample) LEFT JOIN h USING (sample, target, scan)""")
def q_chromatograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ion chromatograms of a list of targets, zero where a scan has none."""
    own = points(spark, sf_dir)
    targets = spark.range(1, 21).select(F.col("id").cast("int").alias("target"), (F.col("id") * 10.0).alias("target_mz"))
    scans = own.select("sample", "scan", F.col("scan").alias("rt")).distinct()
    return lc.chromatograms(own, scans, targets, 20_000.0).select("sample", "target", "scan", sig("intensity", "intensity"))


@query(f"""WITH r AS ({RUN}) SELECT f.event_id AS mf_id, s.event_id AS ms2_scan FROM r f JOIN r s ON f.user_id = s.user_id AND f.event_type = 'purchase' AND s.event_type <> 'purchase'
AND f.value BETWEEN s.value - 5.0 AND s.value + 5.0 AND f.t BETWEEN s.t - 12.0 AND s.t + 12.0""")
def q_associate_ms2(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = run(spark, sf_dir)
    features = own.where("event_type = 'purchase'").select(F.col("user_id").alias("sample"), F.col("event_id").alias("mf_id"), F.col("value").alias("mz"), F.col("t").alias("rt"))
    ms2 = own.where("event_type <> 'purchase'").select(F.col("user_id").alias("sample"), F.col("event_id").alias("scan"), F.col("value").alias("precursor_mz"), F.col("t").alias("rt"))
    return lc.associate_ms2(features, ms2, 12.0, 5.0).select("mf_id", "ms2_scan")


@query(f"""WITH RECURSIVE r AS ({RUN}), one AS (SELECT f.user_id, s.event_id AS child, min(f.event_id) AS parent FROM r f JOIN r s ON f.user_id = s.user_id AND abs(f.value - (s.value - 3.0)) <= 1.0 AND abs(f.t - s.t) <= 24 AND f.event_id <> s.event_id GROUP BY ALL),
w(user_id, mf_id, root, n) AS (SELECT user_id, child, parent, 1 FROM one o WHERE NOT EXISTS (SELECT 1 FROM one x WHERE x.user_id = o.user_id AND x.child = o.parent) UNION ALL SELECT o.user_id, o.child, w.root, w.n + 1 FROM w JOIN one o ON o.user_id = w.user_id AND o.parent = w.mf_id)
SELECT mf_id, root AS monoisotopic, concat('13C', n) AS label FROM w""")
def q_isotope_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = run(spark, sf_dir).select(F.col("user_id").alias("sample"), F.col("event_id").alias("mf_id"), F.col("value").alias("mz"), F.col("t").alias("rt"))
    return lc.isotope_chains(lc.isotope_pairs(features, 3.0, 1.0, 24.0)).select("mf_id", "monoisotopic", "label")


@query(f"""WITH d AS (SELECT user_id, event_id, floor(t / 24) AS day, CAST(floor(value / 20) AS INTEGER) AS g, value FROM ({RUN})), c AS (SELECT user_id, g, count(DISTINCT day) * 1.0 / count(*) AS f FROM d GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY value DESC, event_id) AS r FROM d JOIN c USING (user_id, g)) SELECT event_id AS mf_id FROM k WHERE f < 0.95 OR r <= 3""")
def q_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir).select(F.col("user_id").alias("sample"), F.col("event_id").alias("mf_id"), F.floor(F.col("t") / 24).alias("apex_scan"), F.floor(F.col("value") / 20).cast("int").alias("g"), F.col("value").alias("intensity"))
    return lc.redundant(rows, "g", 0.95, 3).select("mf_id")


#: Spectra as cells: the share of common cells, their order and their ratios.
_CELLS = "SELECT user_id, event_type AS kind, CAST(floor(value / 5) + 1 AS INTEGER) AS mz, sum(value) AS v FROM events GROUP BY ALL"


@query(f"""WITH c AS ({_CELLS}), k AS (SELECT DISTINCT user_id, kind FROM c), g AS (SELECT a.user_id, a.kind AS query, b.kind AS ref FROM k a JOIN k b USING (user_id) WHERE a.kind <> b.kind),
j AS (SELECT user_id, query, ref, mz, sum(x) AS x, sum(y) AS y FROM (SELECT g.*, mz, v AS x, 0 AS y FROM g JOIN c ON c.user_id = g.user_id AND c.kind = query UNION ALL SELECT g.*, mz, 0, v FROM g JOIN c ON c.user_id = g.user_id AND c.kind = ref) GROUP BY ALL),
o AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM j WHERE x > 0 AND y > 0 WINDOW w AS (PARTITION BY user_id, query, ref ORDER BY mz)),
r AS (SELECT user_id, query, ref, count(*) AS n, coalesce(sum(least(y / py * px / x, x / px * py / y)), 0) / count(*) AS sr FROM o GROUP BY ALL),
t AS (SELECT user_id, query, ref, count(*) FILTER (x > 0) AS nx, sum(sqrt(x * y) * power(mz, 6)) / sqrt(sum(x * power(mz, 6)) * sum(y * power(mz, 6))) AS wc, sum(sqrt(x * y) * power(mz, 2.6)) / sqrt(sum(x * power(mz, 2.6)) * sum(y * power(mz, 2.6))) AS wn FROM j GROUP BY ALL)
SELECT user_id, query, ref, {sig_sql('CASE WHEN n IS NULL THEN 0.0 ELSE (nx * wc + n * sr) / (nx + n) END', 'stein_scott')}, {sig_sql('CASE WHEN n IS NULL THEN 0.0 ELSE (nx * wn + n * sr) / (nx + n) END', 'stein_scott_nist')} FROM t LEFT JOIN r USING (user_id, query, ref)""")
def q_stein_scott(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two kinds of a user's events as query and reference."""
    from massweave.functions.similarity import stein_scott

    (events,) = tables(spark, sf_dir, "events")
    cells = events.groupBy("user_id", "event_type", (F.floor(F.col("value") / 5) + 1).cast("int").alias("mz")).agg(F.sum("value").alias("v"))
    kinds = cells.select("user_id", F.col("event_type").alias("query")).distinct()
    pairs = kinds.join(kinds.withColumnRenamed("query", "ref"), "user_id").where("query != ref")
    side = lambda name, x, y: pairs.join(cells.withColumnRenamed("event_type", name), ["user_id", name]).select("user_id", "query", "ref", "mz", x.alias("x"), y.alias("y"))
    both = side("query", F.col("v"), F.lit(0.0)).union(side("ref", F.lit(0.0), F.col("v"))).groupBy("user_id", "query", "ref", "mz").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return stein_scott(both, ["user_id", "query", "ref"]).select("user_id", "query", "ref", sig("stein_scott", "stein_scott"), sig("stein_scott_nist", "stein_scott_nist"))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks off their reference by parts of a discount and a tax."""
    mz = F.col("mz")
    return spectra(spark, sf_dir).withColumns({"ref_mz": mz * (1 + F.col("l_tax") * 1e-5), "mz": mz * (1 + F.col("l_discount") * 1e-5)}).withColumn("error_ppm", (F.col("mz") - F.col("ref_mz")) / F.col("ref_mz") * 1e6)


_SHIFTED = f"SELECT scan, l_orderkey, mz * (1 + l_discount * 1e-5) AS mz, mz * (1 + l_tax * 1e-5) AS ref_mz FROM ({SPECTRUM})"


@query(f"""WITH p AS ({_SHIFTED}), w AS (SELECT scan, mz / 1000 AS x, ref_mz - mz AS d, 1 / (ref_mz * ref_mz) AS w FROM p WHERE mz BETWEEN 300 AND 700),
m AS (SELECT scan, sum(w * x) / sum(w) AS mx, sum(w * d) / sum(w) AS md FROM w GROUP BY scan), b AS (SELECT scan, any_value(mx) AS mx, any_value(md) AS md, sum(w * (x - mx) * (d - md)) / sum(w * (x - mx) * (x - mx)) AS k FROM w JOIN m USING (scan) GROUP BY scan)
SELECT scan, l_orderkey, round(CASE WHEN mz BETWEEN 300 AND 700 THEN mz + md + k * (mz / 1000 - mx) ELSE mz END, 6) AS mz_cal FROM p LEFT JOIN b USING (scan)""")
def q_recalibrate_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of least ppm error between 300 and 700, for the peaks there."""
    points = shifted(spark, sf_dir)
    fit = rc.mz_fit(points.where(F.col("mz").between(300, 700)), ["scan"])
    return rc.mz_calibrated(points, fit, ["scan"], (300, 700)).select("scan", "l_orderkey", F.round("mz_cal", 6).alias("mz_cal"))


@query()
def q_recalibrate_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error ranges from each spectrum's density of errors; the points inside make the fit, outliers of which go in rounds."""
    points = shifted(spark, sf_dir)
    ranges = rc.error_ranges(points, ["scan"])
    fit = rc.robust_fit(rc.chosen(points, ranges, ["scan"]), ["scan"], 2)
    return rc.mz_calibrated(points, fit, ["scan"]).select("scan", "l_orderkey", F.round("mz_cal", 5).alias("mz_cal"))


@query(f"""WITH p AS (SELECT scan, mz, avg(mz * (1 + l_tax * 1e-5)) AS mz_calc, 1e8 / (mz * (1 + avg(l_discount) * 1e-5)) AS f FROM ({SPECTRUM}) GROUP BY scan, mz), o AS (SELECT *, 1e5 / f AS u, row_number() OVER (PARTITION BY scan ORDER BY mz) - 1 AS i, count(*) OVER (PARTITION BY scan) AS n FROM p),
g AS (SELECT *, (n - 1 - 400) // 400 AS top, unnest(CASE WHEN i % 400 = 0 THEN [i // 400, i // 400 - 1] ELSE [i // 400] END) AS b FROM o WHERE n > 400), k AS (SELECT * FROM g WHERE b >= 0 AND b <= top AND i <= (b + 1) * 400),
s AS (SELECT scan, b, (sum(u * mz_calc) * sum(power(u, 4)) - sum(u * u * mz_calc) * sum(power(u, 3))) / (sum(u * u) * sum(power(u, 4)) - power(sum(power(u, 3)), 2)) AS c1,
 (sum(u * u) * sum(u * u * mz_calc) - sum(power(u, 3)) * sum(u * mz_calc)) / (sum(u * u) * sum(power(u, 4)) - power(sum(power(u, 3)), 2)) AS c2 FROM k GROUP BY scan, b)
SELECT scan, round(mz, 4) AS mz, round(coalesce(c1 * u + c2 * u * u, mz), 3) AS mz_cal FROM o LEFT JOIN s ON s.scan = o.scan AND s.b = least(o.i // 400, (n - 1 - 400) // 400)""".replace("SELECT scan, round(mz, 4)", "SELECT o.scan, round(mz, 4)"))
def q_step_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits over 400 consecutive points each."""
    points = spectra(spark, sf_dir).groupBy("scan", "mz").agg(F.avg(F.col("mz") * (1 + F.col("l_tax") * 1e-5)).alias("mz_calc"), F.avg("l_discount").alias("_d"))
    points = points.withColumn("frequency", 1e8 / (F.col("mz") * (1 + F.col("_d") * 1e-5))).drop("_d")
    out = rc.step_calibrated(points.select("scan", "mz", "frequency"), points, ["scan"], 400)
    return out.select("scan", F.round("mz", 4).alias("mz"), F.round("mz_cal", 3).alias("mz_cal"))


@query(f"""WITH v AS (SELECT scan, (mz - ref_mz) / ref_mz * 1e6 AS v FROM ({_SHIFTED})), s AS (SELECT scan, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(count(*)::DOUBLE, -0.2) AS b FROM v GROUP BY scan),
g AS (SELECT *, unnest(range(200)) AS place FROM s), x AS (SELECT *, lo - 3 * b + place * (hi - lo + 6 * b) / 199 AS x FROM g)
SELECT scan, CAST(place AS INTEGER) AS place, {sig_sql("sum(exp(-0.5 * power((x - v) / b, 2))) / any_value(n * b * sqrt(2 * pi()))", "density")} FROM x JOIN v USING (scan) GROUP BY scan, place""")
def q_error_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.density(shifted(spark, sf_dir), ["scan"], "error_ppm").select("scan", "place", sig("density", "density"))


@query()
def q_power_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of a resolving power that is usual in their spectrum."""
    peaks = spectra(spark, sf_dir).withColumn("resolving_power", 1e8 * (1 + F.col("l_tax") * F.col("abundance") / 50) / F.col("mz"))
    return rc.resolving_power_filter(peaks, ["scan"], 1.5).select("scan", "l_orderkey", sig("resolving_power", "resolving_power"))


@query()
def q_peak_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's fortnight as a peak over hours: pseudo-Voigt shapes."""
    points = run(spark, sf_dir).withColumn("fortnight", F.floor(F.col("t") / 336))
    got = fits.fitted(points, ["user_id", "fortnight"], "t", "value", "pseudo_voigt")
    return got.select("user_id", "fortnight", *[sig(c, c) for c in ("centre", "fwhm", "height", "gamma", "rms")])


@query()
def q_lc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of event a run over days: features with the bounds, area and width of their peaks."""
    (events,) = tables(spark, sf_dir, "events")
    day = F.floor(seconds() / 86400)
    rows = events.where("value is not null").select(F.col("event_type").alias("sample"), day.alias("scan"), (100.0 + F.floor(F.col("value") / 10) * 10).alias("mz"), F.col("value").alias("intensity"))
    scans = rows.select("sample", "scan", F.col("scan").cast("double").alias("rt")).distinct()
    points = rows.groupBy("sample", "scan", "mz").agg(F.sum("intensity").alias("intensity"))
    found = workflow.features(points, scans, 0.01, 0.05, 0.02, 2.0)
    whole = workflow.integrated(found, points, scans, 1000.0, 3, drop_if_fail=False)
    return whole.select("sample", "mf_id", "mz", "rt", sig("intensity", "intensity"), "start_rt", "final_rt", sig("area", "area"), sig("half_height_width", "half_height_width"))


@query()
def q_peak_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest peak of every user's trace: widths by scans, tailing and likeness to a Gaussian."""
    points = run(spark, sf_dir).where("value is not null").groupBy("user_id", F.col("t").alias("rt")).agg(F.max("value").alias("intensity"))
    trace = points.select(F.lit("all").alias("sample"), F.col("user_id").alias("mf_id"), "rt", "intensity")
    peaks = profile.extents(trace, ["sample", "mf_id"], "rt", "intensity", 3)
    best = peaks.groupBy("sample", "mf_id").agg(F.max(F.struct("apex_y", "apex_x", "start_x", "final_x")).alias("p")).select("sample", "mf_id", F.col("p.start_x").alias("start_rt"), F.col("p.final_x").alias("final_rt"))
    got = workflow.peak_shapes(best, trace, accept_estimated=True)
    return got.select(F.col("mf_id").alias("user_id"), *[sig(c, c) for c in ("half_height_min", "half_height_max", "tailing_factor", "gaussian_similarity")])


@query()
def q_predicted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that neighbours make: prices of a line number and ship month as peaks of a resolving power that falls with m/z."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    peaks = lines.select("l_linenumber", F.date_trunc("month", "l_shipdate").alias("month"), (F.col("l_extendedprice") / 1000.0).alias("mz"), "l_quantity")
    peaks = peaks.groupBy("l_linenumber", "month", "mz").agg(F.sum("l_quantity").alias("abundance")).withColumn("resolving_power", 2e5 / F.col("mz"))
    got = overlap.predicted(peaks, ["l_linenumber", "month"], 0.25, 0.1, 40)
    return got.select("l_linenumber", "month", F.round("mz", 5).alias("mz"), F.round("mass_shift_ppm", 2).alias("mass_shift_ppm"), F.round("predicted_error_ppm", 2).alias("predicted_error_ppm"))
