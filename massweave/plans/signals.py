"""Spectrum and trace operators: events of a user as a trace over time, line items of a number as a spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.operators import sequence as seq
from massweave.operators import spectrum as sp
from massweave.operators import deconvolution, lc, persistence, suppress
from massweave.operators import recalibration as rc
from massweave.plans.registry import ORACLES, query, seconds, sig, sig_columns, sig_sql, tables

TRACE = "(SELECT user_id, event_id, event_type, epoch(ts) / 3600.0 AS t, value FROM events)"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "event_type", (seconds() / 3600.0).alias("t"), "value")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_linenumber").alias("scan"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("abundance"), "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")


def _neighbours(test: str) -> str:
    return f"""WITH w AS (SELECT *, lag(value) OVER o AS p, lead(value) OVER o AS n FROM {TRACE} WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, {sig_sql("value", "height")} FROM w WHERE {test}"""


@query(_neighbours("value > p AND value >= n"))
def q_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.extremes(trace(spark, sf_dir), ["user_id"], "t", "value").select("event_id", sig("value", "height"))


@query(_neighbours("value < p AND value <= n"))
def q_local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.extremes(trace(spark, sf_dir), ["user_id"], "t", "value", minima=True).select("event_id", sig("value", "height"))


@query(f"""WITH w AS (SELECT *, row_number() OVER o AS x, lag(value) OVER o AS p, lead(value) OVER o AS n FROM {TRACE} WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, {sig_sql("x + (p - n) / (2 * (p - 2 * value + n))", "place")}, {sig_sql("value - (p - n) * (p - n) / (8 * (p - 2 * value + n))", "height")} FROM w WHERE value > p AND value >= n""")
def q_parabola_apex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    numbered = trace(spark, sf_dir).withColumn("x", F.row_number().over(Window.partitionBy("user_id").orderBy("t")).cast("double"))
    apex = sp.extremes(numbered, ["user_id"], "x", "value")
    place, height = sp.parabola_apex((F.col("_px"), F.col("x"), F.col("_nx")), (F.col("_p"), F.col("value"), F.col("_n")))
    return apex.select("event_id", sig(place, "place"), sig(height, "height"))


@query(f"SELECT event_id, {sig_sql('round(value - lag(value) OVER (PARTITION BY user_id ORDER BY t), 4)', 'd1')} FROM {TRACE}")
def q_first_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.derivative(trace(spark, sf_dir), ["user_id"], "t", "value", "d").select("event_id", sig(F.round("d", 4), "d1"))


@query(f"SELECT event_id, {sig_sql('round(lead(value) OVER o - 2 * value + lag(value) OVER o, 4)', 'd2')} FROM {TRACE} WINDOW o AS (PARTITION BY user_id ORDER BY t)")
def q_second_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.derivative(trace(spark, sf_dir), ["user_id"], "t", "value", "d", 2).select("event_id", sig(F.round("d", 4), "d2"))


def _smooth_sql(method: str, window: int) -> str:
    weights = seq.kernel(method, window)
    half = window // 2
    at = [f"lag(value, {half - k}) OVER o" if k < half else f"lead(value, {k - half}) OVER o" for k in range(window)]
    total = " + ".join(f"coalesce({a} * {w!r}, 0)" for a, w in zip(at, weights))
    share = " + ".join(f"CASE WHEN {a} IS NULL THEN 0 ELSE {w!r} END" for a, w in zip(at, weights))
    return f"WITH s AS (SELECT event_id, ({total}) / ({share}) AS v FROM {TRACE} WINDOW o AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, {sig_sql('round(v * 1.00000000001, 4)', 'smooth')} FROM s"


def _register_smooth(method: str, window: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return seq.smoothed(trace(spark, sf_dir), ["user_id"], "t", "value", "s", seq.kernel(method, window)).select("event_id", sig(F.round(F.col("s") * 1.00000000001, 4), "smooth"))

    query(_smooth_sql(method, window), f"q_smooth_{method}")(run)


for _method in ("savgol", "flat", "hamming", "bartlett"):
    _register_smooth(_method, 5)


@query(f"""WITH w AS (SELECT *, (value + lag(value) OVER o) / 2 * (t - lag(t) OVER o) AS a FROM {TRACE} WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, {sig_sql("coalesce(sum(a), 0)", "area")} FROM w GROUP BY user_id""")
def q_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.trapezoid(trace(spark, sf_dir), ["user_id"], "t", "value").select("user_id", sig("area", "area"))


@query(f"""WITH w AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id) AS s FROM {TRACE})
SELECT user_id, {sig_sql("stddev_pop(CASE WHEN s < 0.5 THEN t END)", "dispersity")} FROM w GROUP BY user_id""")
def q_dispersity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.dispersity(trace(spark, sf_dir), ["user_id"], "t", "value", "event_id").select("user_id", sig("dispersity", "dispersity"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM {TRACE}),
a AS (SELECT user_id, max(value) AS h FROM n GROUP BY user_id), b AS (SELECT n.user_id, h, min(k) AS k0 FROM n JOIN a USING (user_id) WHERE value = h GROUP BY ALL),
s AS (SELECT n.user_id, h, value, CASE WHEN k BETWEEN k0 - 10 AND k0 - 1 THEN 'l' WHEN k BETWEEN k0 + 1 AND k0 + 10 THEN 'r' END AS side FROM n JOIN b USING (user_id)),
r AS (SELECT user_id, side, greatest((h - median(value)) / nullif(stddev_pop(value), 0), 0) AS snr FROM s WHERE side IS NOT NULL GROUP BY user_id, side, h),
z AS (SELECT user_id, max(CASE WHEN side = 'l' THEN snr / (snr + 10) END) AS lft, max(CASE WHEN side = 'r' THEN snr / (snr + 10) END) AS rgt FROM r GROUP BY user_id)
SELECT user_id, {sig_sql("least(lft, rgt)", "noise_score_min")}, {sig_sql("greatest(lft, rgt)", "noise_score_max")} FROM z""")
def q_noise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.noise_scores(trace(spark, sf_dir), ["user_id"], "t", "value", 10).select("user_id", sig("noise_score_min", "noise_score_min"), sig("noise_score_max", "noise_score_max"))


@query(f"""WITH l AS (SELECT user_id, log10(value) AS x FROM {TRACE} WHERE value > 0), s AS (SELECT user_id, min(x) AS lo, max(x) AS hi FROM l GROUP BY user_id),
b AS (SELECT l.user_id, lo, hi, least(49, CAST(floor((x - lo) / (hi - lo) * 50) AS BIGINT)) AS cell FROM l JOIN s USING (user_id) WHERE hi > lo),
c AS (SELECT user_id, lo, hi, cell, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cell) AS r FROM c)
SELECT user_id, {sig_sql("power(10, lo + cell * (hi - lo) / 50)", "noise")}, {sig_sql("power(10, lo + cell * (hi - lo) / 50) * 0.463 * 6", "threshold")} FROM m WHERE r = 1""")
def q_log_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = trace(spark, sf_dir).withColumnRenamed("value", "abundance")
    return sp.log_noise(points, ["user_id"], bins=50).select("user_id", sig("noise", "noise"), sig("threshold", "threshold"))


@query(f"""WITH n AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) // 50 AS c FROM {TRACE}), m AS (SELECT user_id, c, min(value) AS v FROM n GROUP BY ALL)
SELECT user_id, {sig_sql("avg(v)", "noise")}, {sig_sql("stddev_pop(v)", "noise_std")} FROM m GROUP BY user_id""")
def q_chunk_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = trace(spark, sf_dir).withColumnRenamed("value", "abundance")
    return sp.chunk_noise(points, ["user_id"], "t").select("user_id", sig("noise", "noise"), sig("noise_std", "noise_std"))


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM {TRACE} GROUP BY event_type)
SELECT event_id, CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN value END AS kept FROM {TRACE} JOIN q USING (event_type)""")
def q_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.iqr_outliers(trace(spark, sf_dir), ["event_type"], "value", "kept").select("event_id", "kept")


@query(f"""SELECT l_linenumber AS scan, count(*) AS n_peaks, {sig_sql("sum(l_quantity)", "tic")}, {sig_sql("max(l_quantity) / min(l_quantity)", "dynamic_range")},
{sig_sql("sum(l_extendedprice * l_quantity) / sum(l_quantity)", "number_average_mw")}, {sig_sql("sum(l_extendedprice * l_extendedprice * l_quantity) / sum(l_extendedprice * l_quantity)", "weight_average_mw")},
count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_assigned, {sig_sql("100.0 * count(CASE WHEN l_returnflag = 'R' THEN 1 END) / count(*)", "assigned_percent")},
{sig_sql("100 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity)", "assigned_abundance_percent")} FROM lineitem GROUP BY l_linenumber""")
def q_spectrum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sp.summary(spectrum(spark, sf_dir).withColumn("assigned", F.col("l_returnflag") == "R"), ["scan"])
    return got.select("scan", "n_peaks", "n_assigned", *[sig(c, c) for c in ("tic", "dynamic_range", "number_average_mw", "weight_average_mw", "assigned_percent", "assigned_abundance_percent")])


@query("""WITH m AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_linenumber) AS top FROM lineitem)
SELECT l_linenumber AS scan, count(*) AS n FROM m WHERE l_quantity > top * 40.0 / 100 AND l_extendedprice BETWEEN 5000 AND 50000 AND l_discount > 0.02 GROUP BY l_linenumber""")
def q_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sp.noise_filter(spectrum(spark, sf_dir), None, ["scan"], "relative_abundance", 40.0)
    kept = sp.within(sp.within(kept, "mz", 5000, 50000), "l_discount", 0.02)
    return kept.groupBy("scan").agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {sig_sql("1.274e7 * 12.0 * 0.768 * 0.618 / l_extendedprice", "rp")} FROM lineitem
WHERE l_quantity * 100 >= (1 - 0.25) * (1.274e7 * 12.0 * 0.768 * 0.618 / l_extendedprice)""")
def q_resolving_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectrum(spark, sf_dir).withColumn("rp", sp.theoretical_resolving_power(F.col("mz"), 12.0, 0.768, apodization="Hanning"))
    return rows.where(F.col("abundance") * 100 >= (1 - 0.25) * F.col("rp")).select("l_orderkey", "l_partkey", "l_suppkey", F.col("scan").alias("l_linenumber"), sig("rp", "rp"))


@query(f"""WITH s AS (SELECT o_orderpriority, o_totalprice AS x, lag(o_totalprice) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)),
g AS (SELECT *, sum(CASE WHEN x - p > p * 20.0 * 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM s)
SELECT o_orderpriority, {sig_sql("avg(x)", "mz")}, count(*) AS n FROM g GROUP BY o_orderpriority, c""")
def q_chain_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    got = suppress.chain_average(orders.select("o_orderpriority", F.col("o_totalprice").alias("x")), "x", 20.0, ["o_orderpriority"], [])
    return got.select("o_orderpriority", sig("x", "mz"), "n")


@query(f"""SELECT user_id, event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(floor(value / 10) AS BIGINT) AS cell, count(*) AS n, {sig_sql("sum(value)", "intensity")} FROM events GROUP BY ALL""")
def q_grid_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select("user_id", "event_type", F.floor(seconds() / 86400).alias("day"), "value", F.col("value").alias("intensity"))
    return lc.binned(rows, ["user_id", "event_type", "day"], "value", 10, "intensity").select("user_id", "event_type", "day", "cell", "n", sig("intensity", "intensity"))


@query(f"""WITH e AS (SELECT user_id, event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, value FROM events), d AS (SELECT DISTINCT user_id, day FROM e), y AS (SELECT DISTINCT user_id, event_type FROM e),
s AS (SELECT user_id, event_type, day, sum(value) AS v FROM e GROUP BY ALL)
SELECT user_id, event_type, day, {sig_sql("coalesce(v, 0)", "intensity")} FROM d JOIN y USING (user_id) LEFT JOIN s USING (user_id, event_type, day)""")
def q_eic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ion chromatograms on the grid of all scans of their run, zero where nothing was seen."""
    (events,) = tables(spark, sf_dir, "events")
    rows = events.select("user_id", "event_type", F.floor(seconds() / 86400).alias("day"), "value")
    traces = rows.groupBy(F.col("user_id").alias("sample"), "event_type", F.col("day").alias("scan")).agg(F.sum("value").alias("intensity"))
    out = lc.on_scans(traces, traces.select("sample", "scan").distinct(), ["event_type"])
    return out.select(F.col("sample").alias("user_id"), "event_type", F.col("scan").alias("day"), sig("intensity", "intensity"))


@query(f"""SELECT l_linenumber AS scan, {sig_sql("regr_slope(l_quantity, l_extendedprice)", "slope")}, {sig_sql("regr_intercept(l_quantity, l_extendedprice)", "intercept")}, {sig_sql("corr(l_quantity, l_extendedprice)", "r")} FROM lineitem GROUP BY l_linenumber""")
def q_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectrum(spark, sf_dir)
    fit = rc.orthogonal_fit(rows, ["scan"], [F.lit(1.0), F.col("mz")], F.col("abundance"), ["intercept", "slope"])
    r = rows.groupBy("scan").agg(F.corr("abundance", "mz").alias("r"))
    return fit.join(r, "scan").select("scan", sig("slope", "slope"), sig("intercept", "intercept"), sig("r", "r"))


# One pass over the rows of a type by value; ``near`` holds what was kept.
@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT event_type, event_id, epoch(ts) / 3600.0 AS t, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i FROM events WHERE value IS NOT NULL),
k(event_type, i, kept, near) AS (SELECT DISTINCT event_type, 0::BIGINT, NULL::BIGINT, CAST([] AS STRUCT(v DOUBLE, t DOUBLE)[]) FROM r
 UNION ALL SELECT event_type, n.i, CASE WHEN free THEN n.event_id END, CASE WHEN free THEN list_append(n.near, {'v': n.value, 't': n.t}) ELSE n.near END
 FROM (SELECT r.*, list_filter(k.near, lambda x: x.v <= r.value + 0.5) AS near, len(list_filter(k.near, lambda x: abs(x.v - r.value) <= 0.5 AND abs(x.t - r.t) <= 24)) = 0 AS free FROM k JOIN r ON r.event_type = k.event_type AND r.i = k.i + 1) n)
SELECT kept AS event_id, event_type FROM k WHERE kept IS NOT NULL""")
def q_greedy_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace(spark, sf_dir).where("value is not null")
    return suppress.greedy_suppress(rows, {"value": (0.5, False), "t": (24.0, False)}, "value", ["event_type"], ["event_id"]).select("event_id", "event_type")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by line number, day and price: a run's intensities by time and m/z."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_linenumber").alias("sample"), F.datediff("l_shipdate", F.lit("1990-01-01")).alias("scan"), F.floor(F.col("l_extendedprice") / 2000).alias("cell"), "l_quantity")


@query()
def q_features_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every sample's day and price grid with birth, death and persistence."""
    cells = grid(spark, sf_dir).groupBy("sample", "scan", "cell").agg(F.sum("l_quantity").alias("height"))
    return persistence.features_2d(cells, ["sample"], "scan", "cell", "height")


@query()
def q_mass_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From points to features rolled up within a share of the price and some days."""
    points = grid(spark, sf_dir).select("sample", ((F.col("cell") + 1) * 2000.0).alias("mz"), F.col("scan").cast("double").alias("rt"), F.col("l_quantity").alias("intensity"))
    return persistence.find_features(points, ["sample"], "mz", "rt", "intensity", 0.01, 0.05, 0.05, 14.0)


@query()
def q_gc_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds of every line number's weekly price cells: entities with their chromatograms' peaks."""
    (lines,) = tables(spark, sf_dir, "lineitem")
    week = F.floor(F.datediff("l_shipdate", F.lit("1990-01-01")) / 7).cast("double")
    points = lines.select(F.col("l_linenumber").alias("sample"), week.alias("rt"), F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("mz"), F.col("l_quantity").alias("intensity"))
    entities, _ = deconvolution.deconvolved(points, 2.0, 3, 0.01, 0.01, 8.0)
    return entities.select("sample", "rt", sig("tic", "tic"), "start_rt", "final_rt", sig("area", "area"), "n_ions")


@query(f"""WITH p AS MATERIALIZED (SELECT user_id, t, value AS h, row_number() OVER (PARTITION BY user_id ORDER BY t, value) AS i FROM {TRACE} WHERE value IS NOT NULL),
ends AS (SELECT a.user_id, a.i, max(b.i) FILTER (b.i < a.i) AS l, min(b.i) FILTER (b.i > a.i) AS r FROM p a JOIN p b ON a.user_id = b.user_id AND (b.h > a.h OR b.h = a.h AND b.i < a.i) GROUP BY ALL),
lows AS (SELECT e.user_id, e.i, min(p.h) FILTER (p.i BETWEEN l AND e.i) AS left_low, min(p.h) FILTER (p.i BETWEEN e.i AND r) AS right_low FROM ends e JOIN p ON p.user_id = e.user_id GROUP BY ALL)
SELECT p.user_id, round(t, 4) AS t, h AS birth, coalesce(greatest(left_low, right_low), least_h) AS death, h - coalesce(greatest(left_low, right_low), least_h) AS persistence
FROM p LEFT JOIN lows USING (user_id, i) JOIN (SELECT user_id, min(h) AS least_h FROM p GROUP BY user_id) USING (user_id) WHERE greatest(left_low, right_low) IS NULL OR greatest(left_low, right_low) < h""")
def q_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = persistence.features_1d(trace(spark, sf_dir), ["user_id"], "t", "value")
    return found.select("user_id", F.round("t", 4).alias("t"), "birth", "death", "persistence")


@query()
def q_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.dbscan(trace(spark, sf_dir), ["user_id"], ["t", "value"], 0.2, 3).select("event_id", "cluster")


@query()
def q_peak_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.peak_metrics(trace(spark, sf_dir), ["user_id"], "t", "value")


@query(f"""WITH k AS (SELECT *, l_extendedprice * (14.0 / 14.01565006446) AS km FROM lineitem), d AS (SELECT *, floor(km) - km AS kmd FROM k),
g AS (SELECT l_linenumber AS scan, CAST(round(kmd * 100) AS INTEGER) AS series, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 2 AS INTEGER) AS odd, count(*) AS n, sum(l_quantity) AS a FROM d GROUP BY ALL)
SELECT scan, series, odd, n, {sig_sql("a", "abundance")} FROM g WHERE n > 3""")
def q_kendrick_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massweave.functions.formula import kendrick

    rows = spectrum(spark, sf_dir)
    return sp.kendrick_series(rows.withColumn("kmd", kendrick(F.col("mz"))[1]), ["scan"], "kmd").select("scan", "series", "odd", "n", sig("abundance", "abundance"))


_Z = "power(i / 4.0, 2)"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS h, l_extendedprice / 100000.0 AS fwhm, l_extendedprice AS c FROM lineitem), x AS (SELECT *, unnest(range(-8, 9)) AS i FROM p)
SELECT l_orderkey, l_linenumber, {sig_sql("c + fwhm * i / 4", "mz")}, {sig_sql(f"h * exp(-4 * ln(2) * {_Z})", "gaussian")}, {sig_sql(f"h / (1 + 4 * {_Z})", "lorentzian")}, {sig_sql(f"0.5 * h / (1 + 4 * {_Z}) + 0.5 * h * exp(-4 * ln(2) * {_Z})", "pseudo_voigt")} FROM x""")
def q_line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated profiles of every peak at a resolving power of 100,000."""
    return profiles(spectrum(spark, sf_dir))


#: The name that it had beside a query over part of the table.
q_line_shapes_all = query(ORACLES["q_line_shapes"], "q_line_shapes_all")(q_line_shapes)


def profiles(peaks: DataFrame) -> DataFrame:
    from massweave.functions import lineshape as ls

    rows = peaks.withColumn("fwhm", F.col("mz") / 100000.0)
    # Shapes are taken at the offset in widths: the difference of two near m/z values has no digits to spare.
    points = rows.select("l_orderkey", "scan", "mz", "fwhm", "abundance", F.explode(ls.grid(F.lit(0.0), F.lit(1.0))).alias("x"))
    shapes = [f(F.col("x"), F.lit(0.0), F.lit(1.0), F.col("abundance")).alias(f.__name__) for f in (ls.gaussian, ls.lorentzian, ls.pseudo_voigt)]
    drawn = points.select("l_orderkey", F.col("scan").alias("l_linenumber"), (F.col("mz") + F.col("fwhm") * F.col("x")).alias("mz"), *shapes)
    return sig_columns(drawn, drawn.columns[2:])


@query()
def q_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.ward(trace(spark, sf_dir).select("event_id", "user_id", "t"), ["user_id"], "t", 24.0).select("event_id", "user_id", "cluster")
