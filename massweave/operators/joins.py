"""Tolerance joins as bucketed equi-joins: band, interval, nearest, as-of and ladder.

A range condition alone plans as a nested loop. Here the left row gets one bucket and the right row all buckets its
window touches, so that every pair meets once and Spark may hash, sort, broadcast or split as it likes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More standards than any ladder's protocol has: so many rungs are a mistake.
LADDER_RUNGS = 100_000


def band_join(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float, ppm: bool = False, how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """Pairs with ``abs(x - y) <= tolerance``, or within so many parts per million of y. x and y are positive if ppm.

    Joins that keep the right side's unmatched rows are refused: those rows stand in several buckets.
    """
    if how.lower().replace("outer", "").strip("_ ") in ("right", "full"):
        raise ValueError(f"a band join can't be {how}: join its pairs back to the right side")
    if ppm:
        width = math.log1p(tolerance * 1e-6) * 2
        place = lambda c: F.floor(F.ln(c) / width)
        low, high = F.col(y) * (1 - tolerance * 1e-6), F.col(y) * (1 + tolerance * 1e-6)
        exact = F.abs(F.col(x) - F.col(y)) <= F.col(y) * (tolerance * 1e-6)
    else:
        width = tolerance or 1.0
        place = lambda c: F.floor(c / width)
        low, high = F.col(y) - tolerance, F.col(y) + tolerance
        exact = F.abs(F.col(x) - F.col(y)) <= tolerance
    a = left.withColumn("_k", place(F.col(x)))
    # A little wider than the window: rounding must not cost a pair on a bucket's edge.
    slack = 1e-9 * F.abs(F.col(y)) + 1e-12
    b = right.withColumn("_k", F.explode(F.sequence(place(low - slack), place(high + slack))))
    keys = a["_k"] == b["_k"]
    for k in on or ():
        keys &= a[k].eqNullSafe(b[k])
    out = a.join(b, keys & exact, how)
    for k in on or ():
        out = out.drop(b[k])
    return out.drop("_k")


def interval_join(left: DataFrame, right: DataFrame, x: str, low: str, high: str, width: float, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs with ``low <= x <= high``; ``width`` is about the windows' usual width."""
    a = left.withColumn("_k", F.floor(F.col(x) / width))
    b = right.withColumn("_k", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    fits = (a["_k"] == b["_k"]) & F.col(x).between(F.col(low), F.col(high))
    return a.join(b, fits if extra is None else fits & extra, how).drop("_k")


def window_join(left: DataFrame, right: DataFrame, windows: list[tuple[str, str, str, float]], on: list[str] | None = None) -> DataFrame:
    """Pairs with ``low <= x <= high`` in every window (x, low, high, width): an equi-join on one bucket a dimension."""
    a = left.withColumns({f"_k{i}": F.floor(F.col(x) / width) for i, (x, _, _, width) in enumerate(windows)})
    b = right
    for i, (_, low, high, width) in enumerate(windows):
        b = b.withColumn(f"_k{i}", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    keys = [*(on or []), *[f"_k{i}" for i in range(len(windows))]]
    out = a.join(b, keys)
    for x, low, high, _ in windows:
        out = out.where(F.col(x).between(F.col(low), F.col(high)))
    return out.drop(*[f"_k{i}" for i in range(len(windows))])


#: Tolerances of a range that one window of the nearest join covers; ranges of one that has no tolerance.
RANGE_WIDTHS, RANGES = 64, 200


def nearest_join(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float | None = None, on: list[str] | None = None, upper_tie: bool = True) -> DataFrame:
    """Each left row with the right row of nearest y; at equal distance the upper one if asked.

    Ranges of x are ordered on their own, so no key's rows meet in one task. With a tolerance the right rows near a range's ends stand in
    both ranges. Without one the ranges are quantiles of y, and each gets the last right row before it and the first behind it, found from one
    row a range. Rows with a null x or y meet nothing.
    """
    keys = on or []
    left, right = left.where(F.col(x).isNotNull()), right.where(F.col(y).isNotNull())
    if tolerance:
        place = lambda c: F.floor(c / (RANGE_WIDTHS * tolerance))
        slack = 1e-9 * F.abs(F.col(y)) + 1e-12
        ranged = right.withColumn("_r", F.explode(F.sequence(place(F.col(y) - tolerance - slack), place(F.col(y) + tolerance + slack))))
        return _nearest(left.withColumn("_r", place(F.col(x))), ranged, right.columns, x, y, tolerance, keys, upper_tie)
    cuts = sorted(set(right.select(F.col(y).cast("double").alias(y)).approxQuantile(y, [k / RANGES for k in range(1, RANGES)], 1 / RANGES)))
    ends = F.array(*map(F.lit, cuts)).cast("array<double>")
    place = lambda c: F.size(F.filter(ends, lambda e: e <= c.cast("double"))).cast("long")
    own = right.withColumn("_r", place(F.col(y)))
    row = F.struct(*right.columns)
    per = own.groupBy(*keys, "_r").agg(F.min_by(row, y).alias("_first"), F.max_by(row, y).alias("_last"))
    w = Window.partitionBy(*keys)
    # Every range of a key that has left rows, one row each, with what its neighbours pass on.
    none = [F.lit(None).cast(per.schema[c].dataType).alias(c) for c in ("_first", "_last")]
    spots = per.union(left.select(*keys, place(F.col(x)).alias("_r"), *none)).groupBy(*keys, "_r").agg(F.first("_first", ignorenulls=True).alias("_first"), F.first("_last", ignorenulls=True).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", ignorenulls=True).over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1))
    passed = spots.withColumns({"_before": before, "_after": after}).select("_r", F.explode(F.array_compact(F.array("_before", "_after"))).alias("_b")).select("_b.*", "_r")
    return _nearest(left.withColumn("_r", place(F.col(x))), own.unionByName(passed), right.columns, x, y, tolerance, keys, upper_tie)


def _nearest(left: DataFrame, right: DataFrame, columns: list[str], x: str, y: str, tolerance: float | None, keys: list[str], upper_tie: bool) -> DataFrame:
    """The nearest join within ranges ``_r``: one union and two ordered windows."""
    value = F.struct(*columns)
    same = [*[F.col(k).alias(f"_{k}") for k in keys], F.col("_r")]
    a = left.select(*same, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_left"), F.struct(*[c for c in left.columns if c != "_r"]).alias("_a"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_b"))
    b = right.select(*same, F.col(y).cast("double").alias("_x"), F.lit(0).alias("_left"), F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), value.alias("_b"))
    both = a.unionByName(b)
    w = Window.partitionBy(*[f"_{k}" for k in keys], "_r")
    before = F.last("_b", ignorenulls=True).over(w.orderBy("_x", "_left").rowsBetween(Window.unboundedPreceding, 0))
    # Looking back in descending order: a frame to the end of the partition would be read anew for every row.
    after = F.last("_b", ignorenulls=True).over(w.orderBy(F.col("_x").desc(), "_left").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"_p": before, "_n": after}).where("_left = 1")
    down, up = F.col("_x") - F.col(f"_p.{y}"), F.col(f"_n.{y}") - F.col("_x")
    upper = F.col("_p").isNull() | (F.col("_n").isNotNull() & ((up <= down) if upper_tie else (up < down)))
    out = found.select("_a.*", F.when(upper, F.col("_n")).otherwise(F.col("_p")).alias("_m"), F.when(upper, up).otherwise(down).alias("distance"))
    out = out.select(*[F.col(c) for c in left.columns if c != "_r"], *[F.col(f"_m.{c}").alias(c) for c in columns if c not in keys], "distance")
    return out if tolerance is None else out.where(F.col("distance") <= tolerance)


def ladder(points: DataFrame, rungs: DataFrame, x: str, at: str, value: str, out: str = "ri", on: list[str] | None = None) -> DataFrame:
    """Linear interpolation of ``value`` between the rungs around x; outside, the nearest two rungs' line goes on.

    A ladder's range is cut into as many cells as it has rungs, the outer ones without end; a step between two rungs stands in the cells that it
    touches, twice as many as rungs at most, and points meet it by their cell. Points without a ladder of two rungs are left out; more than ``LADDER_RUNGS`` rungs are refused.
    """
    keys = on or []
    if rungs.limit(LADDER_RUNGS + 1).count() > LADDER_RUNGS:
        raise ValueError(f"a ladder of more than {LADDER_RUNGS} rungs")
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(at)
    steps = rungs.select(*keys, F.col(at).cast("double").alias("_l"), F.col(value).alias("_lv"), F.lead(F.col(at).cast("double")).over(ordered).alias("_r"), F.lead(value).over(ordered).alias("_rv"), F.row_number().over(ordered).alias("_n"), F.count("*").over(w).alias("_all"), F.min(at).over(w).cast("double").alias("_from"), F.max(at).over(w).cast("double").alias("_to"))
    steps = steps.where("_r is not null and _to > _from")
    cell = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col("_all") - 1, F.floor((c - F.col("_from")) / (F.col("_to") - F.col("_from")) * F.col("_all"))))
    spans = steps.select(*keys, "_from", "_to", "_all").distinct()
    steps = steps.withColumns({"_low": F.when(F.col("_n") == 1, F.lit(-math.inf)).otherwise(F.col("_l")), "_high": F.when(F.col("_n") == F.col("_all") - 1, F.lit(math.inf)).otherwise(F.col("_r"))})
    steps = steps.withColumn("_cell", F.explode(F.sequence(cell(F.col("_l")), cell(F.col("_r"))))).select(*keys, "_cell", "_low", "_high", "_l", "_lv", "_r", "_rv")
    # Without keys there is one ladder, one row.
    placed = points.join(spans, keys) if keys else points.join(F.broadcast(spans))
    placed = placed.withColumn("_cell", cell(F.col(x).cast("double"))).drop("_from", "_to", "_all")
    joined = placed.join(steps, [*keys, "_cell"]).where((F.col(x) >= F.col("_low")) & (F.col(x) < F.col("_high")))
    line = F.col("_lv") + (F.col("_rv") - F.col("_lv")) * (F.col(x) - F.col("_l")) / (F.col("_r") - F.col("_l"))
    return joined.withColumn(out, line).select(*points.columns, out)


def marked(rows: DataFrame, seen: DataFrame, key: str, out: str) -> DataFrame:
    """The rows with whether their key is among those seen, however often."""
    found = seen.select(key).distinct().withColumn(out, F.lit(True))
    return rows.join(found, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def unique_matches(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs whose key occurs once only: ambiguous references go, all of them."""
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def unique_band_join(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float, key: str, ppm: bool = False, fits: Column | None = None) -> DataFrame:
    """As ``unique_matches`` of a band join on a key of the right side, without the pairs of ambiguous keys.

    Distinct values meet each other with their counts, so that a value which many rows share costs one row. ``fits`` is a
    further condition on x and y.
    """
    met = band_join(left.groupBy(x).agg(F.count("*").alias("_n")), right.select(y).distinct(), x, y, tolerance, ppm)
    met = met if fits is None else met.where(fits)
    near = met.groupBy(y).agg(F.sum("_n").alias("_n"), F.min(x).alias(x))
    hits = right.join(near, y).withColumn("_all", F.sum("_n").over(Window.partitionBy(key))).where("_all = 1")
    return left.join(hits.drop("_n", "_all"), x).select(*left.columns, *right.columns)


def nearest_ppm(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float, tie: str) -> DataFrame:
    """Each distinct x with the right row of least ppm error within the tolerance, of equal ones that of the smallest ``tie``.

    Of the values below x the highest is nearest and of those above it the lowest, so only these two are looked at.
    """
    row = F.struct(tie, *[c for c in right.columns if c != tie])
    met = band_join(left.select(x).distinct(), right.select(y).distinct(), x, y, tolerance, ppm=True)
    ends = met.groupBy(x).agg(F.max(F.when(F.col(y) <= F.col(x), F.col(y))).alias("_low"), F.min(F.when(F.col(y) >= F.col(x), F.col(y))).alias("_high"))
    ends = ends.select(x, F.explode(F.array_distinct(F.array_compact(F.array("_low", "_high")))).alias(y))
    rated = ends.join(right.groupBy(y).agg(F.min(row).alias("_row")), y)
    best = rated.groupBy(x).agg(F.min(F.struct(F.abs((F.col(x) - F.col(y)) / F.col(y) * 1e6).alias("e"), F.col("_row"))).alias("_b"))
    return best.select(x, *[F.col(f"_b._row.{c}").alias(c) for c in right.columns])


def neighbour_sums(points: DataFrame, key: str, x: str, tolerance: float) -> DataFrame:
    """key, n, total: how many rows of other keys lie within the tolerance of a key's rows, and the sum of their x; keys without any are left out.

    Distinct values meet each other with their counts; what rows of the same key add is then taken off.
    """
    rows = points.where(F.col(key).isNotNull() & F.col(x).isNotNull()).groupBy(key, x).agg(F.count("*").alias("_c"))
    values = rows.groupBy(x).agg(F.sum("_c").alias("_m"))
    met = band_join(values, values.select(F.col(x).alias("_y")), x, "_y", tolerance)
    near = met.groupBy(F.col("_y").alias(x)).agg(F.sum("_m").alias("_n"), F.sum(F.col(x) * F.col("_m")).alias("_s"))
    # A key of one value meets its own rows only there.
    spread = F.min(x).over(Window.partitionBy(key)) < F.max(x).over(Window.partitionBy(key))
    rows = rows.withColumn("_spread", spread)
    many = rows.where("_spread")
    own = band_join(many.select(key, x, F.col("_c").alias("_o")), many.select(key, F.col(x).alias("_y"), "_c"), x, "_y", tolerance, on=[key])
    own = own.groupBy(key).agg(F.sum(F.col("_c") * F.col("_o")).alias("_n"), F.sum(F.col(x) * F.col("_c") * F.col("_o")).alias("_s"))
    alone = F.when(F.col("_spread"), F.lit(0)).otherwise(F.col("_c"))
    gross = rows.join(near, x).select(key, (F.col("_c") * (F.col("_n") - alone)).alias("_n"), (F.col("_c") * (F.col("_s") - F.col(x) * alone)).alias("_s"))
    every = gross.union(own.select(key, -F.col("_n"), -F.col("_s")))
    return every.groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_s").alias("total")).where("n > 0")


def nominal_bucket(mz: Column, overlay: float = 0.1) -> Column:
    """Integer masses that a peak may belong to: its own, and the neighbour if it lies within ``overlay`` of it."""
    own = F.floor(mz)
    defect = mz - own
    return F.when(defect <= overlay, F.array(own, own - 1)).when(defect >= 1 - overlay, F.array(own, own + 1)).otherwise(F.array(own))
