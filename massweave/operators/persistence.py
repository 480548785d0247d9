"""Mass features of a two-dimensional grid by zero-dimensional persistence, tile by tile.

The cells of a sparse grid join their eight neighbours from the highest value down. Where two groups meet, the one
with the lower peak ends: its peak's height is its birth, the height of the meeting its death.

A tile of cells solves what it can alone: each cell falls to its highest neighbour, so that only peaks and the
passes between their basins are left, which are merged from the highest pass down. A group that reaches the
tile's border stays open, since a higher peak may join it from outside; what merges below a known higher peak is
decided. Peaks of open groups, the undecided passes and the border cells go on to tiles of ``fan`` times the
side, where seams become passes, until one tile holds a sample's whole grid, whose size by then is that of a
tile's border. So no task ever holds a sample's cells, and the tiling doesn't change the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massweave.operators.suppress import greedy_suppress
from massweave.storage import shared_folder

#: What a tile passes on: peaks of open groups, passes between such, border cells with a peak of their group, decided peaks.
PEAK, PASS, BORDER, DECIDED = range(4)
PASSED_ON = "kind int, ax long, ay long, a double, bx long, by long, w double"


def touching(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of cells that touch, corners included, each pair once."""
    order = np.lexsort((y, x))
    width = int(y.max() - y.min()) + 3
    code = ((x - x.min()) * width + (y - y.min()))[order]
    found = []
    for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
        want = code + dx * width + dy
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        hit = code[at] == want
        found.append((order[np.flatnonzero(hit)], order[at[hit]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def basins(x: np.ndarray, y: np.ndarray, h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The peak that each cell falls to; of equal heights the cell of smaller (x, y) is the higher one."""
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((-y, -x, h))] = np.arange(len(h))
    best = rank.copy()
    np.maximum.at(best, i, rank[j])
    np.maximum.at(best, j, rank[i])
    up = np.argsort(rank)[best]
    while not np.array_equal(up[up], up):
        up = up[up]
    return up


def merged(birth: list[tuple], is_open: list[bool], passes: list[tuple[float, int, int]]) -> tuple[list[tuple[int, float | None]], list[int], list[tuple[int, int, float]]]:
    """Groups of nodes joined from the highest pass down: (node, death) decided, nodes still needed, passes among them.

    A closed group has one undecided peak, its highest. It ends where it meets a higher one, even if that is in an
    open group, whose peak can only rise; against a lower peak of an open group it waits.
    """
    n = len(birth)
    parent, top, some_open = list(range(n)), list(range(n)), [k if is_open[k] else -1 for k in range(n)]
    decided, kept, waits = [], [], [False] * n

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for w, a, b in sorted(passes, reverse=True):
        p, q = find(a), find(b)
        if p == q:
            continue
        if birth[top[p]] < birth[top[q]]:
            p, q = q, p
        if some_open[q] < 0:
            decided.append((top[q], w))
        elif some_open[p] < 0:
            kept.append((top[p], some_open[q], w))
            waits[top[p]] = True
        else:
            kept.append((some_open[p], some_open[q], w))
        parent[q] = p
        some_open[p] = max(some_open[p], some_open[q])
    decided += [(top[k], None) for k in range(n) if parent[k] == k and some_open[k] < 0]
    return decided, [k for k in range(n) if is_open[k] or waits[k]], kept


def passed_on(xs: list, ys: list, hs: list, passes: list[tuple[float, int, int]], border: list[tuple]) -> list[tuple]:
    """Records of a tile of nodes (xs, ys, hs), passes between nodes and border cells (x, y, height, node)."""
    is_open = [False] * len(xs)
    for *_, k in border:
        is_open[k] = True
    decided, nodes, kept = merged(list(zip(hs, (-v for v in xs), (-v for v in ys))), is_open, passes)
    out = [(DECIDED, xs[k], ys[k], hs[k], None, None, w) for k, w in decided if w is None or w < hs[k]]
    out += [(PEAK, xs[k], ys[k], hs[k], None, None, None) for k in nodes]
    out += [(PASS, xs[a], ys[a], None, xs[b], ys[b], w) for a, b, w in kept]
    return out + [(BORDER, x, y, h, xs[k], ys[k], None) for x, y, h, k in border]


def rim(tile: tuple[int, int], side: int, last: bool):
    """Whether a cell lies on the tile's border; the last tile has none."""
    (x0, y0), end = (tile[0] * side, tile[1] * side), side - 1
    return lambda x, y: not last and (x in (x0, x0 + end) or y in (y0, y0 + end))


def of_cells(tile: tuple[int, int], cells: pd.DataFrame, side: int, last: bool) -> list[tuple]:
    cells = cells.groupby(["x", "y"], as_index=False)["h"].max()
    x, y, h = cells["x"].to_numpy(np.int64), cells["y"].to_numpy(np.int64), cells["h"].to_numpy(float)
    i, j = touching(x, y)
    up = basins(x, y, h, i, j)
    peaks, node = np.unique(up, return_inverse=True)
    a, b, w = np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.minimum(h[i], h[j])
    between = np.flatnonzero(a != b)
    between = between[np.lexsort((-w[between], b[between], a[between]))]
    # The highest pass of each pair of basins.
    first = np.r_[True, (np.diff(a[between]) != 0) | (np.diff(b[between]) != 0)] if len(between) else np.empty(0, bool)
    at = between[first]
    on_rim = rim(tile, side, last)
    border = [c for c in zip(x.tolist(), y.tolist(), h.tolist(), node.tolist()) if on_rim(c[0], c[1])]
    return passed_on(x[peaks].tolist(), y[peaks].tolist(), h[peaks].tolist(), list(zip(w[at].tolist(), a[at].tolist(), b[at].tolist())), border)


def of_tiles(tile: tuple[int, int], records: pd.DataFrame, side: int, last: bool) -> list[tuple]:
    peaks, passes, border = (records[records["kind"] == k] for k in (PEAK, PASS, BORDER))
    xs, ys, hs = peaks["ax"].tolist(), peaks["ay"].tolist(), peaks["a"].tolist()
    node = {c: k for k, c in enumerate(zip(xs, ys))}
    links = [(w, node[a], node[b]) for a, b, w in zip(zip(passes["ax"], passes["ay"]), zip(passes["bx"].astype("int64"), passes["by"].astype("int64")), passes["w"].tolist())]
    cells = [(x, y, h, node[b]) for x, y, h, b in zip(border["ax"].tolist(), border["ay"].tolist(), border["a"].tolist(), zip(border["bx"].astype("int64"), border["by"].astype("int64")))]
    if cells:
        x, y = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
        for i, j in zip(*(v.tolist() for v in touching(x, y))):
            if cells[i][3] != cells[j][3]:
                links.append((min(cells[i][2], cells[j][2]), cells[i][3], cells[j][3]))
    on_rim = rim(tile, side, last)
    return passed_on(xs, ys, hs, links, [c for c in cells if on_rim(c[0], c[1])])


def features_2d(cells: DataFrame, keys: list[str], x: str, y: str, height: str, tile: int = 128, fan: int = 4) -> DataFrame:
    """keys, x, y, birth, death and persistence of every peak that lasts; ``x`` and ``y`` are whole numbers.

    Peaks that nothing ends die at the smallest height of their keys. Of cells given twice the higher counts, and of
    equal heights the smaller (x, y) is the older peak. Rows with a null or NaN place or height are left out.
    """
    shared_folder(cells.sparkSession)
    rows = cells.select(*keys, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(height).cast("double").alias("h")).dropna(subset=["x", "y", "h"])
    low = rows.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0, extent = low[0] or 0, low[1] or 0, max((low[2] or 0) - (low[0] or 0), (low[3] or 0) - (low[1] or 0)) + 1
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "tx long, ty long", PASSED_ON])

    def level(df: DataFrame, solve, side: int) -> DataFrame:
        last = side >= extent

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            at = (int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0]))
            out = pd.DataFrame(solve(at, pdf, side, last), columns=["kind", "ax", "ay", "a", "bx", "by", "w"]).astype({"bx": "Int64", "by": "Int64"})
            return out.assign(**{k: pdf[k].iloc[0] for k in keys}, tx=at[0], ty=at[1])[[*keys, "tx", "ty", "kind", "ax", "ay", "a", "bx", "by", "w"]]

        return df.groupBy(*keys, "tx", "ty").applyInPandas(run, schema).checkpoint()

    side = tile
    moved = rows.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    state = level(moved.withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)}), of_cells, side)
    found = state.where(F.col("kind") == DECIDED)
    while side < extent:
        side *= fan
        up = {"tx": F.floor(F.col("tx") / fan), "ty": F.floor(F.col("ty") / fan)}
        state = level(state.where(F.col("kind") != DECIDED).withColumns(up), of_tiles, side)
        found = found.union(state.where(F.col("kind") == DECIDED))
    # One more row a key: its smallest height.
    least = rows.groupBy(*keys).agg(F.min("h").alias("_least"))
    own = found.select(*keys, (F.col("ax") + x0).alias(x), (F.col("ay") + y0).alias(y), F.col("a").alias("birth"), F.col("w").alias("_w")).alias("f")
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    joined = own.join(least.alias("l"), same) if keys else own.crossJoin(least.alias("l"))
    death = F.coalesce("_w", "_least")
    return joined.select(*[F.col(f"f.{k}") for k in keys], x, y, "birth", death.alias("death"), (F.col("birth") - death).alias("persistence"))


def features_1d(points: DataFrame, keys: list[str], x: str, height: str, tile: int = 8192) -> DataFrame:
    """keys, x, birth, death and persistence of the peaks of a sampled line: a grid of one row, whose index is the order of x.

    Points of one x are taken in the order of their heights. Rows with a null x or a null or NaN height are left out.
    """
    shared_folder(points.sparkSession)
    rows = points.select(*keys, x, F.col(height).cast("double").alias("_h")).where(F.col(x).isNotNull() & F.col("_h").isNotNull() & ~F.isnan("_h"))
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(x, "_h")) - 1).checkpoint()
    found = features_2d(placed.withColumn("_j", F.lit(0)), keys, "_i", "_j", "_h", tile)
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("f._i") == F.col("p._i")]
    return found.alias("f").join(placed.alias("p"), same).select(*[F.col(f"f.{k}") for k in keys], F.col(f"p.{x}"), "birth", "death", "persistence")


def ranked(points: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """The place, from 0, of a column's value among the distinct values of its keys: the index of a grid's axis."""
    axis = points.select(*keys, column).distinct()
    axis = axis.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(column)) - 1)
    return points.join(axis, [*keys, column])


def smoothed(cells: DataFrame, keys: list[str], x: str, y: str, height: str, radius: tuple[int, int], rounds: int = 1) -> DataFrame:
    """Heights as means over the cells there are within ``radius`` places in both directions, itself included."""
    spread = lambda c, r: F.explode(F.array(*[F.col(c) + s for s in range(-r, r + 1)]))
    for _ in range(rounds):
        own = cells.select(*keys, x, y, F.col(height).alias("_height"), F.col(x).alias("_from_x"), F.col(y).alias("_from_y"))
        met = own.withColumn(x, spread("_from_x", radius[0])).withColumn(y, spread("_from_y", radius[1]))
        here = F.max(F.when((F.col(x) == F.col("_from_x")) & (F.col(y) == F.col("_from_y")), True))
        cells = met.groupBy(*keys, x, y).agg(F.avg("_height").alias(height), here.alias("_here")).where("_here").drop("_here")
    return cells


def find_features(points: DataFrame, keys: list[str], mz: str, rt: str, intensity: str, least: float, persistence: float, mz_tolerance: float, rt_tolerance: float, radius: tuple[int, int] = (0, 1), rounds: int = 1) -> DataFrame:
    """keys, mz, rt, intensity, persistence of a sample's mass features.

    Points above ``least`` of the sample's highest intensity make a grid of their distinct m/z and times; smoothed
    peaks that last longer than ``persistence`` of the highest intensity are features, of which the longest-lived
    within an m/z (relative) and time tolerance stays.
    """
    shared_folder(points.sparkSession)
    top = points.where(F.col(intensity).isNotNull()).withColumn("_top", F.max(intensity).over(Window.partitionBy(*keys)))
    grid = top.where(F.col(intensity) > least * F.col("_top")).select(*keys, mz, rt, F.col(intensity).alias("_h"), "_top")
    grid = ranked(ranked(grid, keys, mz, "_x"), keys, rt, "_y").groupBy(*keys, mz, rt, "_x", "_y").agg(F.sum("_h").alias("_h"), F.first("_top").alias("_top")).checkpoint()
    found = features_2d(smoothed(grid, keys, "_x", "_y", "_h", radius, rounds), keys, "_x", "_y", "_h")
    named = found.join(grid.select(*keys, "_x", "_y", mz, rt, "_top"), [*keys, "_x", "_y"]).where(F.col("persistence") > persistence * F.col("_top"))
    named = named.select(*keys, mz, rt, F.col("birth").alias(intensity), "persistence")
    return greedy_suppress(named, {mz: (mz_tolerance, True), rt: (rt_tolerance, False)}, "persistence", keys, [mz, rt])


def find_features_centroid(points: DataFrame, keys: list[str], mz: str, rt: str, intensity: str, least: float, mz_tolerance: float, rt_tolerance: float) -> DataFrame:
    """Features of centroided runs: points above ``least`` of the sample's highest intensity, of which the most intense within an
    m/z (relative) and time tolerance stays; its intensity is its persistence."""
    top = points.where(F.col(intensity).isNotNull()).withColumn("_top", F.max(intensity).over(Window.partitionBy(*keys)))
    own = top.where(F.col(intensity) > least * F.col("_top")).drop("_top").withColumn("persistence", F.col(intensity).cast("double"))
    return greedy_suppress(own, {mz: (mz_tolerance, True), rt: (rt_tolerance, False)}, "persistence", keys, [mz, rt])
