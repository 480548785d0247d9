"""Greedy suppression, chains and clusters over values with gaps."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.storage import shared_folder, written


def gap_components(df: DataFrame, x: str, gap: Column, keys: list[str], out: str = "component") -> DataFrame:
    """Number the runs of rows, in order of x, whose steps stay within ``gap`` (an expression of the lower row)."""
    w = Window.partitionBy(*keys).orderBy(x)
    stepped = df.withColumn("_g", gap).withColumn("_new", (F.col(x) - F.lag(x).over(w) > F.lag("_g").over(w)).cast("int"))
    return stepped.withColumn(out, F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_g")


#: Cells of a tile's side and of the rim that it sees of its neighbours; tasks, at least, to which tiles are dealt.
TILE, RIM, DEPTH = 256, 16, 32


def greedy_suppress(df: DataFrame, dims: dict[str, tuple[float, bool]], priority: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Keep rows in order of priority unless a kept row is near in every dimension, as one pass over all rows would.

    dims: column -> (tolerance, relative to the kept row's value). Rows lie in cells of a tolerance's width; a
    round sends each row to its tile of cells and to tiles whose rim holds it. A tile goes through its rows by
    priority: one near a kept row is out, one near a cell that holds an undecided row before it waits, others are
    kept. What waits for a rim goes into the next round, after a join has removed all that is near the rows kept.
    The first row of all is always decided, so rounds end; there are as many as tiles that wait for one another,
    however dense the data. A task streams its tiles' ordered rows and holds the kept ones and the waiting cells.
    Rows without a value in some dimension, and negative values of relative ones, are near to nothing. Of equal
    priority and tie, any one comes first.
    """
    shared_folder(df.sparkSession)
    names = list(dims)
    rows = df.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    value = {d: F.col(d).cast("double") for d in names}
    sound = F.lit(True)
    for d, (_, relative) in dims.items():
        sound &= value[d].isNotNull() & ~F.isnan(value[d]) & (value[d] >= 0 if relative else F.lit(True))

    def cell(d: str) -> Column:
        tol, relative = dims[d]
        if not relative:
            return F.floor(value[d] / tol) if tol else F.xxhash64(value[d]) % (1 << 40)
        return F.coalesce(F.floor(F.ln(value[d]) / math.log1p(tol)), F.lit(-(1 << 40)))

    # Cells of a relative dimension are a little narrower than the tolerance below a row.
    reach = [2 if relative else 1 for _, relative in dims.values()]
    cells, at = [f"_c{k}" for k in range(len(names))], [f"_v{k}" for k in range(len(names))]
    order = F.struct(F.coalesce(-F.col(priority).cast("double"), F.lit(math.inf)).alias("p"), *tie, "_id")
    live = rows.where(sound).select(*keys, "_id", *[value[d].alias(v) for d, v in zip(names, at)], *[cell(d).cast("long").alias(c) for d, c in zip(names, cells)], order.alias("_o"))
    spread = [F.array(*[F.col(c) + s for s in range(-r, r + 1)]) for c, r in zip(cells, reach)]
    tols = list(dims.values())

    def near(kept: Column) -> Column:
        test = kept["o"] < F.col("_o")
        for v, (tol, relative) in zip(at, tols):
            test &= F.abs(F.col(v) - kept[v]) <= (kept[v] * tol if relative else F.lit(tol))
        return test

    # Tables, not checkpoints: those carry the estimated sizes of their joins on, whose digits would double every round.
    live, found = written(live), None
    while not live.isEmpty():
        kept = written(tile_winners(live, keys, cells, at, reach, tols))
        found = kept.select("_id") if found is None else found.union(kept.select("_id"))
        # Rows kept are apart, so only few of them are near a cell.
        around = kept
        for c, s in zip(cells, spread):
            around = around.withColumn(c, F.explode(s))
        around = around.groupBy(*keys, *cells).agg(F.collect_list(F.struct(F.col("_o").alias("o"), *at)).alias("_near"))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cells]
        live = written(live.join(kept.select("_id"), "_id", "left_anti").alias("a").join(around.hint("merge").alias("b"), same, "left").where(F.col("_near").isNull() | ~F.exists("_near", near)).select("a.*"))
    out = rows.where(~F.coalesce(sound, F.lit(False)))
    if found is not None:
        out = out.union(rows.join(found, "_id", "left_semi").select(rows.columns))
    return out.select(df.columns)


def tile_winners(live: DataFrame, keys: list[str], cells: list[str], at: list[str], reach: list[int], tols: list[tuple[float, bool]]) -> DataFrame:
    """Live rows that are kept for sure, as their tile sees it."""
    tiles, rim = [f"_t{k}" for k in range(len(cells))], min(RIM, TILE)  # only neighbours are seen
    sent = live.withColumn("_k", F.struct(*[F.col(k) for k in keys])) if keys else live.withColumn("_k", F.lit(0))
    for c, t in zip(cells, tiles):
        own, inside = F.floor(F.col(c) / TILE), F.pmod(F.col(c), F.lit(TILE))
        sent = sent.withColumn(t, F.explode(F.array_compact(F.array(own, F.when(inside < rim, own - 1), F.when(inside >= TILE - rim, own + 1)))))
    # A row's own cell comes first: in dense data it mostly holds the kept row.
    offsets = sorted(itertools.product(*[range(-r, r + 1) for r in reach]), key=lambda o: any(o))

    def decide(batches):
        for pdf in batches:
            winners = []
            for i, rank, cell, values in zip(range(len(pdf)), pdf["_rank"].tolist(), zip(*[pdf[c].tolist() for c in cells]), zip(*[pdf[v].tolist() for v in at])):
                if rank == 1:
                    low = [int(pdf[t].iloc[i]) * TILE for t in tiles]
                    kept: dict[tuple, list[tuple]] = {}
                    waiting: set[tuple] = set()
                if cell in waiting:  # out or waiting, which changes nothing for those behind it
                    continue
                about = (tuple(a + b for a, b in zip(cell, o)) for o in offsets)
                if any(all(abs(x - k) <= (k * t if rel else t) for x, k, (t, rel) in zip(values, other, tols)) for a in about for other in kept.get(a, ())):
                    continue
                if any(c - r < lo - rim or c + r >= lo + TILE + rim for c, lo, r in zip(cell, low, reach)) or any(tuple(a + b for a, b in zip(cell, o)) in waiting for o in offsets):
                    waiting.add(cell)
                    continue
                kept.setdefault(cell, []).append(values)
                if all(lo <= c < lo + TILE for c, lo in zip(cell, low)):
                    winners.append(i)
            yield pdf.iloc[winners][["_id"]]

    # Tiles come one after the other, each in order from rank 1, whatever the types of the tie.
    tasks = max(DEPTH, 2 * live.sparkSession.sparkContext.defaultParallelism)
    ranked = sent.repartition(tasks, "_k", *tiles).withColumn("_rank", F.row_number().over(Window.partitionBy("_k", *tiles).orderBy("_o")))
    ids = ranked.select(*tiles, "_rank", "_id", *cells, *at).mapInPandas(decide, "_id long")
    return live.join(ids, "_id", "left_semi")


def chain_average(df: DataFrame, x: str, ppm: float, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Neighbours within ppm chained together and averaged."""
    return gap_components(df, x, F.col(x) * ppm * 1e-6, keys, "_c").groupBy(*keys, "_c").agg(F.avg(x).alias(x), F.count("*").alias("n"), *aggs).drop("_c")


def dbscan(df: DataFrame, keys: list[str], dims: list[str], eps: float, min_points: int, scale: bool = True) -> DataFrame:
    """Cluster numbers within each group, -1 for noise; dimensions are standardised first if asked."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[dims].to_numpy(float)
        if scale and len(v):
            s = v.std(0)
            v = (v - v.mean(0)) / np.where(s > 0, s, 1)
        order = np.argsort(v[:, 0], kind="stable")
        firsts = v[order, 0]
        label = np.full(len(v), -1)

        def near(i: int) -> np.ndarray:
            a, b = np.searchsorted(firsts, [v[i, 0] - eps, v[i, 0] + eps + 1e-12])
            c = order[a:b]
            return c[((v[c] - v[i]) ** 2).sum(1) <= eps * eps]

        k = 0
        for i in range(len(v)):
            if label[i] >= 0 or len(near(i)) < min_points:
                continue
            label[i], stack = k, [i]
            while stack:
                own = near(stack.pop())
                if len(own) >= min_points:
                    fresh = own[label[own] < 0]
                    label[fresh] = k
                    stack.extend(fresh.tolist())
            k += 1
        return pdf.assign(cluster=label)

    return df.groupBy(*keys).applyInPandas(run, fields + ", cluster int")


def ward(df: DataFrame, keys: list[str], x: str, limit: float, out: str = "cluster") -> DataFrame:
    """Clusters of one dimension by Ward's linkage, merged while their distance is at most ``limit``.

    No merge crosses a gap above the limit, so each run between such gaps is clustered alone; within it only
    neighbours can be nearest. A cluster's number holds within its keys: the run's, then the cluster's.
    Rows without a value get none.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = df.columns

    def merged(total: list[float]) -> np.ndarray:
        """Cluster numbers, from 1, of one run's ordered values."""
        n = len(total)
        size = [1.0] * n
        left, right, version = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n

        def entry(i: int) -> tuple:
            j = right[i]
            return math.sqrt(2 * size[i] * size[j] / (size[i] + size[j])) * abs(total[i] / size[i] - total[j] / size[j]), i, j, version[i], version[j]

        heap = [entry(i) for i in range(n - 1)]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            d, i, j, vi, vj = heapq.heappop(heap)
            if gone[i] or gone[j] or version[i] != vi or version[j] != vj:
                continue
            if d > limit:
                break
            total[i], size[i], gone[j], right[i] = total[i] + total[j], size[i] + size[j], True, right[j]
            version[i] += 1
            if right[i] < n:
                left[right[i]] = i
                heapq.heappush(heap, entry(i))
            if left[i] >= 0:
                heapq.heappush(heap, entry(left[i]))
        return np.cumsum(~np.array(gone))

    def numbered(rows: pd.DataFrame) -> pd.DataFrame:
        starts = [*np.flatnonzero(rows["_n"].to_numpy() == 1).tolist(), len(rows)]
        values = rows[x].to_numpy(float).tolist()
        numbers = np.concatenate([merged(values[a:b]) for a, b in zip(starts, starts[1:])])
        return rows[names].assign(**{out: [f"{c}.{k}" for c, k in zip(rows["_c"].tolist(), numbers.tolist())]})

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            starts = np.flatnonzero(pdf["_n"].to_numpy() == 1)
            if not len(starts):
                held.append(pdf)
                continue
            # The last run may go on in the next batch.
            whole = pd.concat([*held, pdf.iloc[: starts[-1]]], ignore_index=True)
            held = [pdf.iloc[starts[-1] :]]
            if len(whole):
                yield numbered(whole)
        if held:
            yield numbered(pd.concat(held, ignore_index=True))

    parts = gap_components(df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))), x, F.lit(limit), keys, "_c")
    # Tasks get many runs, each in order of x, and number them as they come.
    ordered = parts.repartition(*keys, "_c").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(x)))
    return ordered.mapInPandas(run, f"{fields}, `{out}` string")
