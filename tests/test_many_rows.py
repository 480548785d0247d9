"""Steps whose work or memory must not grow faster than their rows."""

import numpy as np

from massweave.operators import filters, recalibration, report, suppress


def test_a_density_from_cells(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=3000), [30.0, 30.5, -25.0]])
    rows = spark.createDataFrame([(1, float(x)) for x in v] + [(2, 1.0), (2, 3.0), (3, 1.0), (3, 1.0), (1, None)], "k int, v double")
    got = [(r.x, r.density) for r in recalibration.density(rows, ["k"], "v").where("k = 1").orderBy("place").collect()]
    b = v.std(ddof=1) * len(v) ** -0.2
    want = [np.exp(-0.5 * ((x - v) / b) ** 2).sum() / (len(v) * b * np.sqrt(2 * np.pi)) for x, _ in got]
    assert len(got) == 200 and all(abs(d - w) <= 1e-9 * w + 1e-300 for (_, d), w in zip(got, want))
    # Values are summed up before they meet the places.
    plan = recalibration.density(rows, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert " AS _m0" in plan.split("Generate explode")[1]


def test_indices_are_counted_over_cells(spark):
    rows = spark.createDataFrame([(s, float(m)) for s in (1, 2, None) for m in (5.5, 0.25, -3.0, 5.75, 9.0, 120.5)], "scan int, mz double")
    got = filters.indexed(rows, ["scan"])
    assert [(r.mz, r.peak_idx) for r in got.where("scan is null").orderBy("mz").collect()] == [(-3.0, 0), (0.25, 1), (5.5, 2), (5.75, 3), (9.0, 4), (120.5, 5)]
    assert got.groupBy("scan").count().where("count = 6").count() == 3


def test_ranks_and_spectra_share_a_sort(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0.5, 1), (1, 1, 6, 0.9, 2), (1, 1, 6, 0.9, 1), (1, 2, 7, 0.1, 1)], "mf_id int, ref_mol_id int, scan int, entropy_similarity double, ref_ms_id int")
    got = report.best_per_feature(rows)
    assert {(r.mf_id, r.ref_mol_id): (r.scan, r.ref_ms_id, r.n_spectra) for r in got.collect()} == {(1, 1): (6, 1, 2), (1, 2): (7, 1, 1)}
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window") >= 2
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [") == 1


def test_a_run_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(k, i, float(i * (1 + k) + 50 * (i // 20))) for k in range(3) for i in range(60)], "k int, id int, x double")
        few = suppress.ward(rows, ["k"], "x", 3.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, few)) == sorted(map(tuple, suppress.ward(rows, ["k"], "x", 3.0).collect())) and len(few) == 180
    assert "FlatMapGroupsInPandas" not in suppress.ward(rows, ["k"], "x", 3.0)._jdf.queryExecution().toString()
