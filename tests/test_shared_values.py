"""Joins whose values many rows share: no pair of rows is made for what its count tells."""

from massweave.operators import joins
from massweave.operators.spectrum import calibration_points
from massweave.plans import matching

EVENTS = "event_id long, value double"


def test_events_of_one_value_meet_as_counts(spark, tmp_path):
    # 60,000 rows of one value are 3.6e9 pairs.
    many = spark.range(60_000).selectExpr("id event_id", "1.0D value")
    few = spark.createDataFrame([(70_000, 1.04), (70_001, 9.0), (70_002, 9.5), (70_002, 9.54), (70_003, 9.52), (None, 1.0), (70_004, None)], EVENTS)
    many.union(few).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.n, r.total) for r in matching.q_band_join_abs(spark, str(tmp_path)).collect()}
    assert len(got) == 60_003
    assert got[0] == got[59_999] == (60_000, 60_000.04) and got[70_000] == (60_000, 60_000.0)
    assert got[70_002] == (2, 19.04) and got[70_003] == (2, 19.04)


def test_unique_matches_of_shared_values(spark):
    left = spark.range(50_000).selectExpr("id", "100.0D mz").union(spark.createDataFrame([(1, 200.0), (2, 300.0), (3, 300.001), (4, 400.0)], "id long, mz double"))
    right = spark.range(50_000).selectExpr("id key", "100.0D ref_mz").union(spark.createDataFrame([(60_000, 200.0), (60_001, 300.0), (60_002, 400.0), (60_002, 200.0), (60_003, 400.001)], "key long, ref_mz double"))
    assert sorted(tuple(r) for r in joins.unique_band_join(left, right, "mz", "ref_mz", 10.0, "key", ppm=True).collect()) == [(1, 200.0, 60_000, 200.0), (4, 400.0, 60_003, 400.001)]
    got = calibration_points(left, right, (-10.0, 2.0), None).collect()
    assert sorted((r.id, r.key) for r in got) == [(2, 60_001), (4, 60_002), (4, 60_003)]


def test_the_nearest_reference_of_shared_values(spark):
    left = spark.range(50_000).selectExpr("100.0D mz").union(spark.createDataFrame([(200.0,), (300.0,), (500.0,)], "mz double"))
    right = spark.range(50_000).selectExpr("id + 5 key", "100.001D ref_mz", "'b' class").union(spark.createDataFrame([(1, 99.9995, "a"), (9, 200.001, "c"), (8, 199.999, "d"), (3, 300.001, "e"), (2, 300.001, "f"), (4, 501.0, "g")], "key long, ref_mz double, class string"))
    got = {r.mz: (r.key, r["class"]) for r in joins.nearest_ppm(left, right, "mz", "ref_mz", 50.0, "key").collect()}
    assert got == {100.0: (1, "a"), 200.0: (9, "c"), 300.0: (2, "f")}
