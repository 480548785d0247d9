"""Queries over their whole tables."""

from massweave.plans import matching, signals, spectra


def test_all_embeddings_are_searched(spark, tmp_path):
    rows = [(i, i % 10, [1.0, 5.0 if i < 20 else 1.0, 5.0 if i >= 20 else 1.0]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2) if (a < 20) == (b < 20)}
    assert {(r.query, r.ref) for r in spectra.q_entropy_search(spark, str(tmp_path)).collect()} == want
    assert {(r.query, r.ref) for r in matching.q_match_quality_all(spark, str(tmp_path)).collect()} == {(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2)}


def test_every_peak_has_a_profile(spark, tmp_path):
    spark.createDataFrame([(1, 1, 3.0, 500.0, 1, 1, "N", 0.0), (1, 2, 50.0, 600.0, 1, 1, "N", 0.0)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_partkey long, l_suppkey long, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert signals.q_line_shapes_all(spark, str(tmp_path)).count() == 2 * 17
