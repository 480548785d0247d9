"""Seven digits by arithmetic and by text."""

import numpy as np
from pyspark.sql import functions as F

from massweave.plans.registry import sig, sig_columns


def test_digits_by_arithmetic_are_those_of_text(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=4000) * 10.0 ** rng.integers(-40, 40, 4000), rng.integers(0, 10**8, 4000) / 2.0, 10.0 ** np.arange(-30, 30), rng.integers(10**6, 10**7, 3000) + 0.5, (rng.integers(10**6, 10**7, 3000) + 0.5) / 1e4, 10.0 ** np.arange(-20, 20) * 9.9999995, [0.0, -0.0, 1e-320, 1e300, np.inf, np.nan]])
    rows = spark.createDataFrame([(float(v), float(-v)) for v in x] + [(None, 1.0)], "a double, b double")
    both = sig_columns(rows.withColumns({"c": F.col("a"), "d": F.col("b")}), ["a", "b"]).select("a", "b", sig("c", "c"), sig("d", "d"))
    assert both.where("not (a <=> c and b <=> d)").collect() == []
