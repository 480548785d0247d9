"""Writers: tables with a settings sidecar, per-scan partitions, JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.config import Settings, to_json


def write_table(df: DataFrame, path: str, settings: Settings | None = None, kind: str = "parquet", by: list[str] | None = None, mode: str = "error") -> None:
    """Write a table, partitioned if asked, and its settings beside it."""
    out = df.write.mode(mode)
    if kind == "csv":
        out = out.option("header", True)
    (out.partitionBy(*by) if by else out).format(kind).save(path)
    if settings is not None:
        df.sparkSession.createDataFrame([(to_json(settings),)], "value string").coalesce(1).write.mode(mode).text(f"{path.rstrip('/')}.settings", lineSep="\n")


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A numbered snapshot; the latest is read by ``latest``."""
    df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)


def latest(spark, path: str, version: int = -1) -> DataFrame:
    df = spark.read.parquet(path)
    if version < 0:
        version = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == version).drop("version")


def spectrum_json(peaks: DataFrame, keys: list[str], columns: list[str], settings: dict | None = None) -> DataFrame:
    """keys and one JSON document a spectrum: its keys, settings and the columns of its peaks, in the order of the first column."""
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    whole = peaks.groupBy(*keys).agg(rows.alias("peaks"))
    own = [F.from_json(F.lit(json.dumps(settings)), "map<string,string>").alias("settings")] if settings else []
    return whole.select(*keys, F.to_json(F.struct(*keys, *own, F.col("peaks"))).alias("document"))
