"""A formula lookup table kept on disk by heteroatom class and nominal mass, so that a search reads only what it can use.

A class is computed once: adding ranges to a table makes only the classes that it doesn't hold yet. Searches name the
classes and nominal masses that they need, which prune folders and row groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.functions import formula as fm
from massweave.functions.chem import MONO
from massweave.operators.search import candidates


def built(forms: DataFrame) -> DataFrame:
    """class, nominal, mass, dbe, atoms of formulas as ``search.candidates`` makes them."""
    return forms.select(fm.class_label(F.col("atoms"), F.lit("neutral")).alias("class"), F.floor("mass").cast("int").alias("nominal"), "mass", "dbe", "atoms")


def classes(spark: SparkSession, path: str) -> DataFrame:
    """The classes that a table holds, with their numbers of formulas; none where there is no table yet."""
    try:
        return spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("formulas"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "class string, formulas long")


def add(spark: SparkSession, path: str, ranges: list[tuple[str, int, int]], mz: tuple[float, float], dbe: tuple[float, float]) -> int:
    """Add the formulas of the ranges whose class the table doesn't hold; the number of classes added."""
    held = classes(spark, path).select("class")
    fresh = built(candidates(spark, ranges, mz, dbe)).join(F.broadcast(held), "class", "left_anti")
    n = fresh.select("class").distinct().count()
    if n:
        # A class's files are few and ordered by mass.
        fresh.repartition("class").sortWithinPartitions("class", "nominal", "mass").write.mode("append").partitionBy("class").parquet(path)
    return n


def formulas(spark: SparkSession, path: str, wanted: list[str] | None = None, nominal: list[int] | None = None) -> DataFrame:
    """The formulas of some classes and nominal masses, or all."""
    rows = spark.read.parquet(path)
    rows = rows if wanted is None else rows.where(F.col("class").isin(wanted))
    return rows if nominal is None else rows.where(F.col("nominal").isin(nominal))


def heteroatoms(atoms: Column) -> Column:
    """Atoms that are neither carbon nor hydrogen."""
    every = F.aggregate(F.map_values(atoms), F.lit(0), lambda n, k: n + k)
    return every - fm.element(atoms, "C") - fm.element(atoms, "H")


def halogens(atoms: Column) -> Column:
    return reduce(lambda a, b: a + b, [fm.element(atoms, x) for x in ("F", "Cl", "Br", "I") if x in MONO])
