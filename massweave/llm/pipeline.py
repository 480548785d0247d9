"""A corpus pipeline: toxic documents go, then those of no told language, then near duplicates; personal
data is masked; what is left is packed into sequences.

Each stage takes all rows that the one before kept and returns rows of the columns of documents; the last
returns the pieces of the packing. Empty tables give empty results; texts of null or no letters go with
the language stage. Of each stage only its result outlives it: other tables and shared values go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from massweave.llm import best_fit_packing, kneser_ney, pii_bootstrap, string_kernel, t_occurrence
from massweave.llm.common import documents, driver_released, scope, table, written

#: Scores from which a document is toxic, and up to which its language isn't told.
TOXIC, LEAST_LANGUAGE_SCORE = 0.5, 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    driver_released(spark)
    labels = table(spark, sf_dir, "labels")
    return kneser_ney.harmless(docs, kneser_ney.train(docs, labels), TOXIC)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    driver_released(spark)
    return string_kernel.identified(docs, string_kernel.train(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    driver_released(spark)
    return t_occurrence.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    driver_released(spark)
    return pii_bootstrap.masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    driver_released(spark)
    return best_fit_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]
#: SQL can't express the trained stages; the tests compare each stage of a whole run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scope() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
