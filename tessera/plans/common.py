"""Inputs of the registered queries, in the engine's own vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of rows within a trajectory of events.
ORDER = ["ts", "event_id"]
#: kT in kJ/mol at 300 K, as SQL and here.
KT = 0.0083144626 * 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id is the trajectory, (ts, event_id) its order, value the feature, event_type the window."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and x, the features as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def r6(c):  # noqa: ANN001, ANN201
    return F.round(c, 6)


#: Events with their bin of 29 along value.
SQL_BINNED = """b AS (SELECT min(value) lo, max(value) hi FROM events),
m AS (SELECT e.*, CAST(floor((value-lo)/((hi-lo)/29)) AS INT) bin FROM events e CROSS JOIN b WHERE value > lo AND value < hi)"""
