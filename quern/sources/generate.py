"""Synthetic rows: seeded, of an exact number, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def individuals(spark: SparkSession, rows: int, attributes: int, seed: int = 1, same_id: bool = False, partitions: int | None = None) -> DataFrame:
    """(id, zip, pt, happy, attributes): zip is exponential with mean 1000, attributes are normal, happy if the first is over 0.5.

    same_id gives every row id 1, the most skewed key there is.
    """
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    values = F.array(*(F.randn(seed + 1 + k) for k in range(attributes)))
    out = base.select(
        (F.lit(1).cast("long") if same_id else F.col("id")).alias("id"),
        F.floor(-1000 * F.log(1 - F.rand(seed))).cast("string").alias("zip"),
        F.lit("giant").alias("pt"),
        values.alias("attributes"),
    )
    return out.select("id", "zip", "pt", (F.get("attributes", F.lit(0)) > 0.5).alias("happy"), "attributes")


def key_values(spark: SparkSession, rows: int, attributes: int = 1, seed: int = 1) -> DataFrame:
    """(zip int, fuzzyness double) of the same rows."""
    return individuals(spark, rows, attributes, seed).select(F.col("zip").cast("int").alias("zip"), F.get("attributes", F.lit(0)).alias("fuzzyness"))
