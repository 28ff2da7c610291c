"""Grouping. Sums and counts combine before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_group(df: DataFrame, keys: str | list[str], **aggregates: Column) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))


def describe(df: DataFrame, *cols: str) -> DataFrame:
    """count, mean, sample standard deviation, least and greatest of numeric columns: a typed row a column."""
    # one pass: all aggregates in a row, then a row for each column
    names = ("count", "mean", "stddev", "min", "max")
    one = df.agg(*(F.struct(F.lit(c).alias("col"), *(f(c).cast("double" if n != "count" else "long").alias(n) for n, f in zip(names, (F.count, F.avg, F.stddev_samp, F.min, F.max)))).alias(f"s_{c}") for c in cols))
    return one.select(F.inline(F.array(*(f"s_{c}" for c in cols))))


def one_each(df: DataFrame, key: str, *by: str) -> DataFrame:
    """The first row of each key in an order; without an order any."""
    if not by:
        return df.dropDuplicates([key])
    rank = "row_rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col(rank) == 1).drop(rank)


def with_observed(df: DataFrame, name: str, *aggregates: Column):
    """df, and an Observation that holds the aggregates once df has run: exact whatever is retried."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *aggregates), o


def label_index(df: DataFrame, col: str) -> DataFrame:
    """Distinct values numbered from 0 in ascending order: a row a label."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().select(col, (F.row_number().over(Window.orderBy(col)) - 1).cast("double").alias("label_index"))


def sum_over_small(df: DataFrame, value: str, below: float) -> DataFrame:
    """Values under a bound, summed by value, in order."""
    return df.where(F.col(value) < below).groupBy(value).agg(F.count("*").alias("n"), F.sum(value).alias("total")).orderBy(value)
