"""User-defined functions, each beside the built-in expression that should be preferred."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """SQL names: str_len, our_avg and add_five."""
    spark.udf.register("str_len", str_len())
    spark.udf.register("our_avg", mean_by_group())
    spark.udf.register("add_five", add(5))


def str_len():
    """length() in pandas; code points, null stays null."""

    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(x)).astype("Int32")

    return F.pandas_udf(f, "int")


def mean_by_group():
    """avg() as a grouped aggregate; null for no values."""

    def f(v: pd.Series) -> float:
        return float(v.mean()) if v.notna().any() else None

    return F.pandas_udf(f, "double")


def add_row(n: int):
    """x + n, a row at a time: the slowest form, for comparison."""
    return F.udf(lambda x: None if x is None else x + n, "long")


def add(n: int):
    """x + n on batches."""

    def f(s: pd.Series) -> pd.Series:
        return s + n

    return F.pandas_udf(f, "long")


def add_in_struct(n: int, field: str):
    """A field of a struct column, plus n."""

    def f(d: pd.DataFrame) -> pd.Series:
        return d[field] + n

    return F.pandas_udf(f, "long")


def add_by_batches(n: int):
    """x + n over an iterator of batches, with what is set up once for all of them."""

    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = n
        for s in batches:
            yield s + step

    return F.pandas_udf(f, "long")


def total():
    """sum() as a grouped aggregate."""

    def f(v: pd.Series) -> float:
        return float(v.sum())

    return F.pandas_udf(f, "double")


def lengths_by_partition(df: DataFrame, col: str) -> DataFrame:
    """Length of a string column by a function over whole partitions."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": b[col], "length": b[col].str.len().astype("Int64")})

    return df.select(col).mapInPandas(f, "value string, length long")


def array_sum(array: str | Column) -> Column:
    """Sum of an array of integers; 0 for an empty one, nulls inside count as 0."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def pipe_lookup(df: DataFrame, key: str, command: str, env: dict[str, str] | None = None) -> DataFrame:
    """Each partition's keys as lines to an external command, which answers a line each: `key token token ...`.

    Returns (key, tokens), tokens sorted and distinct. Partition by partition, on the executors.
    """

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                said = subprocess.run(shlex.split(command), input="".join(f"{x}\n" for x in b["k"]), capture_output=True, text=True, env=env, check=True).stdout
                yield pd.DataFrame({"line": said.splitlines()})

    lines = df.select(F.col(key).cast("string").alias("k")).mapInPandas(f, "line string")
    parts = F.split("line", " ")
    return lines.select(F.get(parts, F.lit(0)).alias("key"), F.array_distinct(F.array_sort(F.filter(F.slice(parts, 2, 1_000_000), lambda x: x != ""))).alias("tokens"))
