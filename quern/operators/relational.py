"""Projections, filters, sorts, sets, sampling and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(df: DataFrame, a: str, b: str, name: str, *keep: str) -> DataFrame:
    """keep and a / b; null where b is 0."""
    return df.select(*keep, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")).alias(name))


def encode(df: DataFrame, col: str, codes: dict[str, int], default: int, name: str) -> DataFrame:
    """A column's values as numbers by a CASE."""
    e = F.lit(default)
    for value, code in reversed(codes.items()):
        e = F.when(F.col(col) == value, code).otherwise(e)
    return df.withColumn(name, e.cast("int"))


def at_least(df: DataFrame, col: str, least: float) -> DataFrame:
    return df.where(F.col(col) >= least)


def not_true(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag is false; unknown flags drop out."""
    return df.where(~flag)


def first_above_second(df: DataFrame, array: str, flag: Column | None = None) -> DataFrame:
    """Rows whose first element is above the second; short arrays drop out."""
    c = F.get(array, F.lit(0)) > F.get(array, F.lit(1))
    return df.where(c if flag is None else flag & c)


def at_least_half(df: DataFrame, part: str, whole: str) -> DataFrame:
    return df.where(F.col(part) >= F.col(whole) / 2)


def exploded_ratio(df: DataFrame, key: str, records: str, array: str, name: str) -> DataFrame:
    """One row for each struct of an array column, with the ratio of the first two elements of its array."""
    return df.select(key, F.inline(records)).select(key, F.try_divide(F.get(array, F.lit(0)), F.get(array, F.lit(1))).alias(name))


def sum_positive(array: str | Column) -> Column:
    """Sum of an array's positive elements."""
    a = F.col(array) if isinstance(array, str) else array
    return F.aggregate(F.filter(a, lambda x: x > 0), F.lit(0.0), lambda s, x: s + x)


def element(array: str, k: int) -> Column:
    """An array's element counted from 0; null past the end."""
    return F.get(array, F.lit(k))


def without(df: DataFrame, deny: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in deny. Small deny lists are broadcast by the planner, by their measured size."""
    return df.join(deny.select(key), key, "left_anti")


def without_counted(df: DataFrame, deny: DataFrame, key: str) -> DataFrame:
    """How many rows without() keeps and rejects, in one pass."""
    seen = df.join(deny.select(F.col(key), F.lit(True).alias("denied")).dropDuplicates([key]), key, "left")
    return seen.agg(F.count_if(F.col("denied").isNull()).alias("n_kept"), F.count_if(F.col("denied").isNotNull()).alias("n_rejected"))


def project_non_null(df: DataFrame, *exprs: Column) -> DataFrame:
    """A projection of the rows in which no expression is null; the filter is pushed down as far as it goes."""
    out = df
    for e in exprs:
        out = out.where(e.isNotNull())
    return out.select(*exprs)


# ---- order, limits, partitions -------------------------------------------------------------------------------------
def ordered(df: DataFrame, *by: Column) -> DataFrame:
    return df.orderBy(*by)


def top(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """The first n rows in an order: each partition keeps n, no global sort."""
    return df.orderBy(*by).limit(n)


def sorted_groups(df: DataFrame, key: str, by: list[str], name: str = "items") -> DataFrame:
    """A row a key with its records in order. A group becomes one value: for groups of bounded size."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*by))).alias(name))


def positions(df: DataFrame, key: str, *by: str | Column, name: str = "pos") -> DataFrame:
    """Each row's place in its group's order, from 1; groups of any size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*by)))


def partitioned_sorted(df: DataFrame, n: int, key: str, *by: str) -> DataFrame:
    """Rows of a key in one of n partitions, each in order of (key, by): one shuffle that sorts."""
    return df.repartition(n, key).sortWithinPartitions(key, *by)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder, so that later plans don't hold this one."""
    from quern.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# ---- sets ----------------------------------------------------------------------------------------------------------
def subtract_keeping_repeats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b hasn't; rows that a has twice stay twice. Nulls are equal."""
    other = b.distinct().select(*(F.col(c).alias(f"other_{k}") for k, c in enumerate(a.columns)))
    same = F.lit(True)
    for k, c in enumerate(a.columns):
        same = same & F.col(c).eqNullSafe(F.col(f"other_{k}"))
    return a.join(other, same, "left_anti")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.intersect(b)


# ---- samples -------------------------------------------------------------------------------------------------------
def sample(df: DataFrame, share: float, seed: int) -> DataFrame:
    return df.sample(False, share, seed)


def sample_by_key(df: DataFrame, key: str, share_permille: int) -> DataFrame:
    """A sample that depends on the key alone, so it is the same in any engine and at any partitioning."""
    first = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("long")
    return df.where(first % 1000 < share_permille)


def stratified(df: DataFrame, col: str, shares: dict[str, float], seed: int) -> DataFrame:
    """Strata that aren't named have share 0."""
    return df.sampleBy(col, shares, seed)


# ---- windows -------------------------------------------------------------------------------------------------------
def relative_to_neighbours(df: DataFrame, group: str, by: list[str], value: str, name: str, rows: int = 10) -> DataFrame:
    """value less its average over the rows up to `rows` before and behind, in the group's order; by should be unique."""
    w = Window.partitionBy(group).orderBy(*by).rowsBetween(-rows, rows)
    return df.withColumn(name, F.col(value) - F.avg(value).over(w))


def relative_to_range(df: DataFrame, group: str, by: str, value: str, name: str, reach: float = 10) -> DataFrame:
    """The same over the rows whose order value is within reach."""
    w = Window.partitionBy(group).orderBy(by).rangeBetween(-reach, reach)
    return df.withColumn(name, F.col(value) - F.avg(value).over(w))
