"""Joins. Which side is broadcast is the planner's choice by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join(a: DataFrame, b: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """inner, left_outer, right_outer, left_semi, left_anti or full_outer."""
    return a.join(b, on, how)


def self_pairs(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """Pairs of rows with one key, a row with itself too: columns a_... and b_..."""
    a = df.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in cols))
    return a.join(df.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in cols)), key)


def by_equal_length(a: DataFrame, left: str, b: DataFrame, right: str) -> DataFrame:
    """Rows whose strings are equally long: an equality of derived keys, so no pair is made in vain."""
    return a.join(b, F.length(left) == F.length(right))


def by_pattern(a: DataFrame, left: str, b: DataFrame, right: str) -> DataFrame:
    """Rows where b's pattern is found in a's string. Every pair is looked at: for small tables only."""
    return a.join(b, F.expr(f"regexp(`{left}`, `{right}`)"))


def as_structs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whole rows of both sides."""
    return a.alias("l").join(b.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}")).select(F.struct("l.*").alias("left"), F.struct("r.*").alias("right"))


def best_then_join(scores: DataFrame, others: DataFrame, key: str, score: str, how: str = "inner") -> DataFrame:
    """Each key's best score, then the join: the join sees a row a key, and all rows of others stay."""
    return scores.groupBy(key).agg(F.max(score).alias(score)).join(others, key, how)


def join_then_best(scores: DataFrame, others: DataFrame, key: str, score: str, pick: str, how: str = "inner") -> DataFrame:
    """The join, then a row a key: its best score, with pick of that row (of equal ones the smallest)."""
    j = scores.join(others, key, how)
    best = F.max_by(F.struct(F.col(score), F.col(pick)), F.struct(F.col(score), -F.col(pick)))
    return j.groupBy(key).agg(best.alias("best")).select(key, f"best.{score}", f"best.{pick}")


def cogroup(key: str, **sides: tuple[DataFrame, str]) -> DataFrame:
    """For each key the sorted values of each side, empty where a side lacks it: two sides or more."""
    out = None
    for name, (df, value) in sides.items():
        g = df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))
        out = g if out is None else out.join(g, key, "full_outer")
    return out.select(key, *(F.coalesce(F.col(n), F.array()).alias(n) for n in sides))


def with_lookup(big: DataFrame, small: DataFrame, key: str, most_rows: int = 100_000) -> DataFrame:
    """A map-side join with one row for each key of small (the smallest), which is broadcast only if it has few rows."""
    rest = [c for c in small.columns if c != key]
    one = small.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")
    return big.join(F.broadcast(one) if one.limit(most_rows + 1).count() <= most_rows else one, key)


def co_located(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """Both sides dealt by the key into n partitions: the join needs no further exchange."""
    return a.repartition(n, key).join(b.repartition(n, key), key)


def rmse(predicted: DataFrame, actual: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Root of the mean squared error over keys that both have."""
    return predicted.join(actual, key).agg(F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2))).alias("rmse"))
