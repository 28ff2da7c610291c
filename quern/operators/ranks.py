"""Exact values at given ranks of each column.

A rank's value is found without sorting a column. Each rank lies in an interval of its column, at first from the least
to the greatest finite value. The rows of the intervals fall into equal-width buckets, and a row for each bucket (its
count, least and greatest value: a bounded number) tells the driver in which bucket each rank lies; that bucket's own
least and greatest value are the next interval. Intervals narrow until they hold one value or few rows, so outliers
and long tails only take another round; only the rows that are left are ordered, as distinct values with counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: So many rows of an interval are ordered.
FEW = 100_000


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in cols)))).where(F.col("value").isNotNull())


def _classes(df: DataFrame, cols: list[str]) -> dict[str, list[tuple[float, float, int]]]:
    """For each column the (least, greatest, count) of its infinite, finite, infinite and NaN values, in the order of sorting."""
    out = []
    for k, c in enumerate(cols):
        v = F.col(c).cast("double")
        finite = F.when(F.abs(v) < float("inf"), v)
        out.append(F.struct(F.count_if(v == float("-inf")).alias("low"), F.min(finite).alias("a"), F.max(finite).alias("b"), F.count(finite).alias("n"), F.count_if(v == float("inf")).alias("high"), F.count_if(F.isnan(v)).alias("nan")).alias(f"c{k}"))
    row = df.agg(*out).first()
    inf = float("inf")
    return {c: [(-inf, -inf, r.low), (r.a, r.b, r.n), (inf, inf, r.high), (float("nan"), float("nan"), r.nan)] for c, r in zip(cols, row)}


def _placed(ranks: list[int], pieces: list[tuple[float, float, int]], base: int) -> list[tuple[int, int, float, float, int]]:
    """(rank, rows before its piece, and the piece) of each rank that lies in one of the pieces, which follow each other."""
    out = []
    for low, high, n in pieces:
        out += [(x, base, low, high, n) for x in ranks if base < x <= base + n]
        base += n
    return out


def rank_statistics(df: DataFrame, cols: list[str], ranks: list[int], few: int = FEW) -> DataFrame:
    """(col, rank, value): the value at each 1-based rank in ascending order, repeats counted; ranks past the end have no row.

    Nulls have no rank; NaN comes last, as in sorting.
    """
    if any(r < 1 for r in ranks):
        raise ValueError("ranks begin at 1")
    spark, wanted = df.sparkSession, sorted(set(ranks))
    found = [(c, *x) for c, pieces in _classes(df, cols).items() for x in _placed(wanted, pieces, 0)]
    values = [(c, rank, low) for c, rank, _, low, high, _ in found if low == high or low != low]
    todo = [x for x in found if x[3] < x[4]]
    rows = _long(df, cols)
    while any(x[5] > few for x in todo):
        wide = sorted({(c, low, high) for c, _, _, low, high, n in todo if n > few})
        parts: dict[tuple, list] = {x: [] for x in wide}
        # halves, so that no difference overflows
        place = F.floor(F.least(F.lit(BUCKETS - 1.0), (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS)).cast("int")
        for r in _within(rows, wide).groupBy("col", "low", "high", place.alias("bucket")).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).collect():
            parts[r.col, r.low, r.high].append((r.a, r.b, r.n))
        narrow = []
        for c, rank, base, low, high, n in todo:
            narrow += [(c, *x) for x in _placed([rank], sorted(parts[c, low, high]), base)] if n > few else [(c, rank, base, low, high, n)]
        values += [(c, rank, low) for c, rank, _, low, high, _ in narrow if low == high]
        todo = [x for x in narrow if x[3] < x[4]]
    kind = "col string, rank long, value double"
    known = spark.createDataFrame(values, kind)
    if not todo:
        return known
    counted = _within(rows, sorted({(c, low, high) for c, _, _, low, high, _ in todo})).groupBy("col", "low", "high", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("col", "low", "high").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = spark.createDataFrame([(c, low, high, base, rank) for c, rank, base, low, high, _ in todo], "col string, low double, high double, base long, rank long")
    hit = (F.col("total") - F.col("n") < F.col("rank") - F.col("base")) & (F.col("rank") - F.col("base") <= F.col("total"))
    left = counted.withColumn("total", total).join(F.broadcast(places), ["col", "low", "high"]).where(hit).select("col", "rank", "value")
    return left.unionByName(known) if values else left


def _within(rows: DataFrame, intervals: list[tuple[str, float, float]]) -> DataFrame:
    """The rows (col, value) in each of the intervals, at most one for each column and rank, with its ends."""
    ends = rows.sparkSession.createDataFrame(intervals, "of string, low double, high double")
    return rows.join(F.broadcast(ends), (F.col("col") == F.col("of")) & (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).drop("of")


def rank_statistics_by_prefix_sum(df: DataFrame, cols: list[str], ranks: list[int]) -> DataFrame:
    """The same with a running total over each column's distinct values: simpler, for columns of few distinct values."""
    counted = _long(df, cols).groupBy("col", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("col").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counted.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.explode(F.array(*(F.lit(r).cast("long") for r in sorted(set(ranks))))))
    return total.where((F.col("total") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("total"))).select("col", "rank", "value")


def rank_statistics_by_row_number(df: DataFrame, cols: list[str], ranks: list[int]) -> DataFrame:
    """The same by numbering all rows: the plainest form, for comparison in tests."""
    w = Window.partitionBy("col").orderBy("value")
    return _long(df, cols).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank").isin(list(ranks))).select("col", "rank", "value")


def frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, value, n): how often each value occurs."""
    return _long(df, cols).groupBy("col", "value").agg(F.count("*").alias("n"))
