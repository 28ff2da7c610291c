"""Data quality: row rules, aggregate rules, column checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(Exception):
    """An aggregate rule, or a row rule's threshold, failed."""


@dataclass(frozen=True)
class Rule:
    """kind "row": an expression of a row; "query": a boolean aggregate over the table.

    action on failure: "ignore" only counts, "drop" leaves the row out, "fail" raises if any row, or the query, fails.
    """

    name: str
    expectation: str
    kind: str = "row"
    action: str = "ignore"


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, n_rows, n_failed) in one pass: unknown counts as failed; a query rule fails once or not at all."""
    parts = []
    for r in rules:
        ok = F.coalesce(F.expr(r.expectation), F.lit(False))
        n = F.count_if(~ok) if r.kind == "row" else (~ok).cast("long")
        parts.append(F.struct(F.lit(r.name).alias("rule"), F.count("*").alias("n_rows"), n.cast("long").alias("n_failed")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def enforce(df: DataFrame, rules: list[Rule], most_dropped: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the dropped ones with the names of the rules that they failed. Raises where a rule says so."""
    found = {r.rule: r for r in report(df, rules).collect()}
    for r in rules:
        if r.action == "fail" and found[r.name].n_failed:
            raise QualityError(f"{r.name}: {found[r.name].n_failed} of {found[r.name].n_rows}")
    drops = [r for r in rules if r.kind == "row" and r.action == "drop"]
    names = F.array(*(F.when(~F.coalesce(F.expr(r.expectation), F.lit(False)), F.lit(r.name)) for r in drops)) if drops else F.array().cast("array<string>")
    marked = df.withColumn("failed_rules", F.array_compact(names))
    total = next(iter(found.values())).n_rows if found else 0
    n = marked.where(F.size("failed_rules") > 0).count() if drops and most_dropped < 1 else 0
    if n > most_dropped * total:
        raise QualityError(f"{n} of {total} rows would be dropped")
    return marked.where(F.size("failed_rules") == 0).drop("failed_rules"), marked.where(F.size("failed_rules") > 0)


def validate(df: DataFrame, least_rows: int, null_share: dict[str, float], where: str | None = None) -> DataFrame:
    """(check, value, ok): the number of rows under a condition, and each column's share of nulls against its limit."""
    d = df.where(where) if where else df
    shares = [F.struct(F.lit(f"null_share_{c}").alias("check"), F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias("value"), F.lit(float(limit)).alias("limit"), F.lit(False).alias("least")) for c, limit in null_share.items()]
    rows = F.struct(F.lit("row_count").alias("check"), F.count("*").cast("double").alias("value"), F.lit(float(least_rows)).alias("limit"), F.lit(True).alias("least"))
    return d.agg(F.array(rows, *shares).alias("r")).select(F.inline("r")).select("check", "value", F.when(F.col("least"), F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit")).alias("ok"))


def column_checks(df: DataFrame, types: dict[str, str], ranges: dict[str, tuple[float, float]] | None = None, not_null: list[str] | None = None) -> DataFrame:
    """(check, n_failed): wrong types fail at once, by the schema; ranges and nulls are counted in one pass."""
    have = dict(df.dtypes)
    wrong = {c: t for c, t in types.items() if have.get(c) != t}
    if wrong:
        raise QualityError(f"types differ: {wrong}, found {have}")
    rules = [Rule(f"range_{c}", f"`{c}` IS NULL OR `{c}` BETWEEN {a} AND {b}") for c, (a, b) in (ranges or {}).items()] + [Rule(f"not_null_{c}", f"`{c}` IS NOT NULL") for c in not_null or []]
    return report(df, rules).select(F.col("rule").alias("check"), "n_failed")
