"""Sinks and table maintenance."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_by(df: DataFrame, path: str, *keys: str) -> None:
    """JSON in a folder for each key; rows of a key are brought together first, so a key has few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, bucket: tuple[int, str] | None = None) -> None:
    """A managed table; bucketed and sorted by a key, two such tables join on it without a shuffle."""
    w = df.write.mode("overwrite")
    if bucket:
        w = w.bucketBy(*bucket).sortBy(bucket[1])
    w.saveAsTable(name)


def register(df: DataFrame, view: str, table: str | None = None) -> None:
    df.createOrReplaceTempView(view)
    if table:
        save_table(df, table)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, mode: str = "append") -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {})).mode(mode).save()


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source, and those of target whose key source lacks: update what matches, insert the rest."""
    return source.select(*target.columns).unionByName(target.join(source.select(*keys), keys, "left_anti"))


def merge_into(source: DataFrame, table: str, condition: str) -> None:
    """The same as a MERGE on a table of a v2 catalog."""
    source.mergeInto(table, F.expr(condition)).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def write_both(df: DataFrame, first: Callable[[DataFrame], None], second: Callable[[DataFrame], None]) -> None:
    """Two writes of one computation at once; it is kept, on disk where memory ends, until both are done."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPoolExecutor(2) as pool:
            for done in [pool.submit(first, held), pool.submit(second, held)]:
                done.result()
    finally:
        held.unpersist()


def publish(staged: DataFrame, audits: dict[str, str], path: str, staging: str) -> dict[str, bool]:
    """Write, audit, publish: rows go to a staging table; only if each audit (a boolean aggregate) holds do they reach path."""
    spark = staged.sparkSession
    staged.write.mode("overwrite").parquet(staging)
    held = spark.read.schema(staged.schema).parquet(staging)
    row = held.agg(*(F.expr(e).alias(n) for n, e in audits.items())).first() if audits else None
    found = {n: bool(row[n]) for n in audits}
    if all(found.values()):
        held.write.mode("overwrite").parquet(path)
    return found


def delete_where(spark: SparkSession, path: str, condition: str, out: str) -> None:
    """A table without the rows for which the condition holds, in a new folder."""
    spark.read.parquet(path).where(~F.coalesce(F.expr(condition), F.lit(False))).write.mode("overwrite").parquet(out)


def compact(spark: SparkSession, path: str, out: str, files: int) -> None:
    """A table's rows in fewer files."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(out)


def write_by_prefix(df: DataFrame, col: str, size: int, path: str) -> None:
    """Partitioned by the first characters of a column."""
    key = f"{col}_prefix"
    df.withColumn(key, F.substring(col, 1, size)).write.mode("append").partitionBy(key).parquet(path)
