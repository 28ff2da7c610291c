"""Sources: every scan is lazy, with column pruning and pushdown left to the planner."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; timestamps without a zone stay so."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, sampling_ratio: float | None = None, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; the schema is inferred from a share of the lines, or given, which saves a scan."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    elif sampling_ratio is not None:
        r = r.option("samplingRatio", sampling_ratio)
    return r.json(path)


def parse_json(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """Records from a column of JSON strings."""
    return lines.select(F.from_json(col, schema).alias("r")).select("r.*")


def read_json_lines_with(spark: SparkSession, path: str, word: str, schema: str) -> DataFrame:
    """Only lines that contain a word are parsed."""
    return parse_json(spark.read.text(path).where(F.col("value").contains(word)), schema)


def from_rows(spark: SparkSession, rows: Iterable[Row | tuple], schema: StructType | str) -> DataFrame:
    """A table of local rows with a stated schema."""
    return spark.createDataFrame(list(rows), schema)


def read_parquet(spark: SparkSession, *paths: str, merge: bool = False, binary_as_string: bool = False) -> DataFrame:
    """Parquet, if asked with the schemas of all files merged, or with binary columns as strings."""
    df = spark.read.option("mergeSchema", merge).parquet(*paths)
    if binary_as_string:
        df = df.select(*(F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes))
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema the types are inferred in a scan of their own."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A JDBC table; with partition = (column, lower, upper, number) it is read in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition:
        column, lower, upper, n = partition
        r = r.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=n)
    return r.load()


def read_catalog(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_file_by_sql(spark: SparkSession, path: str, columns: str = "*") -> DataFrame:
    """SQL straight over a file."""
    return spark.sql(f"SELECT {columns} FROM parquet.`{path}`")


def read_event_log(spark: SparkSession, path: str, kinds: tuple[str, ...], schema: str | None = None) -> DataFrame:
    """Records of a JSON event log of some kinds."""
    return read_json(spark, path, schema=schema).where(F.col("Event").isin(*kinds))


def oldest_file(folder: str) -> str | None:
    """The least recently changed file of a local folder; None if there is none."""
    files = [e for e in os.scandir(folder) if e.is_file()] if os.path.isdir(folder) else []
    return min(files, key=lambda e: (e.stat().st_mtime, e.name)).name if files else None


def require(df: DataFrame, schema: str | StructType) -> DataFrame:
    """The columns of a schema, which df must have with these types; columns besides are let through nowhere."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in df.schema}
    for f in want:
        if have.get(f.name) != f.dataType:
            raise TypeError(f"column {f.name}: {have.get(f.name)} instead of {f.dataType}")
    return df.select(*want.names)


# ---- streams -----------------------------------------------------------------------------------------------------
def stream_parquet(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come; a schema is a must."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def stream_json(spark: SparkSession, path: str, ddl: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(ddl)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def stream_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of new files, with the file and its time."""
    return spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def stream_socket(spark: SparkSession, host: str, port: int, arrival: bool = False) -> DataFrame:
    return spark.readStream.format("socket").options(host=host, port=port, includeTimestamp=arrival).load()


def stream_rate(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Needs Spark's Kafka connector on the class path; Spark names it if it is absent."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
