"""What the operators of this subpackage share: scratch tables, word splitting, small expression helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the characters that separate words, space and 0x09 to 0x0D, as a regex class body.
SPACES = r"\x20\x09-\x0D"
#: Fixed value: the same characters, for translate().
SPACE_CHARS = " \t\n\x0b\f\r"

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
        _made.append((spark, found))
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a scratch table through Hadoop's file system API, so that any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


class Scratch:
    """Parquet tables in the shared checkpoint folder: they cut lineage and outlive lost executors.

    drop() removes tables that the result no longer reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Writes df and returns a DataFrame that reads it; the schema is given, so empty tables work too."""
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is temporary anyway
            return


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than SPACES. Null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+", -1), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row; lambda variables are never inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
