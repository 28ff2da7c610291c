"""Session builder: UTC, adaptive execution, ANSI mode as Spark sets it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local work; on a cluster the master and sizes come from spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it lies on the driver's path; on a cluster ship it with --py-files."""
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found
