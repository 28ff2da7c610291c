"""Structured Streaming: word counts, windowed counts, joins of streams, sinks."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def word_count(lines: DataFrame, col: str = "value") -> DataFrame:
    """Running counts of the pieces between spaces."""
    return lines.select(F.explode(F.split(col, " ")).alias("word")).groupBy("word").count()


def tumbling_count(events: DataFrame, time: str, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Counts by window and keys. With a watermark the state of closed windows is dropped; without one it stays."""
    e = events.withWatermark(time, watermark) if watermark else events
    return e.groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, reach: str, left_watermark: str | None = None, right_watermark: str | None = None) -> DataFrame:
    """Pairs with one key whose times are at most `reach` apart.

    Only with both watermarks is the state of both sides bounded; a warning says so otherwise. right's key is named
    like left's and dropped.
    """
    if not (left_watermark and right_watermark):
        warnings.warn("without watermarks on both sides the join keeps rows for ever", stacklevel=2)
    a = left.withWatermark(left_time, left_watermark) if left_watermark else left
    b = right.withWatermark(right_time, right_watermark) if right_watermark else right
    b = b.withColumnRenamed(key, f"{key}_right")
    near = F.expr(f"`{right_time}` >= `{left_time}` - interval {reach} AND `{right_time}` <= `{left_time}` + interval {reach}")
    return a.join(b, (F.col(key) == F.col(f"{key}_right")) & near).drop(f"{key}_right")


def equality_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs with one key at any times: state without bound."""
    warnings.warn("a join of streams by a key alone keeps all rows for ever", stacklevel=2)
    return left.join(right, key)


def collected(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns the table of its results, written to the shared checkpoint folder.

    Rows that are appended go to one table; in the other modes each batch writes one of its own, and the last one counts.
    """
    from quern.session import checkpoint_dir

    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/quern_{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{at}/checkpoint").trigger(availableNow=True)
    last = [0]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table-{number}")
        last[0] = number

    (w.format("parquet").start(f"{at}/table-0") if mode == "append" else w.foreachBatch(write).start()).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table-{last[0]}")


def start(stream: DataFrame, mode: str, sink: str, checkpoint: str, every: str = "1 second", path: str | None = None, **options: str) -> StreamingQuery:
    """A running query: console, parquet, text, noop, memory or kafka sink. Restarted with its checkpoint, it goes on where it was."""
    w = stream.writeStream.outputMode(mode).format(sink).option("checkpointLocation", checkpoint).options(**options).trigger(processingTime=every)
    return w.start(path) if path else w.start()


def start_continuous(stream: DataFrame, sink: str, checkpoint: str, every: str = "1 second", **options: str) -> StreamingQuery:
    """Continuous processing: milliseconds of delay, for projections and filters of rate and Kafka sources."""
    return stream.writeStream.format(sink).option("checkpointLocation", checkpoint).options(**options).trigger(continuous=every).start()


def start_async_progress(stream: DataFrame, sink: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Offsets are committed beside the batches; for stateless queries."""
    return stream.writeStream.format(sink).option("checkpointLocation", checkpoint).option("asyncProgressTrackingEnabled", "true").options(**options).start()


def start_batches(stream: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None], available_now: bool = False) -> StreamingQuery:
    """A function of each batch's rows and number; it may see a batch again after a failure, so it should overwrite by number."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def use_rocksdb(spark: SparkSession) -> None:
    """Keeps streaming state in RocksDB, off the heap, from the next query on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
