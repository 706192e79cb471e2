"""Activity records appended as they arrive.

The streaming form of `sources.sinks.append_activity_log`: new files dropped into a
landing folder are appended to the day-partitioned log. The checkpoint folder makes the
file sink exactly-once, so a lost executor or a restarted driver neither loses nor
duplicates a batch.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesmith.functions.columns import qcol
from tablesmith.session import scratch_path
from tablesmith.sources.activity_log import append_batch


def stream_activity_log(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                        schema: T.StructType | None = None, ts: str = "ts", fmt: str = "parquet",
                        trigger: str = "availableNow", max_files: int = 1000) -> StreamingQuery:
    """Start the ingestion; `trigger` is 'availableNow' (drain what is there, then stop)
    or a processing-time interval such as '1 minute'."""
    if schema is None:  # a file stream needs its schema up front
        schema = spark.read.format(fmt).load(source).schema
    stream = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", max_files).load(source))
    out = stream.withColumn("day", F.to_date(qcol(ts)))
    w = (out.writeStream.format("parquet").outputMode("append").partitionBy("day")
         .option("path", sink)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "activity-stream-ckpt")))
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=trigger)
    return w.start()


def stream_activity_batches(spark: SparkSession, source: str, log: str, checkpoint: str | None = None,
                            schema: T.StructType | None = None, ts: str = "ts", fmt: str = "parquet",
                            name: str = "stream", files_per_day: int = 1, trigger: str = "availableNow",
                            max_files: int = 1000) -> StreamingQuery:
    """Each micro-batch becomes one batch of the log (`sources.activity_log`), named by its number.

    A micro-batch that runs again after a restart is found committed and skipped, and each one
    leaves `files_per_day` files a day instead of one for each task and day. `name` tells
    several streams into one log apart.
    """
    if schema is None:
        schema = spark.read.format(fmt).load(source).schema
    stream = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", max_files).load(source))

    def write(batch, number: int) -> None:
        append_batch(batch, log, f"{name}-{number}", ts, files_per_day)

    w = stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "activity-batches-ckpt"))
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=trigger)
    return w.start()
