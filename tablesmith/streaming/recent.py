"""The newest k actions of every owner, kept up to date as actions arrive.

Each owner has a keyed state of k rows at most (`transformWithState`, RocksDB): a micro-batch
merges its rows into the states of the owners it touches and hands on those owners' new
lists. Lists are written as one folder for each micro-batch, overwritten when the batch runs
again after a restart; the reader takes each owner's latest list. Rows of an owner beyond the
newest k never reach the state, whatever the owner's share of the stream.

Order: newest time first, then the largest tie column, NULL last, as in
`operators.activity.recent_activity_per_user`. Rows without an owner are one owner.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tablesmith.operators.activity import RECENT_PER_USER
from tablesmith.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Newest(StatefulProcessor):
    """State: the owner's newest rows as (time in microseconds, tie, row as JSON)."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("newest", "t long, tie long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        def number(v):
            return None if pd.isna(v) else int(v)

        found = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for part in rows:
            found += [(number(t), number(tie), row) for t, tie, row in zip(part["t"], part["tie"], part["row"])]
            found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2]), reverse=True)
            del found[self.k:]
        self.rows.put(found)
        yield pd.DataFrame({"owner": [key[0]] * len(found), "rank": range(1, len(found) + 1), "row": [r[2] for r in found]})

    def close(self) -> None:
        pass


def stream_recent_activity(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None, schema: T.StructType | None = None,
                           k: int = RECENT_PER_USER, owner: str = "user_id", ts: str = "ts", tie: str = "event_id", fmt: str = "parquet",
                           trigger: str = "availableNow", max_files: int = 1000) -> StreamingQuery:
    """Start it; `tie` is a whole-number column. The state store's provider is set for this session while the query starts."""
    if schema is None:
        schema = spark.read.format(fmt).load(source).schema
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(source)
    rows = stream.select(F.col(owner).cast("string").alias("owner"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
                         F.col(tie).cast("long").alias("tie"), F.to_json(F.struct("*"), JSON).alias("row"))
    lists = rows.groupBy("owner").transformWithStateInPandas(
        statefulProcessor=Newest(k), outputStructType="owner string, rank int, row string", outputMode="Update", timeMode="None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    w = lists.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "recent-ckpt"))
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=trigger)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return w.start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def read_recent_activity(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The rows of the latest lists, with `rank`."""
    rows = spark.read.option("basePath", sink).parquet(f"{sink.rstrip('/')}/batch=*")
    latest = rows.groupBy("owner").agg(F.max("batch").alias("batch")).withColumnRenamed("owner", "o")
    rows = rows.join(latest.withColumnRenamed("batch", "b"), F.col("owner").eqNullSafe(F.col("o")) & (F.col("batch") == F.col("b")))
    return rows.select(F.from_json("row", schema, JSON).alias("r"), "rank").select("r.*", "rank")
