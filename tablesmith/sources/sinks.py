"""Writers: JSON records, CSV, append-only activity log, fitted pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import qcol


def json_records(df: DataFrame) -> DataFrame:
    """(json): one JSON object per row, every value as text, missing -> ''."""
    blanked = [F.coalesce(qcol(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*blanked)).alias("json"))


def write_json_records(df: DataFrame, path: str) -> None:
    json_records(df).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_activity_log(df: DataFrame, path: str, ts: str = "ts", files_per_day: int | None = 1) -> None:
    """Append a batch of activity records, partitioned by day (partition pruning on
    later date filters). Appends are file-level atomic per task, so a lost executor
    only re-runs its task; a batch appended twice is there twice (`activity_log.append_batch`
    is the append that counts a batch once).

    Rows are first clustered by (day, hash bucket): each day gets at most `files_per_day`
    files and a busy day is still spread over that many tasks. With None every task writes
    one file per day it holds (no shuffle).
    """
    out = df.withColumn("day", F.to_date(qcol(ts)))
    if files_per_day:
        bucket = F.pmod(F.xxhash64(*[qcol(c) for c in df.columns]), F.lit(int(files_per_day)))
        out = out.repartition(F.col("day"), bucket)
    out.write.mode("append").partitionBy("day").parquet(path)


def model_path(base: str, owner, name: str) -> str:
    """Folder for a saved model: <base>/<owner>_<name>_<6 hex>, unique per save."""
    import uuid
    return f"{base.rstrip('/')}/{owner}_{name}_{uuid.uuid4().hex[:6]}"


def save_model(model, path: str) -> str:
    """Save a fitted PipelineModel (overwrites)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
