"""Shared pieces: the word rule, document keys, scratch tables in the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import scratch_path

# White space of the word rule: space and U+0009 to U+000D. Everything else belongs to words.
WS_CHARS = " \t\n\x0b\x0c\r"
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a NULL counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, th, text): th tells apart rows that share a doc_id but not a text.

    Rows that repeat both are one document; the operators give each of them the same result.
    """
    t = text_of(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def stored(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """`df` written below spark.checkpoint.dir and read again: cuts the lineage, survives lost executors.

    The table's path is added to `made`, for `discard`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of jobs that are over
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete stored tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)
