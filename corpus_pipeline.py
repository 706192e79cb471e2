"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns
of `documents`; the last returns token ids and the text they decode to. NULLs, empty and
repeated rows are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.bpe import encode_documents
from tablesmith.llm.common import documents, stored, text_of
from tablesmith.llm.line_dedup import line_dedup
from tablesmith.llm.mixing import mix
from tablesmith.llm.near_dedup import near_dedup
from tablesmith.llm.quality import judge
from tablesmith.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(d: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged."""
    d = docs.select(*COLUMNS)
    kept = judge(d.withColumn("_row", F.struct(*COLUMNS)), keep=("_row",)).where("kept")
    return kept.select("_row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of two lines or more that stand earlier."""
    return _columns(line_dedup(docs, keep=("lang", "source")).withColumnRenamed("kept_text", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"))
    d = docs.select(*COLUMNS).withColumn("_t", F.xxhash64(text_of()))
    d = d.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left_semi")
    return d.dropDuplicates(["doc_id", "_t"]).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole and unchanged, as often as the mix takes it; the last share of one rounds to all of it or nothing."""
    d = docs.select(*COLUMNS).withColumn("_t", F.xxhash64(text_of()))
    share = mix(d, keep=("_t",)).groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_h")).agg(
        F.sum("taken").alias("taken"), F.max("size").alias("size")).where("size > 0")
    share = share.withColumn("copies", F.floor(F.col("taken") / F.col("size") + 0.5)).where("copies > 0").select("_d", "_h", "copies")
    d = d.dropDuplicates(["doc_id", "_t"]).join(
        share, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")))
    return d.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), decoded (the text they decode to)."""
    return encode_documents(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("line dedup", repeated_lines), ("near-dedup", near_duplicates),
          ("mixing", mixture), ("bpe", bpe_tokens)]

ORACLE_SQL = None  # neither Order MinHash nor BPE can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored in the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
