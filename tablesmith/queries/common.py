"""Shared inputs for the registered queries: table loading, injected-null variants
(the test tables have no nulls) and SQL generators for per-column oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.sources.files import read_table


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def r6(c):
    return F.round(c, 6)


# lineitem with missing values: quantity is NULL for every 7th order key, extended
# price for every 5th (all rows are kept).
LI_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
           ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
           ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
           ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
LI_NUMERIC = [c for c, t in LI_COLS if t in ("bigint", "int", "double")]


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = T(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


LI_NULLS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


# the same with NaN too, which charts and correlations take for missing: quantity at every
# 11th order key, extended price at every 13th.
def lineitem_gaps(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem_nulls(spark, sf)
    k, nan = F.col("l_orderkey"), F.lit(float("nan"))
    return li.withColumn("l_quantity", F.when(k % 11 == 0, nan).otherwise(F.col("l_quantity"))) \
             .withColumn("l_extendedprice", F.when(k % 13 == 0, nan).otherwise(F.col("l_extendedprice")))


LI_GAPS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 5 = 0 OR l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


# events with missing and blank categories for the __MISSING__ bucket.
def events_gaps(spark: SparkSession, sf: str) -> DataFrame:
    ev = T(spark, sf, "events")
    k = F.col("event_id")
    return ev.withColumn("event_type", F.when(k % 11 == 0, F.lit(None))
                         .when(k % 13 == 0, F.lit("")).otherwise(F.col("event_type")))


EV_GAPS_SQL = """(SELECT event_id, ts, user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS event_type,
  value, props FROM events)"""


# part with an all-null, a constant, and a constant-plus-nulls column.
def part_drops(spark: SparkSession, sf: str) -> DataFrame:
    p = T(spark, sf, "part")
    return p.select("*", F.lit(None).cast("double").alias("k_empty"), F.lit(1).alias("k_const"),
                    F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.lit(7)).alias("k_const_null"))


PART_DROPS_SQL = """(SELECT *, CAST(NULL AS DOUBLE) AS k_empty, 1 AS k_const,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 7 END AS k_const_null FROM part)"""
PART_DROPS_COLS = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
                   ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"),
                   ("k_empty", "double"), ("k_const", "int"), ("k_const_null", "int")]

NUMERIC_TYPES = ("bigint", "int", "double", "smallint", "tinyint", "float")


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def profile_sql(src: str, cols: list[tuple[str, str]]) -> str:
    """Per-column profile rows, as the DuckDB oracle of profile_table."""
    parts = []
    for i, (c, t) in enumerate(cols):
        role = "numeric" if t in NUMERIC_TYPES else "string"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, '{role}' AS role, "
            f"count(*) AS rows, count({c}) AS nonnull, count(*) - count({c}) AS missing, "
            f"CASE WHEN count({c}) = 0 THEN 'empty' "
            f"WHEN min({c}) IS NOT DISTINCT FROM max({c}) AND count(*) - count({c}) = 0 THEN 'constant' END AS reason "
            f"FROM {src}")
    return union_all(parts)


def corr_sql(a: str, b: str, src: str, nulls: str = "zero") -> str:
    if nulls == "zero":
        e = f"corr(coalesce(CAST({a} AS DOUBLE), 0), coalesce(CAST({b} AS DOUBLE), 0))"
    else:
        e = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"CASE WHEN isnan({e}) THEN NULL ELSE round({e}, 6) END"
