"""Single-pass table profile: counts, missing values, drop rules, summary statistics.

The whole profile is one aggregation over the table (chunked for very wide tables to
stay inside whole-stage codegen limits); results are unpivoted inside Spark, so only
schema metadata ever lives on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import chunks, is_numeric, orderable, qcol, role_of

# Columns per aggregation; wider tables are split so generated code stays compilable.
AGG_CHUNK = 200


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: position, column, type, role, rows, nonnull, missing, minmax_equal.

    `minmax_equal` is `min(c) <=> max(c)`: together with the null count it decides
    constant columns without a distinct count (no shuffle).
    """
    fields = list(enumerate(df.schema.fields))
    parts = []
    for chunk in chunks(fields, AGG_CHUNK):
        if not chunk:
            continue
        structs = []
        for pos, f in chunk:
            c = qcol(f.name)
            same = (F.min(c).eqNullSafe(F.max(c))) if orderable(f.dataType) else F.lit(False)
            structs.append(F.struct(
                F.lit(pos).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(role_of(f.dataType)).alias("role"),
                F.count(c).alias("nonnull"),
                same.alias("minmax_equal"),
            ))
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*structs).alias("cols"))
        parts.append(one.select("rows", F.inline("cols")))
    if not parts:
        raise ValueError("table has no columns")
    out = _union(parts)
    return out.select("position", "column", "type", "role", "rows", "nonnull",
                      (F.col("rows") - F.col("nonnull")).alias("missing"), "minmax_equal")


def drop_reason_expr():
    """'empty' when all values are null; 'constant' when one value and no nulls.

    A single value plus nulls is kept: null counts as a second value.
    """
    return (F.when(F.col("nonnull") == 0, F.lit("empty"))
            .when(F.col("minmax_equal") & (F.col("missing") == 0), F.lit("constant")))


def profile_table(df: DataFrame) -> DataFrame:
    """(position, column, type, role, rows, nonnull, missing, reason) in one pass."""
    st = column_stats(df)
    return st.select("position", "column", "type", "role", "rows", "nonnull", "missing",
                     drop_reason_expr().alias("reason"))


def row_count(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def _counts(df: DataFrame) -> DataFrame:
    """(position, column, rows, nonnull): counts only, one aggregation."""
    fields = list(enumerate(df.schema.fields))
    parts = []
    for chunk in chunks(fields, AGG_CHUNK):
        structs = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.count(qcol(f.name)).alias("nonnull")) for i, f in chunk]
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.array(*structs).alias("c")).select("rows", F.inline("c")))
    return _union(parts)


def missing_counts(df: DataFrame, nonzero_only: bool = False) -> DataFrame:
    """(column, missing); optionally only the columns with at least one null."""
    out = _counts(df).select("column", (F.col("rows") - F.col("nonnull")).alias("missing"))
    return out.filter(F.col("missing") > 0) if nonzero_only else out


def nonnull_counts(df: DataFrame) -> DataFrame:
    return _counts(df).select("column", "nonnull")


def distinct_counts(df: DataFrame, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """(column, distinct) with null counted as one more value when present.

    exact=True counts the values' mergeable state (operators/distinct.py: bitmaps of whole
    numbers, values of other types); exact=False uses HyperLogLog++ sketches: no shuffle,
    fixed memory.
    """
    if exact:
        from tablesmith.operators.distinct import counts, distinct_state
        out = counts(distinct_state(df), df.schema)
        return out.select("column", (F.col("values") + F.col("has_null").cast("int")).alias("distinct"))
    parts = []
    for chunk in chunks(list(df.schema.fields), AGG_CHUNK):
        structs = []
        for f in chunk:
            c = qcol(f.name)
            has_null = F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
            structs.append(F.struct(F.lit(f.name).alias("column"),
                                    (F.approx_count_distinct(c, rsd) + has_null).cast("bigint").alias("distinct")))
        parts.append(df.agg(F.array(*structs).alias("c")).select(F.inline("c")))
    return _union(parts)


def drop_empty_constant(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop all-null and constant columns. Returns (kept table, (column, reason) report).

    The report is one aggregation; its rows (one per column, bounded by the schema) are
    read on the driver to project the kept columns and returned as they are (no second
    pass when the caller shows the report).
    """
    rows = profile_table(df).filter(F.col("reason").isNotNull()).select("column", "reason").collect()
    report = df.sparkSession.createDataFrame([tuple(r) for r in rows], "column string, reason string")
    return df.drop(*[r["column"] for r in rows]), report


QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols: list[str] | None = None, method: str = "distributed",
             accuracy: int = 10000) -> DataFrame:
    """(column, count, mean, std, min, q1, median, q3, max) for numeric columns.

    method="distributed" (default): exact quartiles in two scans (operators/quantiles.py);
    the first also gives the moments. method="map" / "approx": one aggregation with Spark's
    `percentile` / `percentile_approx` next to the moments.
    """
    from tablesmith.operators.quantiles import column_quantiles, quantile_agg
    if cols is None:
        cols = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if not cols:
        raise ValueError("no numeric columns to describe")
    parts = []
    for chunk in chunks(cols, AGG_CHUNK // 4):
        if method == "distributed":
            names = F.element_at(F.array(*[F.lit(c) for c in chunk]), F.col("position") + 1)
            parts.append(column_quantiles(df, chunk, list(QUARTILES), accuracy).select(
                names.alias("column"), F.col("n").alias("count"), "mean", "std", "min", "q", "max"))
            continue
        structs = []
        for name in chunk:
            c = qcol(name).cast("double")
            structs.append(F.struct(
                F.lit(name).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                quantile_agg(c, QUARTILES, method, accuracy).alias("q")))
        parts.append(df.agg(F.array(*structs).alias("s")).select(F.inline("s")).select(
            "column", "count", "mean", "std", "min", "q", "max"))
    out = _union(parts)
    return out.select("column", "count", "mean", "std", "min",
                      F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                      F.col("q")[2].alias("q3"), "max")
