"""Row filters and the trainability checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import is_numeric, qcol, require_columns
from tablesmith.functions.names import is_id_like
from tablesmith.functions.numbers import js_number

# Fixed value: fewest rows a table needs before training is offered.
MIN_TRAIN_ROWS = 5


def filter_not_null(df: DataFrame, c: str) -> DataFrame:
    require_columns(df, [c])
    return df.filter(qcol(c).isNotNull())


def filter_null(df: DataFrame, c: str) -> DataFrame:
    require_columns(df, [c])
    return df.filter(qcol(c).isNull())


def dropna_subset(df: DataFrame, cols: list[str]) -> DataFrame:
    require_columns(df, cols)
    return df.dropna(subset=cols)


def fillna_blank(df: DataFrame) -> DataFrame:
    """Every column as text with NULL -> '' (what the browser receives)."""
    return df.select(*[F.coalesce(qcol(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def filter_numeric_pairs(df: DataFrame, x: str, y: str, nulls: str = "zero") -> DataFrame:
    """Rows where both x and y read as numbers, with the parsed values."""
    require_columns(df, [x, y])
    vx = js_number(qcol(x), df.schema[x].dataType, nulls)
    vy = js_number(qcol(y), df.schema[y].dataType, nulls)
    return df.select(vx.alias(x), vy.alias(y)).filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def target_candidates(df: DataFrame, match: str = "substring") -> list[str]:
    """Numeric, non-identifier column names (schema only)."""
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and not is_id_like(f.name, match)]


def suggest_targets(df: DataFrame, match: str = "substring", exact: bool = True) -> DataFrame:
    """(column, nonnull, distinct) for each numeric non-identifier column."""
    cands = target_candidates(df, match)
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, nonnull bigint, distinct bigint")
    if exact:
        from tablesmith.operators.distinct import counts, distinct_state
        chosen = df.select(*[qcol(c) for c in cands])
        found = counts(distinct_state(chosen), chosen.schema).select("column", F.col("values").alias("distinct"))
        from tablesmith.operators.profile import nonnull_counts
        return nonnull_counts(chosen).join(F.broadcast(found), "column").select("column", "nonnull", "distinct")
    structs = [F.struct(F.lit(c).alias("column"), F.count(qcol(c)).alias("nonnull"),
                        F.approx_count_distinct(qcol(c)).cast("bigint").alias("distinct")) for c in cands]
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def can_train(df: DataFrame, match: str = "substring") -> DataFrame:
    """(rows, targets, ok): at least one target candidate and MIN_TRAIN_ROWS rows."""
    n_targets = len(target_candidates(df, match))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(n_targets).cast("bigint").alias("targets"),
        ((F.col("rows") >= MIN_TRAIN_ROWS) & F.lit(n_targets > 0)).alias("ok"))
