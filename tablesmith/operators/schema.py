"""Projection, renaming and casts. Name work is schema metadata (driver side); value
work is Column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablesmith.functions.columns import is_numeric, qcol, require_columns
from tablesmith.functions.names import is_id_like, sanitize_names
from tablesmith.functions.numbers import to_double


def sanitize_columns(df: DataFrame, strict: bool = False) -> DataFrame:
    """Clean every column name in one projection; collisions get `_2`, `_3`, ..."""
    return df.toDF(*sanitize_names(df.columns, strict))


def classify_columns(df: DataFrame, role: str = "numeric") -> DataFrame:
    """The table reduced to its numeric or its string (non-numeric) columns."""
    if role not in ("numeric", "string"):
        raise ValueError("role must be 'numeric' or 'string'")
    keep = [f.name for f in df.schema.fields if is_numeric(f.dataType) == (role == "numeric")]
    return df.select(*[qcol(c) for c in keep])


def cast_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns to double via text: blank -> NULL, unparsable -> NULL."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    require_columns(df, cols)
    todo = set(cols)
    return df.select(*[to_double(qcol(c)).alias(c) if c in todo else qcol(c) for c in df.columns])


def cast_target(df: DataFrame, target: str) -> DataFrame:
    """Target to double; values that do not parse become NULL."""
    return cast_numeric(df, [target])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require_columns(df, [old])
    return df.withColumnRenamed(old, new)


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def select_column(df: DataFrame, c: str) -> DataFrame:
    require_columns(df, [c])
    return df.select(qcol(c))


def exclude_id_like(df: DataFrame, match: str = "substring") -> DataFrame:
    """Project away identifier-like columns (`index`, `id`, `sno` in the name)."""
    return df.select(*[qcol(c) for c in df.columns if not is_id_like(c, match)])
