"""Small schema helpers shared by the operators (driver side, metadata only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qcol(name: str) -> Column:
    """Column by exact name, safe for dots, spaces and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    """Every Spark NumericType is a measure (bigint, smallint, decimal included)."""
    return isinstance(dt, T.NumericType)


def role_of(dt: T.DataType) -> str:
    return "numeric" if is_numeric(dt) else "string"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def orderable(dt: T.DataType) -> bool:
    """Types with min/max (maps and variants are not ordered)."""
    if isinstance(dt, T.MapType):
        return False
    if isinstance(dt, T.ArrayType):
        return orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(orderable(f.dataType) for f in dt.fields)
    return type(dt).__name__ != "VariantType"


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)] or [[]]


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {missing}")
