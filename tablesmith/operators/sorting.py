"""Ordering and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablesmith.functions.columns import qcol, require_columns


def sort_asc(df: DataFrame, cols: list[str]) -> DataFrame:
    require_columns(df, cols)
    return df.orderBy(*[qcol(c).asc() for c in cols])


def sort_desc(df: DataFrame, cols: list[str]) -> DataFrame:
    require_columns(df, cols)
    return df.orderBy(*[qcol(c).desc() for c in cols])


def top_k(df: DataFrame, cols: list[str], k: int, descending: bool = True,
          tie_cols: list[str] | None = None) -> DataFrame:
    """First k rows by `cols` (largest first by default), ties broken by `tie_cols`
    ascending. Planned as TakeOrderedAndProject: each partition keeps k rows."""
    require_columns(df, list(cols) + list(tie_cols or []))
    order = [qcol(c).desc() if descending else qcol(c).asc() for c in cols]
    order += [qcol(c).asc() for c in (tie_cols or [])]
    return df.orderBy(*order).limit(int(k))
