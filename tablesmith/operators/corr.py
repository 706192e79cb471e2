"""Pearson correlation in one scan, with two treatments of missing values (NULL, NaN).

nulls="zero":     a missing value counts as 0 (what the reference's `stat.corr` and the
                  browser heat map do).
nulls="pairwise": only rows where both values are present.

A zero-variance column gives NULL, never an error. All pairs come from one scan of
per-partition co-moments (operators/comoments.py), by the same method at every width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import numeric_columns, require_columns
from tablesmith.operators.comoments import pair_moments, pearson_from_moments


def _pairs_agg(df: DataFrame, pairs: list[tuple[str, str]], nulls: str,
               min_count: int | None = None) -> DataFrame:
    """(a, b, r) for the listed pairs from one co-moment scan. When every pair shares
    one right-hand column (a target), only those pairs are computed."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    rights = list(dict.fromkeys(b for _, b in pairs))
    if len(rights) == 1:
        xcols, ycols = list(dict.fromkeys(a for a, _ in pairs)), rights
    else:
        xcols, ycols = list(dict.fromkeys([c for p in pairs for c in p])), None
    m = pearson_from_moments(pair_moments(df, xcols, ycols, nulls)).select("i", "j", "n", "r")
    px, py = {c: i for i, c in enumerate(xcols)}, {c: j for j, c in enumerate(ycols or xcols)}
    place = lambda a, b: (px[a], py[b]) if ycols else sorted((px[a], py[b]))
    wanted = df.sparkSession.createDataFrame(
        [(*place(a, b), a, b) for a, b in pairs], "i int, j int, a string, b string")
    out = F.broadcast(wanted).join(m, ["i", "j"], "left")  # at most |X|*|Y| pairs
    r = F.col("r")
    if min_count is not None:  # too few complete pairs (or none at all) -> 0.0
        r = F.when(F.col("n").isNull() | (F.col("n") < min_count), F.lit(0.0)).otherwise(r)
    return out.select("a", "b", r.alias("r"))


def corr_pairs(df: DataFrame, cols: list[str] | None = None, max_cols: int | None = None,
               nulls: str = "zero") -> DataFrame:
    """(a, b, r) for every pair i<j of the numeric columns (of the first `max_cols` if given)."""
    cols = (cols if cols is not None else numeric_columns(df))[:max_cols]
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return _pairs_agg(df, pairs, nulls)


def corr_with_target(df: DataFrame, target: str, features: list[str] | None = None,
                     nulls: str = "zero") -> DataFrame:
    """(feature, r): correlation of every feature with the target, in one scan."""
    require_columns(df, [target])
    feats = [c for c in (features if features is not None else numeric_columns(df)) if c != target]
    return _pairs_agg(df, [(f, target) for f in feats], nulls).select(
        F.col("a").alias("feature"), "r")


def corr_matrix(df: DataFrame, cols: list[str] | None = None, nulls: str = "zero",
                min_count: int = 2) -> DataFrame:
    """Full N x N matrix (x, y, r) including the diagonal; fewer than `min_count`
    complete pairs gives 0.0, zero variance gives NULL."""
    cols = cols if cols is not None else numeric_columns(df)
    require_columns(df, cols)
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    upper = _pairs_agg(df, pairs, nulls, min_count)
    fwd = F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "r")
    rev = F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "r")
    mirrored = F.when(F.col("a") == F.col("b"), F.array(fwd)).otherwise(F.array(fwd, rev))
    return upper.select(F.inline(mirrored))
