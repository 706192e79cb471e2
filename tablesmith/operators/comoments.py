"""Pairwise co-moments in one pass: per-partition numpy statistics in column tiles, merged as a tree.

For a left column set X and a right set Y, each partition reduces its rows (Arrow
batches) to, for every pair (x, y) over the rows where both values are present: count n,
mean of x, mean of y, second central moments of x and y, and the co-moment C. Values are
centred on the batch median before the matrix products (exact zero for a constant column,
robust to outliers), and batches are merged with the parallel (Chan et al.) update.

A partition hands on one row for each tile of `TILE` by `TILE` columns, so no row is larger
than one tile (6 arrays of 8 kB) however wide the table is. A tile's rows are merged by the
same update, `FAN_IN` partitions at a time, then what is left of them: two levels hold
FAN_IN squared partitions, and each level's groups at most FAN_IN rows below that. Only a
tile's last row is taken apart into pairs. With X = Y tiles below the diagonal are not made;
a target correlation uses Y = [target], so its cost is linear in the number of features.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import qcol

try:  # ship these functions by value: executors need numpy/pandas, not this package
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

TILE = 32
FAN_IN = 512
ARRAYS = ("n", "mx", "my", "m2x", "m2y", "c")
TILE_SCHEMA = "ti int, tj int, part int, " + ", ".join(f"{k} array<double>" for k in ARRAYS)


def _centred(x: np.ndarray):
    present = ~np.isnan(x)
    with np.errstate(all="ignore"):
        shift = np.nanmedian(np.where(present, x, np.nan), axis=0) if x.shape[1] else np.zeros(0)
    shift = np.where(np.isnan(shift), 0.0, shift)
    return present.astype(np.float64), np.where(present, x - shift, 0.0), shift


def _batch_stats(x: np.ndarray, y: np.ndarray):
    mx_, xc, sh_x = _centred(x)
    my_, yc, sh_y = _centred(y)
    n = mx_.T @ my_
    sx, sy = xc.T @ my_, mx_.T @ yc
    sxx, syy, sxy = (xc * xc).T @ my_, mx_.T @ (yc * yc), xc.T @ yc
    with np.errstate(all="ignore"):
        ax = np.where(n > 0, sx / n, 0.0)
        ay = np.where(n > 0, sy / n, 0.0)
    return n, ax + sh_x[:, None], ay + sh_y[None, :], sxx - sx * ax, syy - sy * ay, sxy - sx * ay


def _merge(a, b):
    na, xa, ya, m2xa, m2ya, ca = a
    nb, xb, yb, m2xb, m2yb, cb = b
    n = na + nb
    both = (na > 0) & (nb > 0)
    with np.errstate(all="ignore"):
        w = np.where(n > 0, nb / n, 0.0)
        f = np.where(n > 0, na * nb / n, 0.0)
    dx, dy = np.where(both, xb - xa, 0.0), np.where(both, yb - ya, 0.0)
    mx = np.where(na > 0, xa + dx * w, xb)
    my = np.where(na > 0, ya + dy * w, yb)
    return n, mx, my, m2xa + m2xb + dx * dx * f, m2ya + m2yb + dy * dy * f, ca + cb + dx * dy * f


def _partition_tiles(kx: int, ky: int, zero: bool, upper: bool):
    """Arrow batches of one partition -> one row for each tile; with `upper` only those on and above the diagonal."""
    def run(batches):
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            arr = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            if zero:  # a missing value counts as 0
                arr = np.where(np.isnan(arr), 0.0, arr)
            s = _batch_stats(arr[:, :kx], arr if upper else arr[:, kx:])
            acc = s if acc is None else _merge(acc, s)
        if acc is None:
            return
        part = TaskContext.get().partitionId()
        for i in range(0, kx, TILE):
            for j in range(i if upper else 0, ky, TILE):
                tile = {k: [a[i:i + TILE, j:j + TILE].ravel()] for k, a in zip(ARRAYS, acc)}
                yield pd.DataFrame({"ti": [i // TILE], "tj": [j // TILE], "part": [part], **tile})
    return run


def _merge_tiles(rows: pd.DataFrame) -> pd.DataFrame:
    """One tile's rows, in order of their partitions -> one."""
    rows = rows.sort_values("part")
    acc = None
    for r in rows.itertuples():
        s = tuple(np.asarray(getattr(r, k), dtype=np.float64) for k in ARRAYS)
        acc = s if acc is None else _merge(acc, s)
    first = rows.iloc[0]
    return pd.DataFrame({"ti": [first["ti"]], "tj": [first["tj"]], "part": [first["part"] // FAN_IN],
                         **{k: [a] for k, a in zip(ARRAYS, acc)}})


def pair_moments(df: DataFrame, xcols: list[str], ycols: list[str] | None = None,
                 nulls: str = "zero") -> DataFrame:
    """(i, j, n, m2x, m2y, c) for every pair (xcols[i], ycols[j]) with a row where both are present.

    Without ycols the pairs are those of xcols with i <= j.
    """
    if nulls not in ("zero", "pairwise"):
        raise ValueError(f"nulls must be 'zero' or 'pairwise', not {nulls!r}")
    upper = ycols is None
    kx, ky = len(xcols), len(xcols if upper else ycols)
    src = df.select(*[qcol(c).cast("double").alias(f"x{i}") for i, c in enumerate(xcols)],
                    *[qcol(c).cast("double").alias(f"y{j}") for j, c in enumerate(ycols or [])])
    tiles = src.mapInPandas(_partition_tiles(kx, ky, nulls == "zero", upper), TILE_SCHEMA)
    for _ in range(2):
        tiles = tiles.groupBy("ti", "tj", (F.col("part") / FAN_IN).cast("int")).applyInPandas(_merge_tiles, TILE_SCHEMA)
    # beyond FAN_IN squared partitions a tile still has several rows
    tiles = tiles.groupBy("ti", "tj").applyInPandas(_merge_tiles, TILE_SCHEMA)
    width = F.least(F.lit(TILE), F.lit(ky) - F.col("tj") * TILE)
    cells = tiles.select("ti", "tj", width.alias("w"), F.posexplode(F.arrays_zip("n", "m2x", "m2y", "c")).alias("k", "s"))
    out = cells.select((F.col("ti") * TILE + (F.col("k") / F.col("w")).cast("int")).alias("i"),
                       (F.col("tj") * TILE + F.col("k") % F.col("w")).cast("int").alias("j"), "s.*")
    return out.where("n > 0 and i <= j" if upper else "n > 0")


def pearson_from_moments(m: DataFrame) -> DataFrame:
    """Adds r = C / sqrt(M2x * M2y); zero spread gives NULL."""
    den = F.sqrt(F.greatest(F.col("m2x"), F.lit(0.0)) * F.greatest(F.col("m2y"), F.lit(0.0)))
    return m.withColumn("r", F.try_divide(F.col("c"), den))
