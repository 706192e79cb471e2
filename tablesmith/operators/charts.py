"""Chart-ready aggregates over the whole table.

Values follow the browser `Number(v)` rule (blank -> 0, text that is not a number is
dropped); with the default nulls="zero" a SQL NULL counts as a blank, i.e. 0. Category keys
are strings; NULL and '' go to the `__MISSING__` bucket. Every chart is one Spark plan and
only aggregated rows reach the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import qcol, require_columns
from tablesmith.functions.numbers import js_number
from tablesmith.operators.quantiles import grouped_quantiles, quantile_agg

# Fixed value: bucket name for a missing category.
MISSING = "__MISSING__"
AGGREGATES = ("count", "sum", "mean", "min", "max")


def category_key(df: DataFrame, x: str) -> Column:
    require_columns(df, [x])
    return F.coalesce(F.nullif(qcol(x).cast("string"), F.lit("")), F.lit(MISSING))


def value_of(df: DataFrame, y: str, nulls: str = "zero") -> Column:
    require_columns(df, [y])
    return js_number(qcol(y), df.schema[y].dataType, nulls)


def _aggregate(v: Column, agg: str) -> Column:
    if agg == "count":
        return F.count(v).cast("double")
    if agg == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    if agg == "mean":
        return F.avg(v)
    if agg == "min":
        return F.min(v)
    if agg == "max":
        return F.max(v)
    raise ValueError(f"agg must be one of {AGGREGATES}, not {agg!r}")


def top_n(bars: DataFrame, n: int, value: str = "value", key: str = "key") -> DataFrame:
    """Largest `n` rows by value (ties by key); n <= 0 keeps all. Spark plans this as a
    per-partition top-n plus a final merge (TakeOrderedAndProject), no full sort."""
    if n and n > 0:
        return bars.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc()).limit(int(n))
    return bars


def bar(df: DataFrame, x: str, y: str, agg: str = "sum", n: int = 0,
        nulls: str = "zero") -> DataFrame:
    """(key, value): one aggregate of y per category of x, optionally the top n."""
    v = value_of(df, y, nulls)
    out = df.groupBy(category_key(df, x).alias("key")).agg(_aggregate(v, agg).alias("value"))
    return top_n(out, n)


def grouped_bar(df: DataFrame, x: str, g: str, y: str, agg: str = "sum",
                nulls: str = "zero", pivot_values: list | None = None) -> DataFrame:
    """(key, group, value): aggregate of y per x and sub-group g.

    With `pivot_values` the groups become columns (one per listed value; listing them
    avoids the extra distinct pass Spark needs otherwise).
    """
    v = value_of(df, y, nulls)
    out = df.groupBy(category_key(df, x).alias("key"), category_key(df, g).alias("group")) \
            .agg(_aggregate(v, agg).alias("value"))
    if pivot_values is not None:
        return out.groupBy("key").pivot("group", pivot_values).agg(F.first("value"))
    return out


def category_counts(df: DataFrame, x: str) -> DataFrame:
    """(key, n): rows per category (pie / doughnut)."""
    return df.groupBy(category_key(df, x).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, x: str, bins: int = 20, nulls: str = "zero",
              value_range: tuple[float, float] | None = None) -> DataFrame:
    """(bin, lo, hi, n) for `bins` equal-width bins between min and max; empty bins have n=0.

    Two passes: the range (two scalars to the driver), then one grouped count; pass a
    known `value_range` (e.g. from a profile) to skip the first. The last bin is closed;
    when min = max everything falls in bin 0.
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    v = value_of(df, x, nulls)
    vals = df.select(v.alias("v")).filter(F.col("v").isNotNull())
    if value_range is not None:
        lo, hi = value_range
        vals = vals.filter((F.col("v") >= F.lit(float(lo))) & (F.col("v") <= F.lit(float(hi))))
    else:
        lo, hi = vals.agg(F.min("v"), F.max("v")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    span = float(hi) - float(lo)
    if span == 0:
        idx = F.lit(0).cast("bigint")
    else:
        idx = F.least(F.floor((F.col("v") - F.lit(float(lo))) / F.lit(span) * F.lit(bins))
                      .cast("bigint"), F.lit(bins - 1).cast("bigint"))
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(float(lo)) + F.col("id") * F.lit(span) / F.lit(bins)).alias("lo"),
        (F.lit(float(lo)) + (F.col("id") + 1) * F.lit(span) / F.lit(bins)).alias("hi"))
    # both sides have at most `bins` rows
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin", "lo", "hi", F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def boxplot(df: DataFrame, x: str, y: str, nulls: str = "zero", method: str = "distributed",
            accuracy: int = 10000) -> DataFrame:
    """(key, min, q1, median, q3, max) per category; quantiles interpolate linearly.

    method="distributed": exact, in two scans (operators/quantiles.py; rows are not shuffled
    by category, so a hot one is spread over all tasks); "map": Spark's exact `percentile`; "approx": a sketch with
    rank error 1/accuracy.
    """
    v = value_of(df, y, nulls)
    base = df.select(category_key(df, x).alias("key"), v.alias("v")).filter(F.col("v").isNotNull())
    if method == "distributed":
        out = grouped_quantiles(base, ["key"], "v", [0.25, 0.5, 0.75], accuracy)
    else:
        out = base.groupBy("key").agg(F.min("v").alias("min"),
                                      quantile_agg(F.col("v"), (0.25, 0.5, 0.75), method, accuracy).alias("q"),
                                      F.max("v").alias("max"))
    return out.select("key", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                      F.col("q")[2].alias("q3"), "max")


def scatter_points(df: DataFrame, x: str, y: str, nulls: str = "zero",
                   fraction: float | None = None, seed: int = 42) -> DataFrame:
    """(x, y) pairs where both values are numbers; optional seeded sample for display."""
    pts = df.select(value_of(df, x, nulls).alias("x"), value_of(df, y, nulls).alias("y")) \
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return pts.sample(fraction=fraction, seed=seed) if fraction else pts


def line_series(df: DataFrame, x: str, y: str, nulls: str = "zero") -> DataFrame:
    """(pos, x, y) sorted by x, then y; pos = 0, 1, 2, ... in that order.

    Rows are numbered inside data-sized ranges of x (operators/ranks.py), and each range
    starts at the number of rows before it: one shuffle, nothing is stored, and no step puts
    all rows in one partition.
    """
    from tablesmith.operators.ranks import numbered
    require_columns(df, [x])
    pts = df.select(qcol(x).alias("x"), value_of(df, y, nulls).alias("y"))
    return numbered(pts, "x", "y", "pos").select("pos", "x", "y")


def line_pixels(df: DataFrame, x: str, y: str, width: int, nulls: str = "zero") -> DataFrame:
    """(pixel, x, y): the points that draw the same line on `width` pixel columns.

    For each column of pixels the first, last, lowest and highest point (M4): at most four
    rows a column, fewer where one point is two of them. Ties: the lowest x, then the lowest
    y, for the first; the highest for the last; the lowest x among equally low or high ones.
    x is a number, date or time; rows without x or y are left out; when all x are equal,
    everything is in column 0. Two scans: the ends of x, then one aggregation.
    """
    from tablesmith.operators.ranks import order_code
    if width < 1:
        raise ValueError("width must be >= 1")
    require_columns(df, [x])
    code = order_code(qcol(x), df.schema[x].dataType)
    if code is None or df.schema[x].dataType.typeName() == "string":
        raise ValueError(f"column {x!r} has no numeric scale")
    pts = df.select(qcol(x).alias("x"), code.alias("o"), value_of(df, y, nulls).alias("y")).where("o is not null and y is not null and not isnan(o)")
    lo, hi = pts.agg(F.min("o"), F.max("o")).first()
    if lo is None:
        return pts.select(F.lit(0).cast("bigint").alias("pixel"), "x", "y")
    span = float(hi) - float(lo)
    pixel = F.lit(0) if span == 0 else F.least(F.floor((F.col("o") - F.lit(float(lo))) / F.lit(span) * F.lit(width)), F.lit(width - 1))
    by_x, by_y = F.struct("x", "y"), F.struct("y", "x")
    high = F.struct((-F.col("y")).alias("ny"), "x")  # lowest x of the highest points
    four = pts.groupBy(pixel.cast("bigint").alias("pixel")).agg(
        F.min(by_x).alias("a"), F.max(by_x).alias("b"), F.min(by_y).alias("c"), F.min(high).alias("d"), F.max("y").alias("top"))
    corners = F.array(F.col("a"), F.col("b"), F.struct(F.col("c.x").alias("x"), F.col("c.y").alias("y")),
                      F.struct(F.col("d.x").alias("x"), F.col("top").alias("y")))
    return four.select("pixel", F.inline(F.array_distinct(corners)))


def scatter_tiles(df: DataFrame, x: str, y: str, levels: int = 6, nulls: str = "zero",
                  value_range: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(level, ix, iy, n): points in the cells of a quad-tree over the points' rectangle.

    Level k cuts both axes into 2**k equal parts; empty cells are absent; the last cell of an
    axis is closed. Points are counted once, in the cells of the finest level; coarser levels
    add those counts up, so every level's total is the number of points. `value_range`
    (xmin, xmax, ymin, ymax) saves the scan for the ends; points outside it are left out.
    """
    if levels < 0 or levels > 30:
        raise ValueError("levels must be between 0 and 30")
    pts = scatter_points(df, x, y, nulls).where("not isnan(x) and not isnan(y)")
    if value_range is None:
        value_range = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if value_range[0] is None:
            value_range = (0.0, 0.0, 0.0, 0.0)
    x0, x1, y0, y1 = map(float, value_range)
    pts = pts.where((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))
    cells = 1 << levels

    def cell(c: str, lo: float, hi: float) -> Column:
        if hi <= lo:
            return F.lit(0).cast("bigint")
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * F.lit(cells)), F.lit(cells - 1)).cast("bigint")

    finest = pts.groupBy(cell("x", x0, x1).alias("ix"), cell("y", y0, y1).alias("iy")).agg(F.count("*").alias("n"))
    up = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("ix", levels - k).alias("ix"), F.shiftright("iy", levels - k).alias("iy"))
                   for k in range(levels + 1)])
    return finest.select(F.inline(up), "n").groupBy("level", "ix", "iy").agg(F.sum("n").alias("n"))


def histogram_width_bins(df: DataFrame, x: str, nulls: str = "zero", max_bins: int | None = None) -> DataFrame:
    """The histogram whose bin width follows the data (Freedman-Diaconis): (bin, lo, hi, n).

    Width 2 IQR / n^(1/3) from the exact quartiles; ceil((max - min) / width) equal bins, as many
    as values at most, one when the quartiles or the ends coincide. `max_bins` is a limit only the caller sets.
    """
    from tablesmith.operators.quantiles import column_quantiles
    vals = df.select(value_of(df, x, nulls).alias("v")).where("v is not null and not isnan(v)")
    r = column_quantiles(vals, ["v"], [0.25, 0.75]).first()
    if not r.n:
        return histogram(vals, "v", 1, nulls="skip")
    width = 2 * (r.q[1] - r.q[0]) / r.n ** (1 / 3)
    bins = min(r.n, max(1, math.ceil((r["max"] - r["min"]) / width))) if width > 0 else 1
    return histogram(vals, "v", min(bins, max_bins) if max_bins else bins, nulls="skip", value_range=(r["min"], r["max"]))


def histogram_equal_depth(df: DataFrame, x: str, bins: int = 10, nulls: str = "zero") -> DataFrame:
    """(bin, lo, hi, n): bins between the exact bins-quantiles; equal edges are one edge.

    A bin holds lo <= v < hi, the last one also its end.
    """
    from tablesmith.operators.quantiles import column_quantiles
    if bins < 1:
        raise ValueError("bins must be >= 1")
    vals = df.select(value_of(df, x, nulls).alias("v")).where("v is not null and not isnan(v)")
    r = column_quantiles(vals, ["v"], [i / bins for i in range(bins + 1)]).first()
    spark = df.sparkSession
    if not r.n:
        return spark.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    edges = sorted(set(r.q))
    if len(edges) == 1:
        edges = edges * 2
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    place = F.size(F.filter(inner, lambda e: e <= F.col("v"))).cast("bigint")
    counts = vals.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin bigint, lo double, hi double")
    return table.join(F.broadcast(counts), "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def column_summary(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(column, role, share): share of values that read as numbers, in one pass;
    role is 'numeric' when share >= threshold, else 'categorical'."""
    structs = []
    for pos, f in enumerate(df.schema.fields):
        ok = js_number(qcol(f.name), f.dataType, "zero").isNotNull().cast("double")
        structs.append(F.struct(F.lit(pos).alias("position"), F.lit(f.name).alias("column"),
                                F.avg(ok).alias("share")))
    out = df.agg(F.array(*structs).alias("s")).select(F.inline("s"))
    role = F.when(F.col("share") >= F.lit(threshold), F.lit("numeric")).otherwise(F.lit("categorical"))
    return out.select("position", "column", role.alias("role"), "share")


def infer_numeric_vote(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(column, role) by the numeric-share vote."""
    return column_summary(df, threshold).select("column", "role")
