"""chart_data(df, spec): the browser's (type, X, Y, agg, N, G) controls as one Spark plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import qcol
from tablesmith.functions.numbers import js_number
from tablesmith.operators import charts as ch
from tablesmith.operators.corr import corr_matrix

CHART_TYPES = ("bar", "grouped_bar", "line", "scatter", "pie", "doughnut", "histogram",
               "boxplot", "heatmap")


@dataclass
class ChartSpec:
    type: str
    x: str | None = None
    y: str | None = None
    agg: str = "sum"
    n: int = 0
    group: str | None = None
    bins: int = 20
    rule: str = "count"                 # histogram: "count" (equal bins), "width" (by the data), "depth" (equal counts)
    width: int | None = None            # line: the points that draw it on so many pixel columns
    levels: int | None = None           # scatter: counts in a quad-tree of so many levels
    nulls: str = "zero"
    threshold: float = 0.6
    sample_rows: int | None = None      # chart only the first n rows in `order_by` order
    order_by: list[str] | None = None   # (whole table when sample_rows is None)


def _numeric_by_vote(df: DataFrame, threshold: float) -> list[str]:
    """Column roles by the numeric-share vote (one aggregation; one row per column)."""
    roles = ch.column_summary(df, threshold).orderBy("position").collect()
    return [r["column"] for r in roles if r["role"] == "numeric"]


def chart_data(df: DataFrame, spec: ChartSpec) -> DataFrame:
    t = spec.type
    if spec.sample_rows is not None:
        if not spec.order_by:
            raise ValueError("sample_rows needs order_by: a bare limit is not deterministic")
        from tablesmith.sources.files import scan_sample
        df = scan_sample(df, spec.sample_rows, spec.order_by)
    if t not in CHART_TYPES:
        raise ValueError(f"chart type must be one of {CHART_TYPES}")
    if t != "heatmap" and not spec.x:
        raise ValueError("select the X column")
    if t in ("bar", "grouped_bar", "line", "scatter", "boxplot") and not spec.y:
        raise ValueError(f"{t} needs X and Y")
    if t == "heatmap":
        cols = _numeric_by_vote(df, spec.threshold)
        if len(cols) < 2:
            raise ValueError("heatmap needs at least 2 numeric columns")
        # text that is not a number is left out pairwise; blanks and NULLs count as 0
        vals = df.select(*[js_number(qcol(c), df.schema[c].dataType, spec.nulls).alias(c) for c in cols])
        return corr_matrix(vals, cols, nulls="pairwise")
    if t in ("histogram", "scatter", "line", "boxplot"):
        need = {"histogram": [spec.x], "scatter": [spec.x, spec.y], "line": [spec.y],
                "boxplot": [spec.y]}[t]
        numeric = set(_numeric_by_vote(df.select(*[qcol(c) for c in set(need)]), spec.threshold))
        bad = [c for c in need if c not in numeric]
        if bad:
            raise ValueError(f"{t} requires numeric column(s): {bad}")
    if t == "bar":
        return ch.bar(df, spec.x, spec.y, spec.agg, spec.n, spec.nulls)
    if t == "grouped_bar":
        if not spec.group:
            raise ValueError("grouped bar needs a group column")
        out = ch.grouped_bar(df, spec.x, spec.group, spec.y, spec.agg, spec.nulls)
        if spec.n and spec.n > 0:
            return out.orderBy(F.col("value").desc_nulls_last(), "key", "group").limit(spec.n)
        return out
    if t in ("pie", "doughnut"):
        return ch.category_counts(df, spec.x)
    if t == "histogram":
        if spec.rule not in ("count", "width", "depth"):
            raise ValueError(f"histogram rule must be count, width or depth, not {spec.rule!r}")
        if spec.rule == "width":
            return ch.histogram_width_bins(df, spec.x, spec.nulls)
        return (ch.histogram if spec.rule == "count" else ch.histogram_equal_depth)(df, spec.x, spec.bins, spec.nulls)
    if t == "scatter":
        if spec.levels is not None:
            return ch.scatter_tiles(df, spec.x, spec.y, spec.levels, spec.nulls)
        return ch.scatter_points(df, spec.x, spec.y, spec.nulls)
    if t == "line":
        if spec.width is not None:
            return ch.line_pixels(df, spec.x, spec.y, spec.width, spec.nulls)
        return ch.line_series(df, spec.x, spec.y, spec.nulls)
    return ch.boxplot(df, spec.x, spec.y, spec.nulls)
