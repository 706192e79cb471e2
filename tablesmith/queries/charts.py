"""Registered queries: chart aggregates (2.E), ordering (2.F), scalar functions (2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.text import file_extension, split_list
from tablesmith.operators import charts as ch
from tablesmith.operators import sorting as so
from tablesmith.queries.common import (EV_GAPS_SQL, LI_GAPS_SQL, T, events_gaps,
                                       lineitem_gaps, r6)
from tablesmith.queries.tables import EV_COLS, _vote_sql

QUERIES: dict = {}
ORACLE: dict = {}


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


KEY_SQL = "coalesce(nullif(CAST({c} AS VARCHAR), ''), '__MISSING__')"


def _bar_sql(x, y, agg, rnd=6):
    v = f"coalesce(CAST({y} AS DOUBLE), 0.0)"
    e = {"count": f"CAST(count({v}) AS DOUBLE)", "sum": f"coalesce(sum({v}), 0.0)",
         "mean": f"avg({v})", "min": f"min({v})", "max": f"max({v})"}[agg]
    return (f"SELECT {KEY_SQL.format(c=x)} AS key, round({e}, {rnd}) AS value "
            f"FROM {LI_GAPS_SQL} GROUP BY 1")


def _bar(agg, rnd=6):
    def run(spark, sf):
        out = ch.bar(lineitem_gaps(spark, sf), "l_returnflag", "l_extendedprice", agg)
        return out.select("key", F.round("value", rnd).alias("value"))
    return run


for _agg, _rnd in (("count", 6), ("sum", 2), ("mean", 8), ("min", 6), ("max", 6)):
    QUERIES[f"bar_{_agg}"] = _bar(_agg, _rnd)
    ORACLE[f"bar_{_agg}"] = _bar_sql("l_returnflag", "l_extendedprice", _agg, _rnd)


def flagship(spark, sf, n=3):
    """sum(l_extendedprice) per l_returnflag, largest first, top n; NULL keys -> __MISSING__."""
    out = ch.bar(lineitem_gaps(spark, sf), "l_returnflag", "l_extendedprice", "sum", n)
    return out.select("key", F.round("value", 2).alias("value"))


@q("bar_topn", f"""SELECT key, round(value, 2) AS value FROM (
  SELECT {KEY_SQL.format(c='l_suppkey')} AS key, coalesce(sum(coalesce(l_extendedprice, 0.0)), 0.0) AS value
  FROM {LI_GAPS_SQL} GROUP BY 1 ORDER BY value DESC, key LIMIT 10)""")
def bar_topn(spark, sf):
    out = ch.bar(lineitem_gaps(spark, sf), "l_suppkey", "l_extendedprice", "sum", n=10)
    return out.select("key", F.round("value", 2).alias("value"))


@q("grouped_bar", f"""SELECT {KEY_SQL.format(c='l_returnflag')} AS key, {KEY_SQL.format(c='l_linestatus')} AS "group",
  round(coalesce(sum(coalesce(l_quantity, 0.0)), 0.0), 6) AS value FROM {LI_GAPS_SQL} GROUP BY 1, 2""")
def grouped_bar(spark, sf):
    out = ch.grouped_bar(lineitem_gaps(spark, sf), "l_returnflag", "l_linestatus", "l_quantity", "sum")
    return out.select("key", "group", F.round("value", 6).alias("value"))


@q("category_counts", f"SELECT {KEY_SQL.format(c='event_type')} AS key, count(*) AS n FROM {EV_GAPS_SQL} GROUP BY 1")
def category_counts(spark, sf):
    return ch.category_counts(events_gaps(spark, sf), "event_type")


HIST_SQL = f"""WITH v AS (SELECT coalesce(l_extendedprice, 0.0) AS v FROM {LI_GAPS_SQL}),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT CASE WHEN r.hi = r.lo THEN 0 ELSE least(CAST(floor((v.v - r.lo) / (r.hi - r.lo) * 20) AS BIGINT), 19) END AS bin,
             count(*) AS n FROM v, r GROUP BY 1)
SELECT b.range AS bin, round(r.lo + b.range * (r.hi - r.lo) / 20, 6) AS lo,
       round(r.lo + (b.range + 1) * (r.hi - r.lo) / 20, 6) AS hi, coalesce(c.n, 0) AS n
FROM range(20) b CROSS JOIN r LEFT JOIN c ON c.bin = b.range"""


@q("histogram", HIST_SQL)
def histogram(spark, sf):
    h = ch.histogram(lineitem_gaps(spark, sf), "l_extendedprice", bins=20)
    return h.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


@q("boxplot", f"""SELECT {KEY_SQL.format(c='l_returnflag')} AS key, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max
FROM (SELECT l_returnflag, coalesce(l_quantity, 0.0) AS v FROM {LI_GAPS_SQL}) GROUP BY 1""")
def boxplot(spark, sf):
    b = ch.boxplot(lineitem_gaps(spark, sf), "l_returnflag", "l_quantity")
    return b.select("key", *[r6(F.col(c)).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@q("scatter_points", f"SELECT coalesce(l_quantity, 0.0) AS x, coalesce(l_extendedprice, 0.0) AS y FROM {LI_GAPS_SQL}")
def scatter_points(spark, sf):
    return ch.scatter_points(lineitem_gaps(spark, sf), "l_quantity", "l_extendedprice")


@q("line_series", """SELECT row_number() OVER (ORDER BY o_orderdate, coalesce(o_totalprice, 0.0)) - 1 AS pos,
  o_orderdate AS x, coalesce(o_totalprice, 0.0) AS y FROM orders""")
def line_series(spark, sf):
    return ch.line_series(T(spark, sf, "orders"), "o_orderdate", "o_totalprice")


PIXELS = 200


@q("line_pixels", f"""WITH p AS (SELECT o_orderdate AS x, epoch_us(o_orderdate)::DOUBLE AS o, coalesce(o_totalprice, 0.0) AS y FROM orders WHERE o_orderdate IS NOT NULL),
e AS (SELECT min(o) AS lo, max(o) AS hi FROM p),
c AS (SELECT p.x, p.y, CASE WHEN hi = lo THEN 0 ELSE least(floor((o - lo) / (hi - lo) * {PIXELS}), {PIXELS - 1}) END::BIGINT AS pixel FROM p, e),
r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY x, y) AS a, row_number() OVER (PARTITION BY pixel ORDER BY x DESC, y DESC) AS b,
             row_number() OVER (PARTITION BY pixel ORDER BY y, x) AS c, row_number() OVER (PARTITION BY pixel ORDER BY y DESC, x) AS d FROM c)
SELECT DISTINCT pixel, x, y FROM r WHERE 1 IN (a, b, c, d)""")
def line_pixels(spark, sf):
    return ch.line_pixels(T(spark, sf, "orders"), "o_orderdate", "o_totalprice", PIXELS)


TILE_LEVELS = 5


@q("scatter_tiles", f"""WITH p AS (SELECT coalesce(l_quantity, 0.0) AS x, coalesce(l_extendedprice, 0.0) AS y FROM {LI_GAPS_SQL}),
e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
c AS (SELECT least(floor((x - x0) / (x1 - x0) * {1 << TILE_LEVELS}), {(1 << TILE_LEVELS) - 1})::BIGINT AS ix,
             least(floor((y - y0) / (y1 - y0) * {1 << TILE_LEVELS}), {(1 << TILE_LEVELS) - 1})::BIGINT AS iy FROM p, e)
SELECT l::INTEGER AS level, ix >> ({TILE_LEVELS} - l) AS ix, iy >> ({TILE_LEVELS} - l) AS iy, count(*) AS n
FROM c, range({TILE_LEVELS + 1}) AS t(l) GROUP BY ALL""")
def scatter_tiles(spark, sf):
    return ch.scatter_tiles(lineitem_gaps(spark, sf), "l_quantity", "l_extendedprice", TILE_LEVELS)


@q("histogram_width_bins", f"""WITH v AS (SELECT coalesce(l_extendedprice, 0.0) AS v FROM {LI_GAPS_SQL}),
q AS (SELECT min(v) AS lo, max(v) AS hi, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(count(*), 1 / 3.0) AS w FROM v),
k AS (SELECT *, greatest(1, ceil((hi - lo) / w))::BIGINT AS k FROM q),
c AS (SELECT least(floor((v - lo) / (hi - lo) * k)::BIGINT, k - 1) AS bin, count(*) AS n FROM v, k GROUP BY 1)
SELECT b.bin, round(lo + b.bin * (hi - lo) / k, 6) AS lo, round(lo + (b.bin + 1) * (hi - lo) / k, 6) AS hi, coalesce(c.n, 0) AS n
FROM (SELECT lo, hi, k, unnest(range(k)) AS bin FROM k) b LEFT JOIN c ON c.bin = b.bin""")
def histogram_width_bins(spark, sf):
    h = ch.histogram_width_bins(lineitem_gaps(spark, sf), "l_extendedprice")
    return h.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


@q("histogram_equal_depth", f"""WITH v AS (SELECT coalesce(l_extendedprice, 0.0) AS v FROM {LI_GAPS_SQL}),
e AS (SELECT list_sort(list_distinct(quantile_cont(v, [i / 12.0 FOR i IN range(13)]))) AS e FROM v),
b AS (SELECT unnest(range(len(e) - 1)) AS bin, e FROM e),
c AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT b.bin::BIGINT AS bin, round(e[b.bin + 1], 6) AS lo, round(e[b.bin + 2], 6) AS hi, coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON c.bin = b.bin""")
def histogram_equal_depth(spark, sf):
    h = ch.histogram_equal_depth(lineitem_gaps(spark, sf), "l_extendedprice", 12)
    return h.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


@q("column_summary", _vote_sql(EV_GAPS_SQL, EV_COLS, True))
def column_summary(spark, sf):
    s = ch.column_summary(events_gaps(spark, sf))
    return s.select("column", "role", r6(F.col("share")).alias("share"), "position")


# ---------------------------------------------------------------- 2.F ordering

@q("sort_asc", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_asc(spark, sf):
    return so.sort_asc(T(spark, sf, "orders"), ["o_orderdate", "o_orderkey"])


@q("sort_desc", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC")
def sort_desc(spark, sf):
    return so.sort_desc(T(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])


@q("top_k", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def top_k(spark, sf):
    return so.top_k(T(spark, sf, "orders"), ["o_totalprice"], 30, tie_cols=["o_orderkey"])


# ---------------------------------------------------------------- 2.G scalar functions

SCALAR_SQL = """SELECT p_partkey,
  trim('  ' || p_name || '  ') AS trimmed,
  replace(replace(replace(replace(replace(' ' || p_type || '-x/y (z)', ' ', '_'), '-', '_'), '/', '_'), '(', ''), ')', '') AS replaced,
  regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_digits,
  lower(p_brand) AS brand_lower,
  contains(lower(p_name), 'id') AS has_id,
  CAST(len(list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_names,
  array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS names,
  lower(string_split(p_name || '.Data.CSV', '.')[-1]) AS ext,
  coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_size END, 0) AS size_or_zero,
  (CASE WHEN p_size > 40 THEN NULL ELSE p_size END) IS NULL AS size_missing,
  isnan(p_retailprice) AS price_nan,
  CAST(p_size AS VARCHAR) AS size_text,
  CAST(p_size AS DOUBLE) AS size_double,
  CAST(floor(p_retailprice) AS INTEGER) AS price_int,
  round(abs(p_retailprice - 1000.0), 6) AS price_dev,
  round(sqrt(p_size), 6) AS size_sqrt,
  round(power(p_size, 2), 6) AS size_sq,
  CAST(floor(p_retailprice / 7) AS BIGINT) AS price_floor
FROM part"""


@q("scalar_functions", SCALAR_SQL)
def scalar_functions(spark, sf):
    p = T(spark, sf, "part")
    rep = F.concat(F.lit(" "), F.col("p_type"), F.lit("-x/y (z)"))
    for old, new in ((" ", "_"), ("-", "_"), ("/", "_"), ("(", ""), (")", "")):
        rep = F.replace(rep, F.lit(old), F.lit(new))
    lst = split_list(F.concat(F.col("p_name"), F.lit(", ,"), F.col("p_type")))
    size_n = F.when(F.col("p_size") > 40, F.lit(None)).otherwise(F.col("p_size"))
    return p.select(
        "p_partkey",
        F.trim(F.concat(F.lit("  "), F.col("p_name"), F.lit("  "))).alias("trimmed"),
        rep.alias("replaced"),
        F.regexp_replace("p_brand", "[^0-9]", "").alias("brand_digits"),
        F.lower("p_brand").alias("brand_lower"),
        F.lower("p_name").contains("id").alias("has_id"),
        F.size(lst).alias("n_names"),
        F.array_join(lst, "|").alias("names"),
        file_extension(F.concat(F.col("p_name"), F.lit(".Data.CSV"))).alias("ext"),
        F.coalesce(size_n, F.lit(0)).alias("size_or_zero"),
        size_n.isNull().alias("size_missing"),
        F.isnan("p_retailprice").alias("price_nan"),
        F.col("p_size").cast("string").alias("size_text"),
        F.col("p_size").cast("double").alias("size_double"),
        F.floor("p_retailprice").cast("int").alias("price_int"),
        r6(F.abs(F.col("p_retailprice") - 1000.0)).alias("price_dev"),
        r6(F.sqrt("p_size")).alias("size_sqrt"),
        r6(F.pow("p_size", 2)).alias("size_sq"),
        F.floor(F.col("p_retailprice") / 7).alias("price_floor"))
