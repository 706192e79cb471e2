"""Registered queries: sources/sinks (2.A), schema (2.B), filters (2.C), profile (2.D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.numbers import NUMBER_PATTERN, js_number
from tablesmith.operators import filters as fl
from tablesmith.operators import profile as pr
from tablesmith.operators import schema as sc
from tablesmith.operators.corr import corr_matrix, corr_pairs, corr_with_target
from tablesmith.queries.common import (EV_GAPS_SQL, LI_COLS, LI_GAPS_SQL, LI_NULLS_SQL, LI_NUMERIC,
                                       PART_DROPS_COLS, PART_DROPS_SQL, T, corr_sql,
                                       lineitem_gaps, lineitem_nulls, part_drops, profile_sql, r6, union_all)
from tablesmith.session import scratch_path
from tablesmith.sources import activity_log as al
from tablesmith.sources import csv_checked as cc
from tablesmith.sources import files as fs
from tablesmith.sources import sinks as sk

QUERIES: dict = {}
ORACLE: dict = {}


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


CUSTOMER_CSV_SQL = ("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, "
                    "c_acctbal, c_mktsegment FROM customer")

CUSTOMER_COLS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

# ---------------------------------------------------------------- 2.A sources / sinks


@q("scan_csv", CUSTOMER_CSV_SQL)
def scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    sk.write_csv(T(spark, sf, "customer"), path)
    return fs.scan_csv(spark, path)


@q("scan_csv_filter_ext", CUSTOMER_CSV_SQL)
def scan_csv_filter_ext(spark, sf):
    base = scratch_path(spark, "csvdir")
    cust = T(spark, sf, "customer")
    sk.write_csv(cust, f"{base}/upload")
    cust.write.mode("overwrite").json(f"{base}/other")  # not .csv: must be ignored
    return fs.scan_csv_dir(spark, base)


def _broken_csv(spark, sf):
    """The customers as CSV, and beside them a file of lines without all fields."""
    path = scratch_path(spark, "csvbroken")
    cust = T(spark, sf, "customer")
    sk.write_csv(cust, path)
    lines = cust.where("c_custkey % 20 = 0").select(F.concat_ws(",", "c_custkey", "c_name").alias("value"))
    header = spark.createDataFrame([(",".join(cust.columns),)], "value string")
    for k in range(2):  # each file starts with the header
        part = lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == k)
        header.unionByName(part).coalesce(1).write.mode("append").text(path)
    return cc.scan_csv_checked(spark, path)


@q("scan_csv_checked", CUSTOMER_CSV_SQL)
def scan_csv_checked(spark, sf):
    return _broken_csv(spark, sf).rows


@q("scan_csv_broken", "SELECT c_custkey || ',' || c_name AS line FROM customer WHERE c_custkey % 20 = 0")
def scan_csv_broken(spark, sf):
    return _broken_csv(spark, sf).broken


@q("scan_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 2000")
def scan_sample(spark, sf):
    return fs.scan_sample(T(spark, sf, "orders"), 2000, ["o_orderkey"])


@q("sink_json_records", "SELECT " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in CUSTOMER_COLS) + " FROM customer")
def sink_json_records(spark, sf):
    path = scratch_path(spark, "json")
    sk.write_json_records(T(spark, sf, "customer"), path)
    return spark.read.schema(", ".join(f"{c} string" for c in CUSTOMER_COLS)).json(path)


@q("sink_activity_log",
   "SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day FROM events")
def sink_activity_log(spark, sf):
    path = scratch_path(spark, "activity")
    ev = T(spark, sf, "events")
    # two loads, the first sent twice; together they are the whole table, rows without a time included
    first_half = F.coalesce(F.dayofmonth("ts") <= 15, F.lit(False))
    for batch, rows in (("first", first_half), ("first", first_half), ("second", ~first_half)):
        al.append_batch(ev.filter(rows), path, batch)
    return al.read_log(spark, path).select("event_id", "ts", "user_id", "event_type", "value", "props", "day")


@q("compact_activity_log",
   "SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day FROM events")
def compact_activity_log(spark, sf):
    path = scratch_path(spark, "activity")
    ev = T(spark, sf, "events")
    for k in range(3):
        al.append_batch(ev.filter(F.pmod("event_id", F.lit(3)) == k), path, f"load-{k}", files_per_day=2)
    al.compact_log(spark, path)
    al.append_batch(ev.filter(F.pmod("event_id", F.lit(3)) == 0), path, "load-0")  # covered: not written again
    return al.read_log(spark, path).select("event_id", "ts", "user_id", "event_type", "value", "props", "day")


# ---------------------------------------------------------------- 2.B schema

MESSY = [("p_partkey", " p partkey"), ("p_name", "p-name"), ("p_brand", "p/brand"),
         ("p_type", "p type (kind)"), ("p_size", "a b"), ("p_retailprice", "a_b")]


def _messy_part(spark, sf):
    return T(spark, sf, "part").select(*[F.col(c).alias(m) for c, m in MESSY])


@q("sanitize_columns", "SELECT p_partkey AS p_partkey, p_name AS p_name, p_brand AS p_brand, "
   "p_type AS p_type_kind, p_size AS a_b, p_retailprice AS a_b_2 FROM part")
def sanitize_columns(spark, sf):
    return sc.sanitize_columns(_messy_part(spark, sf))


@q("sanitize_columns_strict", "SELECT p_partkey AS p_partkey, p_name AS pname, p_brand AS pbrand, "
   "p_type AS p_type_kind, p_size AS a_b, p_retailprice AS a_b_2 FROM part")
def sanitize_columns_strict(spark, sf):
    return sc.sanitize_columns(_messy_part(spark, sf), strict=True)


@q("profile_table", profile_sql(LI_NULLS_SQL, LI_COLS))
def profile_table(spark, sf):
    return pr.profile_table(lineitem_nulls(spark, sf))


@q("classify_columns", f"SELECT {', '.join(LI_NUMERIC)} FROM lineitem")
def classify_columns(spark, sf):
    return sc.classify_columns(T(spark, sf, "lineitem"), "numeric")


EV_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
           ("event_type", "string"), ("value", "double"), ("props", "string")]


def _share_sql(c, t):
    if t in ("bigint", "int", "double"):
        return "avg(1.0)"
    return (f"avg(CASE WHEN {c} IS NULL THEN 1.0 WHEN trim(CAST({c} AS VARCHAR)) = '' THEN 1.0 "
            f"WHEN regexp_matches(trim(CAST({c} AS VARCHAR)), '{NUMBER_PATTERN}') THEN 1.0 ELSE 0.0 END)")


def _vote_sql(src, cols, with_share):
    parts = []
    for i, (c, t) in enumerate(cols):
        share = _share_sql(c, t)
        role = f"CASE WHEN {share} >= 0.6 THEN 'numeric' ELSE 'categorical' END AS role"
        extra = f", round({share}, 6) AS share, {i} AS position" if with_share else ""
        parts.append(f"SELECT '{c}' AS \"column\", {role}{extra} FROM {src}")
    return union_all(parts)


@q("infer_numeric_vote", _vote_sql(EV_GAPS_SQL, EV_COLS, False))
def infer_numeric_vote(spark, sf):
    from tablesmith.operators.charts import infer_numeric_vote as vote
    from tablesmith.queries.common import events_gaps
    return vote(events_gaps(spark, sf))


COERCE_SQL = f"""SELECT event_id,
  CASE WHEN trim(replace(replace(props, '{{"k":', ''), '}}', '')) = '' THEN 0.0
       WHEN regexp_matches(trim(replace(replace(props, '{{"k":', ''), '}}', '')), '{NUMBER_PATTERN}')
       THEN TRY_CAST(trim(replace(replace(props, '{{"k":', ''), '}}', '')) AS DOUBLE) END AS props_num,
  CASE WHEN trim(props) = '' THEN 0.0 WHEN regexp_matches(trim(props), '{NUMBER_PATTERN}')
       THEN TRY_CAST(trim(props) AS DOUBLE) END AS props_raw_num,
  CASE WHEN event_type IS NULL THEN 0.0 WHEN trim(event_type) = '' THEN 0.0
       WHEN regexp_matches(trim(event_type), '{NUMBER_PATTERN}') THEN TRY_CAST(trim(event_type) AS DOUBLE) END AS type_num,
  value AS value_num
FROM {EV_GAPS_SQL}"""


@q("coerce_number", COERCE_SQL)
def coerce_number(spark, sf):
    from tablesmith.queries.common import events_gaps
    ev = events_gaps(spark, sf)
    inner = F.replace(F.replace(F.col("props"), F.lit('{"k":'), F.lit("")), F.lit("}"), F.lit(""))
    return ev.select("event_id", js_number(inner).alias("props_num"),
                     js_number(F.col("props")).alias("props_raw_num"),
                     js_number(F.col("event_type")).alias("type_num"),
                     js_number(F.col("value"), ev.schema["value"].dataType).alias("value_num"))


def _to_double_sql(c):
    return f"TRY_CAST(nullif(trim(CAST({c} AS VARCHAR)), '') AS DOUBLE) AS {c}"


@q("cast_numeric", "SELECT " + ", ".join(_to_double_sql(c) if c in LI_NUMERIC else c
                                         for c, _ in LI_COLS) + f" FROM {LI_NULLS_SQL}")
def cast_numeric(spark, sf):
    return sc.cast_numeric(lineitem_nulls(spark, sf))


@q("cast_target", "SELECT p_partkey, p_name, p_brand, p_type, " + _to_double_sql("p_size")
   + ", p_retailprice FROM part")
def cast_target(spark, sf):
    return sc.cast_target(T(spark, sf, "part"), "p_size")


@q("rename_column", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice AS price FROM part")
def rename_column(spark, sf):
    return sc.rename_column(T(spark, sf, "part"), "p_retailprice", "price")


@q("drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
   "l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def drop_columns(spark, sf):
    return sc.drop_columns(T(spark, sf, "lineitem"), ["l_discount", "l_tax"])


@q("select_column", "SELECT l_shipdate FROM lineitem")
def select_column(spark, sf):
    return sc.select_column(T(spark, sf, "lineitem"), "l_shipdate")


# ---------------------------------------------------------------- 2.C filters

@q("filter_not_null", f"SELECT l_orderkey, l_linenumber, l_quantity FROM {LI_NULLS_SQL} WHERE l_quantity IS NOT NULL")
def filter_not_null(spark, sf):
    return fl.filter_not_null(lineitem_nulls(spark, sf), "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@q("filter_null", f"SELECT l_orderkey, l_linenumber, l_quantity FROM {LI_NULLS_SQL} WHERE l_quantity IS NULL")
def filter_null(spark, sf):
    return fl.filter_null(lineitem_nulls(spark, sf), "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@q("dropna_subset", f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM {LI_NULLS_SQL} "
   "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def dropna_subset(spark, sf):
    return fl.dropna_subset(lineitem_nulls(spark, sf), ["l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


FILL_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]


@q("fillna_blank", "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in FILL_COLS)
   + f" FROM {LI_NULLS_SQL}")
def fillna_blank(spark, sf):
    return fl.fillna_blank(lineitem_nulls(spark, sf).select(*FILL_COLS))


@q("filter_numeric_pairs", f"SELECT coalesce(l_quantity, 0.0) AS l_quantity, "
   f"coalesce(l_extendedprice, 0.0) AS l_extendedprice FROM {LI_GAPS_SQL}")
def filter_numeric_pairs(spark, sf):
    return fl.filter_numeric_pairs(lineitem_gaps(spark, sf), "l_quantity", "l_extendedprice")


@q("exclude_id_like", "SELECT ts, event_type, value, props FROM events")
def exclude_id_like(spark, sf):
    return sc.exclude_id_like(T(spark, sf, "events"))


@q("suggest_targets", union_all([
    f"SELECT '{c}' AS \"column\", count({c}) AS nonnull, count(DISTINCT {c}) AS \"distinct\" FROM {LI_NULLS_SQL}"
    for c in LI_NUMERIC]))
def suggest_targets(spark, sf):
    return fl.suggest_targets(lineitem_nulls(spark, sf))


@q("can_train", f"SELECT count(*) AS rows, CAST({len(LI_NUMERIC)} AS BIGINT) AS targets, "
   "count(*) >= 5 AS ok FROM lineitem")
def can_train(spark, sf):
    return fl.can_train(T(spark, sf, "lineitem"))


# ---------------------------------------------------------------- 2.D profile and correlation

@q("row_count", f"SELECT count(*) AS rows, CAST({len(LI_COLS)} AS BIGINT) AS columns FROM lineitem")
def row_count(spark, sf):
    return pr.row_count(T(spark, sf, "lineitem"))


@q("missing_counts", f'SELECT "column", missing FROM ({profile_sql(LI_NULLS_SQL, LI_COLS)})')
def missing_counts(spark, sf):
    return pr.missing_counts(lineitem_nulls(spark, sf))


@q("missing_nonzero", f'SELECT "column", missing FROM ({profile_sql(LI_NULLS_SQL, LI_COLS)}) WHERE missing > 0')
def missing_nonzero(spark, sf):
    return pr.missing_counts(lineitem_nulls(spark, sf), nonzero_only=True)


@q("nonnull_counts", f'SELECT "column", nonnull FROM ({profile_sql(LI_NULLS_SQL, LI_COLS)})')
def nonnull_counts(spark, sf):
    return pr.nonnull_counts(lineitem_nulls(spark, sf))


@q("distinct_counts", union_all([
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) "
    f"AS BIGINT) AS \"distinct\" FROM {LI_NULLS_SQL}" for c, _ in LI_COLS]))
def distinct_counts(spark, sf):
    return pr.distinct_counts(lineitem_nulls(spark, sf))


@q("distinct_added", ORACLE["distinct_counts"])
def distinct_added(spark, sf):
    """The counts of two loads, the second added to the first one's stored state."""
    from tablesmith.operators import distinct as di
    li = lineitem_nulls(spark, sf)
    path = scratch_path(spark, "distinct")
    first = F.pmod("l_orderkey", F.lit(10)) < 9
    di.distinct_state(li.where(first)).write.parquet(path)
    state = di.added(spark.read.schema(di.STATE).parquet(path), li.where(~first))
    out = di.counts(state, li.schema)
    return out.select("column", (F.col("values") + F.col("has_null").cast("int")).alias("distinct"))


@q("drop_empty_constant", f'SELECT "column", reason FROM ({profile_sql(PART_DROPS_SQL, PART_DROPS_COLS)}) '
   "WHERE reason IS NOT NULL")
def drop_empty_constant(spark, sf):
    _, report = pr.drop_empty_constant(part_drops(spark, sf))
    return report


LI_PAIRS = [(LI_NUMERIC[i], LI_NUMERIC[j]) for i in range(len(LI_NUMERIC)) for j in range(i + 1, len(LI_NUMERIC))]


@q("corr_pairs", union_all([f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b, LI_GAPS_SQL)} AS r FROM {LI_GAPS_SQL}"
                            for a, b in LI_PAIRS]))
def q_corr_pairs(spark, sf):
    return corr_pairs(lineitem_gaps(spark, sf), max_cols=12, nulls="zero").select("a", "b", r6(F.col("r")).alias("r"))


@q("corr_with_target", union_all([
    f"SELECT '{a}' AS feature, {corr_sql(a, 'l_extendedprice', LI_GAPS_SQL)} AS r FROM {LI_GAPS_SQL}"
    for a in LI_NUMERIC if a != "l_extendedprice"]))
def q_corr_with_target(spark, sf):
    return corr_with_target(lineitem_gaps(spark, sf), "l_extendedprice", nulls="zero").select(
        "feature", r6(F.col("r")).alias("r"))


def _matrix_sql(nulls):
    parts = []
    for a in LI_NUMERIC:
        for b in LI_NUMERIC:
            if nulls == "zero":
                n = "count(*)"
            else:
                n = f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, CASE WHEN {n} < 2 THEN 0.0 ELSE "
                         f"{corr_sql(a, b, LI_GAPS_SQL, nulls)} END AS r FROM {LI_GAPS_SQL}")
    return union_all(parts)


@q("corr_matrix", _matrix_sql("zero"))
def q_corr_matrix(spark, sf):
    return corr_matrix(lineitem_gaps(spark, sf), LI_NUMERIC, nulls="zero").select("x", "y", r6(F.col("r")).alias("r"))


@q("corr_matrix_pairwise", _matrix_sql("pairwise"))
def q_corr_matrix_pairwise(spark, sf):
    return corr_matrix(lineitem_gaps(spark, sf), LI_NUMERIC, nulls="pairwise").select(
        "x", "y", r6(F.col("r")).alias("r"))


@q("describe", union_all([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 8) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, "
    f"round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {LI_NULLS_SQL})" for c in LI_NUMERIC]))
def q_describe(spark, sf):
    d = pr.describe(lineitem_nulls(spark, sf))
    # a mean of 2-decimal values can end exactly on a 6th-decimal tie: round it at 8
    return d.select("column", "count", F.round("mean", 8).alias("mean"),
                    *[r6(F.col(c)).alias(c) for c in ("std", "min", "q1", "median", "q3", "max")])
