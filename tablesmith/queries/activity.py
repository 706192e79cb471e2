"""Registered queries: activity records (2.K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import activity as ac
from tablesmith.queries.common import T
from tablesmith.session import scratch_path
from tablesmith.sources import activity_log as al
from tablesmith.streaming.recent import read_recent_activity, stream_recent_activity

QUERIES: dict = {}
ORACLE: dict = {}


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


USER = 7


@q("recent_activity_user", f"SELECT * FROM events WHERE user_id = {USER} ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_activity_user(spark, sf):
    return ac.recent_activity_user(T(spark, sf, "events"), USER)


@q("recent_activity_all", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_activity_all(spark, sf):
    return ac.recent_activity_all(T(spark, sf, "events"))


@q("recent_activity_per_user", """SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events)
WHERE rank <= 30""")
def recent_activity_per_user(spark, sf):
    return ac.recent_activity_per_user(T(spark, sf, "events"))


@q("recent_activity_streamed", ORACLE["recent_activity_per_user"])
def recent_activity_streamed(spark, sf):
    """The same rows from three micro-batches, with a restart before the last."""
    ev = T(spark, sf, "events")
    land, sink, ckpt = (scratch_path(spark, n) for n in ("recent-land", "recent", "recent-ckpt"))
    for k in range(3):
        ev.where(F.pmod("event_id", F.lit(3)) == k).write.parquet(f"{land}/part{k}")
        if k:
            stream_recent_activity(spark, f"{land}/*", sink, ckpt, schema=ev.schema).awaitTermination()
    return read_recent_activity(spark, sink, ev.schema)


@q("owner_listing", f"SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM orders "
   f"WHERE o_custkey = {USER} ORDER BY o_orderdate DESC, o_orderkey DESC")
def owner_listing(spark, sf):
    return ac.owner_listing(T(spark, sf, "orders"), USER,
                            ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"],
                            owner="o_custkey", ts="o_orderdate", tie="o_orderkey")


@q("count_where", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def count_where(spark, sf):
    return ac.count_where(T(spark, sf, "events"), F.col("event_type") == "error")


@q("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem "
   "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return ac.duplicate_keys(T(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@q("purge_owner", """SELECT 'orders' AS "table", count(*) AS rows_left FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'AUTOMOBILE' AND c.c_custkey = o.o_custkey)
UNION ALL
SELECT 'customer', count(*) FROM customer c0
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'AUTOMOBILE' AND c.c_custkey = c0.c_custkey)
UNION ALL
SELECT 'events', count(*) FROM events WHERE user_id NOT IN (3, 5, 8) OR user_id IS NULL""")
def purge_owner(spark, sf):
    cust, orders, events = T(spark, sf, "customer"), T(spark, sf, "orders"), T(spark, sf, "events")
    ids = cust.filter(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey")
    left = ac.purge_owner({"orders": (orders, "o_custkey"), "customer": (cust, "c_custkey")}, ids)
    left.update(ac.purge_owner({"events": (events, "user_id")}, [3, 5, 8]))
    parts = [df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table"), "rows_left")
             for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@q("purge_log", """SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day FROM events
WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 40 = 0 AND user_id IS NOT NULL)""")
def purge_log(spark, sf):
    """The log without some owners, only the files that hold them written anew; read again after their deletion."""
    path = scratch_path(spark, "purge-log")
    ev = T(spark, sf, "events")
    for k in range(2):
        al.append_batch(ev.filter(F.pmod("event_id", F.lit(2)) == k), path, f"load-{k}")
    al.purge_log(spark, path, "user_id", ev.where("event_type = 'error' AND event_id % 40 = 0").select("user_id"))
    al.vacuum_log(spark, path)
    return al.read_log(spark, path).select(*ev.columns, "day")
