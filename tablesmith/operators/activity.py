"""Activity-record operators: recent actions, listings, audits and purges.

They run over any table with an owner column and a timestamp (the `events` table:
user_id, ts, event_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import qcol, require_columns
from tablesmith.session import scratch_path

# How many actions the listings show.
RECENT_PER_USER = 30
RECENT_ALL = 200
# Id sets up to this many rows are broadcast to the purge; larger ones are shuffled.
BROADCAST_ID_LIMIT = 1_000_000


def _newest_first(ts: str, tie: str | None) -> list[Column]:
    order = [qcol(ts).desc()]
    if tie:
        order.append(qcol(tie).desc())
    return order


def recent_activity_user(df: DataFrame, user, k: int = RECENT_PER_USER, owner: str = "user_id",
                         ts: str = "ts", tie: str | None = "event_id") -> DataFrame:
    """Newest k actions of one owner (the filter reaches the parquet scan)."""
    require_columns(df, [owner, ts])
    return df.filter(qcol(owner) == F.lit(user)).orderBy(*_newest_first(ts, tie)).limit(int(k))


def recent_activity_all(df: DataFrame, k: int = RECENT_ALL, ts: str = "ts",
                        tie: str | None = "event_id") -> DataFrame:
    """Newest k actions overall (per-partition top-k, then one small merge)."""
    require_columns(df, [ts])
    return df.orderBy(*_newest_first(ts, tie)).limit(int(k))


def recent_activity_per_user(df: DataFrame, k: int = RECENT_PER_USER, owner: str = "user_id",
                             ts: str = "ts", tie: str | None = "event_id") -> DataFrame:
    """Newest k actions of every owner at once, with their rank (1 = newest).

    `row_number() <= k` lets Spark insert a partial WindowGroupLimit before the shuffle:
    each map task forwards at most k rows per owner, so an owner holding a third of all
    rows does not land whole in one reducer.
    """
    require_columns(df, [owner, ts])
    w = Window.partitionBy(qcol(owner)).orderBy(*_newest_first(ts, tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(k))


def owner_listing(df: DataFrame, user, cols: list[str] | None = None, owner: str = "user_id",
                  ts: str = "ts", tie: str | None = "event_id") -> DataFrame:
    """One owner's rows, newest first, projected to `cols`."""
    require_columns(df, [owner, ts])
    out = df.filter(qcol(owner) == F.lit(user)).orderBy(*_newest_first(ts, tie))
    return out.select(*[qcol(c) for c in cols]) if cols else out


def count_where(df: DataFrame, predicate: Column | str) -> DataFrame:
    """(n): rows matching the predicate, as a one-row DataFrame."""
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.agg(F.count_if(pred).alias("n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) for every key combination that occurs more than once.
    Partial aggregation runs before the shuffle, so a hot key costs one row per task."""
    require_columns(df, keys)
    return df.groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")) \
             .filter(F.col("n") > 1)


def purge_owner(tables: dict[str, tuple[DataFrame, str]], ids) -> dict[str, DataFrame]:
    """Remove every row whose owner is in `ids` from several tables.

    ids: a Python list (becomes an IN filter pushed to the scan) or a one-column
    DataFrame (left anti join; broadcast only after its size is checked).
    """
    out = {}
    if isinstance(ids, DataFrame):
        id_col = ids.columns[0]
        path = scratch_path(ids.sparkSession, "purge-ids")  # written once, read by the count and by every table
        ids.select(qcol(id_col).alias("__id")).distinct().write.parquet(path)
        small = ids.sparkSession.read.parquet(path)
        n = small.count()
        side = F.broadcast(small) if n <= BROADCAST_ID_LIMIT else small
        for name, (df, owner) in tables.items():
            require_columns(df, [owner])
            out[name] = df.join(side, qcol(owner) == F.col("__id"), "left_anti")
        return out
    values = list(ids)
    for name, (df, owner) in tables.items():
        require_columns(df, [owner])
        # rows without an owner stay; the NOT IN part is pushed to the scan
        out[name] = df.filter(qcol(owner).isNull() | ~qcol(owner).isin(values))
    return out
