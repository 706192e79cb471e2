from pyspark.sql import functions as F

from tablesmith.operators import activity as ac
from tablesmith.session import scratch_path
from tablesmith.sources import files as fs
from tablesmith.sources import sinks as sk
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_user_limit_runs_before_shuffle(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    plan = _plan(ac.recent_activity_per_user(ev, 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_user_filter_pushed_to_scan(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert "EqualTo(user_id,7)" in _plan(ac.recent_activity_user(ev, 7))


def test_purge_keeps_null_owners(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "u int")
    left = ac.purge_owner({"t": (df, "u")}, [1])["t"]
    assert sorted([r["u"] for r in left.collect()], key=lambda v: (v is None, v)) == [2, None]
    ids = spark.createDataFrame([(2,)], "id int")
    left = ac.purge_owner({"t": (df, "u")}, ids)["t"]
    assert left.count() == 2


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    assert [tuple(r) for r in ac.duplicate_keys(df, ["a", "b"]).collect()] == [(1, 1, 2)]


def test_csv_round_trip_and_extension_filter(spark):
    base = scratch_path(spark, "csvtest")
    cust = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    sk.write_csv(cust, f"{base}/a")
    cust.write.mode("overwrite").json(f"{base}/b")
    got = fs.scan_csv_dir(spark, base)
    assert got.count() == cust.count()
    assert fs.scan_csv(spark, f"{base}/a", schema=cust.schema).schema == cust.schema


def test_activity_log_append_partitions_by_day(spark):
    path = scratch_path(spark, "logtest")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    sk.append_activity_log(ev.limit(10), path, files_per_day=None)
    sk.append_activity_log(ev.limit(10), path)
    back = spark.read.parquet(path)
    assert back.count() == 20 and "day" in back.columns


def test_activity_log_files_per_day(spark):
    import glob
    path = scratch_path(spark, "logfiles")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    sk.append_activity_log(ev, path, files_per_day=2)
    days = glob.glob(f"{path.removeprefix('file:')}/day=*")
    assert days and all(len(glob.glob(f"{d}/*.parquet")) <= 2 for d in days)
    assert spark.read.parquet(path).count() == ev.count()


def test_json_records_blank_for_null(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sk.json_records(df).first()["json"] == '{"a":"1","b":""}'


def test_stream_appends_each_file_once(spark):
    from tablesmith.streaming import stream_activity_log
    land, sink, ckpt = (scratch_path(spark, n) for n in ("land", "sink", "ckpt"))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.filter(F.col("event_id") % 2 == 0).write.parquet(f"{land}/b1")
    q = stream_activity_log(spark, land + "/*", sink, ckpt, schema=ev.schema)
    q.awaitTermination(120)
    ev.filter(F.col("event_id") % 2 == 1).write.parquet(f"{land}/b2")
    q = stream_activity_log(spark, land + "/*", sink, ckpt, schema=ev.schema)
    q.awaitTermination(120)
    back = spark.read.parquet(sink)
    assert back.count() == ev.count() and back.select("event_id").distinct().count() == ev.count()


def test_projection_reaches_scan_and_top_n_is_take_ordered(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    plan = _plan(q["select_column"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan
    plan = _plan(q["bar_topn"](spark, SF_SMALL))
    assert "TakeOrderedAndProject(limit=10" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double>" in plan


def test_purge_list_filter_reaches_scan(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    plan = _plan(ac.purge_owner({"e": (ev, "user_id")}, [3, 5])["e"])
    assert "PushedFilters: [Or(IsNull(user_id),Not(In(user_id, [3,5])))]" in plan


def _rows(df):
    return sorted(map(str, df.collect()))


def test_batches_count_once(spark):
    """A batch sent twice, and one whose first write died half-way, are read back once."""
    import glob
    from tablesmith.sources import activity_log as al
    path = scratch_path(spark, "batchlog")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    a, b = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    assert al.append_batch(a, path, "a", files_per_day=2) and not al.append_batch(a, path, "a")
    # a write of b that died before its commit
    b.limit(5).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{path}/data/load=b-dead")
    assert _rows(al.read_log(spark, path).drop("day")) == _rows(a)
    assert al.append_batch(b, path, "b")
    assert _rows(al.read_log(spark, path).drop("day")) == _rows(ev)
    for day in glob.glob(f"{path.removeprefix('file:')}/data/load=a-*/day=*"):
        assert len(glob.glob(f"{day}/*.parquet")) <= 2
    one = al.read_log(spark, path).where("day = date'1995-01-01'")
    assert "PartitionFilters" in _plan(one)
    assert al.append_batch(ev.limit(0), path, "nothing") and al.read_log(spark, path).count() == ev.count()


def test_compaction_keeps_the_rows_and_covers_batches(spark):
    import glob
    from tablesmith.sources import activity_log as al
    path = scratch_path(spark, "compactlog")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for k in range(4):
        al.append_batch(ev.where(F.col("event_id") % 4 == k), path, f"b{k}")
    assert al.compact_log(spark, path) and al.compact_log(spark, path) is None
    assert len(al.commits(spark, path)) == 1 and not al.append_batch(ev, path, "b2")
    assert _rows(al.read_log(spark, path).drop("day")) == _rows(ev)
    assert al.vacuum_log(spark, path) == 8  # four loads, four commits
    assert not al.append_batch(ev, path, "b1") and _rows(al.read_log(spark, path).drop("day")) == _rows(ev)
    root = path.removeprefix("file:")
    assert len(glob.glob(f"{root}/data/*")) == 1
    assert all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in glob.glob(f"{root}/data/*/day=*"))


def test_a_log_needs_a_committed_batch_and_a_plain_id(spark):
    import pytest
    from tablesmith.sources import activity_log as al
    path = scratch_path(spark, "nolog")
    with pytest.raises(ValueError):
        al.read_log(spark, path)
    for bad in ("", "../x", ".hidden", "a/b"):
        with pytest.raises((ValueError, IndexError)):
            al.append_batch(spark.range(1).select(F.current_timestamp().alias("ts")), path, bad)


def test_stream_batches_are_idempotent(spark):
    from tablesmith.sources import activity_log as al
    from tablesmith.streaming.activity import stream_activity_batches
    land, log, ckpt = (scratch_path(spark, n) for n in ("land", "log", "ckpt"))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.filter(F.col("event_id") % 2 == 0).write.parquet(f"{land}/b1")
    stream_activity_batches(spark, land + "/*", log, ckpt, schema=ev.schema).awaitTermination(120)
    ev.filter(F.col("event_id") % 2 == 1).write.parquet(f"{land}/b2")
    stream_activity_batches(spark, land + "/*", log, ckpt, schema=ev.schema).awaitTermination(120)
    # a restart that has lost its own checkpoint sends the first batch's number again
    stream_activity_batches(spark, land + "/b1", log, scratch_path(spark, "ckpt"), schema=ev.schema).awaitTermination(120)
    assert _rows(al.read_log(spark, log).drop("day")) == _rows(ev)


def test_purge_writes_only_touched_files(spark):
    import glob
    import os
    from tablesmith.sources import activity_log as al
    path = scratch_path(spark, "purgelog")
    root = path.removeprefix("file:")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")))
    # each load holds its own range of owners
    edges = [r[0] for r in ev.select(F.percentile_approx("user_id", [0.25, 0.5, 0.75]).alias("p")).select(F.explode("p")).collect()]
    part = sum(((F.coalesce("user_id", F.lit(-1)) > e).cast("int") for e in edges), F.lit(0))
    for k in range(4):
        al.append_batch(ev.where(part == k), path, f"b{k}")
    ids = ev.where(part == 2).select("user_id").distinct().orderBy("user_id").limit(2)
    gone = [r[0] for r in ids.collect()]
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/data/load=b*/day=*/*.parquet")}
    before = files()
    touched = al.purge_log(spark, path, "user_id", ids)
    assert touched and all(f.startswith("load=b2-") for f in touched)
    assert files() == before  # nothing is written in place
    want = ev.where(~F.coalesce(F.col("user_id").isin(gone), F.lit(False)))
    assert _rows(al.read_log(spark, path).drop("day")) == _rows(want)
    assert al.purge_log(spark, path, "user_id", ids) == []
    assert al.purge_log(spark, path, "user_id", spark.createDataFrame([(None,)], "id long")) == []
    al.vacuum_log(spark, path)
    left = files()
    assert {f: before[f] for f in left} == left and len(before) - len(left) == len(touched)
    assert _rows(al.read_log(spark, path).drop("day")) == _rows(want)
    al.compact_log(spark, path)
    assert _rows(al.read_log(spark, path).drop("day")) == _rows(want)


def test_streamed_recent_activity_equals_the_batch_query(spark):
    """Three micro-batches, the third after a restart from the checkpoint."""
    from tablesmith.streaming.recent import read_recent_activity, stream_recent_activity
    land, sink, ckpt = (scratch_path(spark, n) for n in ("land", "recent", "ckpt"))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 5))
    ev = ev.withColumn("ts", F.when(F.col("event_id") % 31 != 0, F.col("ts")))
    for k in range(2):
        ev.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{land}/b{k}")
    stream_recent_activity(spark, land + "/*", sink, ckpt, schema=ev.schema, k=6, max_files=1).awaitTermination(300)
    ev.where(F.col("event_id") % 3 == 2).coalesce(1).write.parquet(f"{land}/b2")
    stream_recent_activity(spark, land + "/*", sink, ckpt, schema=ev.schema, k=6, max_files=1).awaitTermination(300)
    got = read_recent_activity(spark, sink, ev.schema)
    assert _rows(got.select(*ev.columns, F.col("rank").cast("int"))) == _rows(ac.recent_activity_per_user(ev, 6))


def test_of_two_rewrites_that_met_the_first_counts():
    from tablesmith.sources.activity_log import _live
    def commit(batch, made, **more):
        return {"batch": batch, "load": f"{batch}-x", "covers": None, "replaces": None, "touches": None, "removes": None, "made": made, **more}
    a, b = commit("a", 1), commit("b", 2)
    names = lambda *rows: [c["batch"] for c in _live(list(rows))]
    c1, c2 = commit("compact-1", 3, replaces=["a", "b"]), commit("compact-2", 3, replaces=["a", "b"])
    assert names(a, b, c1, c2) == ["compact-1"]
    p1, p2 = commit("purge-1", 3, touches=["a"], removes=["f1"]), commit("purge-2", 3, touches=["a"], removes=["f1", "f2"])
    assert names(a, b, p1, p2) == ["a", "b", "purge-1"]
    assert names(a, b, p1, commit("purge-3", 4, touches=["a"], removes=["f3"])) == ["a", "b", "purge-1", "purge-3"]
    assert names(a, b, p1, commit("compact-3", 4, replaces=["a", "b"])) == ["a", "b", "purge-1"]  # it has not seen the purge
    assert names(a, b, p1, commit("compact-4", 4, replaces=["a", "b", "purge-1"])) == ["compact-4"]
    assert names(a, b, c1, commit("purge-4", 4, touches=["a"], removes=["f1"])) == ["compact-1"]
    assert names(c1) == ["compact-1"]  # what it replaced has been vacuumed
    assert names(a, b, c1, commit("late", 3)) == ["compact-1", "late"]
