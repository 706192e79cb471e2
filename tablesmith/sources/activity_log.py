"""An append-only activity log whose batches count once, however often they are written.

    <path>/data/load=<name>/day=<date>/...   files of one attempt to write one batch
    <path>/commits/<batch>.json              which attempt of the batch counts

A batch is written to a folder of its own first, and counts from the moment its commit file
is there: it names the folder, so an attempt that died half-way, or a second one, is never
read. A batch whose commit file exists is not written again. Compaction writes the rows of
all live batches anew, clustered by day and hash bucket, as one more load, whose commit
file names the batches it covers; readers take it in their place.

Rows of some owners are removed by writing anew only the files that hold them: an index of
each load (smallest and largest owner and a bitmap of hashed owners for each file) rules most
files out, a read of the owner column alone finds the files that do hold one, and one commit
adds the rows they keep and names them as removed. All other files stay as they are.

Writers may meet: of two compactions or purges that read the same batches the first counts,
and the other one raises. Any file system that Spark writes to will do; commit files appear by rename. One commit
row for each live batch comes to the driver, which `compact_log` keeps few.
"""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import qcol

LOAD = "load"
BITS = 32_768


class _Folder:
    """Small files of the log by Hadoop's file system, the one Spark itself writes with."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def write(self, name: str, text: str) -> None:
        """The whole file appears at once."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._at(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self._at(part), self._at(name)):
            self.fs.delete(self._at(part), False)  # another attempt was first

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _file(batch_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id) or batch_id[0] in "._":
        raise ValueError(f"batch id {batch_id!r}: letters, digits, '-', '_' and '.' only, a letter or digit first")
    return f"commits/{batch_id}.json"


COMMIT = ("batch string, load string, covers array<string>, replaces array<string>, touches array<string>, "
          "removes array<string>, schema string, made long")


def _live(rows: list[dict]) -> list[dict]:
    """The commits that count, in order.

    A compaction or purge counts only if what it read was still so when it was committed: the
    batches it replaces or takes files from, the files it removes, and, for a compaction, all
    purges of the batches it replaces. Of two that met, the first counts. Commits that are
    gone (`vacuum_log`) are not asked for.
    """
    known, live, removed = {r["batch"] for r in rows}, {}, set()
    for r in sorted(rows, key=lambda r: (r["made"], r["batch"])):
        replaces, touches, removes = (set(r[k] or []) for k in ("replaces", "touches", "removes"))
        unseen = {b for b, c in live.items() if set(c["touches"] or []) & replaces} - replaces
        if any(b in known and b not in live for b in replaces | touches) or removes & removed or unseen:
            continue
        for b in replaces:
            live.pop(b, None)
        removed |= removes
        live[r["batch"]] = r
    return list(live.values())


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits that count."""
    folder = _Folder(spark, path)
    if not any(n.endswith(".json") for n in folder.names("commits")):
        return []
    rows = spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(f"{folder.path}/commits").where("load is not null").collect()
    return _live([r.asDict() for r in rows])


def _write(df: DataFrame, path: str, batch_id: str, files_per_day: int, **more) -> None:
    spark = df.sparkSession
    folder = _Folder(spark, path)
    load = f"{batch_id}-{uuid.uuid4().hex[:12]}"
    bucket = F.pmod(F.xxhash64(*[qcol(c) for c in df.columns]), F.lit(int(files_per_day)))
    # each day's rows meet in files_per_day tasks, and each of them writes one file of that day
    out = df.repartition(F.col("day"), bucket)
    out.write.partitionBy("day").parquet(f"{folder.path}/data/{LOAD}={load}")
    made = max([c["made"] for c in commits(spark, path)], default=0) + 1
    folder.write(_file(batch_id), json.dumps({"batch": batch_id, "load": load, "schema": df.schema.json(), "made": made, **more}))
    if more and batch_id not in {c["batch"] for c in commits(spark, path)}:
        raise RuntimeError(f"{batch_id} met another compaction or purge of the same batches, which was first; run it again")


def append_batch(df: DataFrame, path: str, batch_id: str, ts: str = "ts", files_per_day: int = 1) -> bool:
    """Append the batch unless it is there already; whether it was written now.

    Rows are clustered by day: `files_per_day` files a day at most. A row without a time goes
    to the day NULL.
    """
    if files_per_day < 1:
        raise ValueError("files_per_day must be >= 1")
    spark = df.sparkSession
    folder = _Folder(spark, path)
    if folder.exists(_file(batch_id)) or any(batch_id in (c["covers"] or []) for c in commits(spark, path)):
        return False
    _write(df.withColumn("day", F.to_date(qcol(ts))), path, batch_id, files_per_day)
    return True


def _read(spark: SparkSession, path: str, live: list[dict], files: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(live[-1]["schema"]))
    base = f"{path.rstrip('/')}/data"
    with_load = T.StructType([*schema.fields, T.StructField(LOAD, T.StringType())])
    reader = spark.read.schema(with_load).option("basePath", base)
    df = reader.parquet(*[f"{base}/{LOAD}={c['load']}" for c in live])
    removed = {f for c in live for f in c["removes"] or []}
    if files is None and removed:
        files = [f for f in map(_relative, df.inputFiles()) if f not in removed]
    if files is not None:
        df = reader.parquet(*[f"{base}/{f}" for f in files]) if files else df.limit(0)
    return df.select(*[qcol(c) for c in schema.names])


def _relative(file: str) -> str:
    """The file's place below data/, as the file system has it."""
    return unquote(file[file.index(f"/data/{LOAD}=") + len("/data/"):])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the committed batches, once each; filters on `day` skip the other days' folders."""
    live = commits(spark, path)
    if not live:
        raise ValueError(f"no committed batch below {path}")
    return _read(spark, path, live)


def _index(spark: SparkSession, path: str, live: list[dict], owner: str) -> DataFrame:
    """(file, least, most, bits) of the owners in each live file; made once for each load."""
    folder = _Folder(spark, path)
    tag = re.sub(r"[^A-Za-z0-9]", "_", owner)
    for c in live:
        at = f"index/{tag}/{c['load']}"
        if not folder.exists(f"{at}/_SUCCESS"):
            only = [{**c, "removes": []}]
            key = qcol(owner)
            place = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
            rows = _read(spark, path, only).where(key.isNotNull()).groupBy(F.input_file_name().alias("file")).agg(
                F.min(key).alias("least"), F.max(key).alias("most"), F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
            rows.write.mode("overwrite").parquet(f"{folder.path}/{at}")
    return spark.read.parquet(*[f"{folder.path}/index/{tag}/{c['load']}" for c in live])


def purge_log(spark: SparkSession, path: str, owner: str, ids: DataFrame, files_per_day: int = 1) -> list[str]:
    """Remove every row whose `owner` is in the one-column table `ids`; the files that were written anew, below data/.

    Rows without an owner stay. The removed rows' files are deleted by `vacuum_log`.
    """
    live = commits(spark, path)
    if not live:
        raise ValueError(f"no committed batch below {path}")
    wanted = ids.select(qcol(ids.columns[0]).alias("id")).where("id is not null").distinct()
    place = F.pmod(F.xxhash64("id"), F.lit(BITS)) + 1
    one = wanted.agg(F.min("id").alias("least"), F.max("id").alias("most"), F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).first()
    if one.least is None:
        return []
    index = _index(spark, path, live, owner).where((F.col("least") <= F.lit(one.most)) & (F.col("most") >= F.lit(one.least)))
    both = index.select("file", "bits").unionByName(index.select("file", F.lit(bytes(one.bits)).alias("bits")))
    removed = {f for c in live for f in c["removes"] or []}
    maybe = both.groupBy("file").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).where("n > 0").select("file")
    maybe = [f for f in (_relative(r.file) for r in maybe.collect()) if f not in removed]
    if not maybe:
        return []
    held = _read(spark, path, live, maybe).select(qcol(owner).alias("id"), F.input_file_name().alias("file"))
    touched = sorted(_relative(r.file) for r in held.join(wanted, "id", "left_semi").select("file").distinct().collect())
    if not touched:
        return []
    rows = _read(spark, path, live, touched)
    kept = rows.join(wanted, qcol(owner) == F.col("id"), "left_anti")
    loads = {f.split("/")[0].removeprefix(f"{LOAD}=") for f in touched}
    _write(kept, path, f"purge-{uuid.uuid4().hex[:12]}", files_per_day, removes=touched,
           touches=[c["batch"] for c in live if c["load"] in loads])
    return touched


def compact_log(spark: SparkSession, path: str, files_per_day: int = 1) -> str | None:
    """Write all live batches as one load of `files_per_day` files a day; the new batch's id (None for fewer than two batches)."""
    live = commits(spark, path)
    if len(live) < 2:
        return None
    batch_id = f"compact-{uuid.uuid4().hex[:12]}"
    covers = [b for c in live for b in [c["batch"], *(c["covers"] or [])]]
    _write(read_log(spark, path), path, batch_id, files_per_day, covers=covers, replaces=[c["batch"] for c in live])
    return batch_id


def vacuum_log(spark: SparkSession, path: str) -> int:
    """Delete folders that no live commit names, commits that a compaction covers and removed files; call it while nobody writes or reads."""
    folder, live = _Folder(spark, path), commits(spark, path)
    keep = {f"{LOAD}={c['load']}" for c in live}
    gone = [f"data/{n}" for n in folder.names("data") if n.startswith(f"{LOAD}=") and n not in keep]
    names = {f"{c['batch']}.json" for c in live}
    gone += [f"commits/{n}" for n in folder.names("commits") if n not in names]
    gone += [f"data/{f}" for c in live for f in c["removes"] or [] if folder.exists(f"data/{f}")]
    for name in gone:
        folder.delete(name)
    return len(gone)
