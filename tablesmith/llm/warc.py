"""WARC fixity audit with Merkle trees.

Pages are written as WARC records, ordered within files by page; each record has an
offset range. The leaves of a file's tree are the records' SHA-256 and ranges; a node
hashes its range and the hashes of up to `fanout` children in order. Each replica's manifest
comes from its own records: their order, lengths and offsets. Two replicas are compared by
their roots; where those differ, only the children of nodes that differ are compared, level
by level, down to the records, in both directions. Records found there are then aligned by
page: one that stands at another place is `moved`, one whose bytes differ is `changed`, one
that only one replica has is `missing` or `added`. `order` names a column with the records'
order in their file; without it the order is that of the page ids.

Nodes are made by grouping at most `fanout` rows, so no task gathers a file. The leaves
(a hash and three numbers for each record) are stored once, so bodies are read once for
each replica.

Defined results: a NULL url or html counts as empty; records without a page_id, and those of
a page_id that more than `per_file` rows share, go to files of their own, spread by content; rows that repeat a page_id stand beside each other in the order
of their hashes, and are aligned one by one in that order; an empty table
gives an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import stored

PER_FILE = 1000
FANOUT = 10
# fixed values: the record header of the WARC format
HEAD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "
LENGTH = "\r\nContent-Length: "
BODY = "\r\n\r\n"


def record(url: Column, html: Column) -> Column:
    """The bytes of one record, as text."""
    u, h = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(F.lit(HEAD), u, F.lit(LENGTH), F.octet_length(h).cast("string"), F.lit(BODY), h, F.lit(BODY))


def leaves(pages: DataFrame, per_file: int = PER_FILE, order: str | None = None) -> DataFrame:
    """(file, seq, page_id, start, stop, hash): the manifest, one row per record."""
    r = record(F.col("url"), F.col("html"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(r, 256).alias("hash"), F.octet_length(r).cast("long").alias("len"),
                     (F.col(order) if order else F.lit(None)).cast("long").alias("place"))
    crowded = p.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > per_file).select(F.col("page_id").alias("crowded"))
    p = p.join(crowded, F.col("page_id") == F.col("crowded"), "left")
    spread = -1 - F.pmod(F.xxhash64("hash"), F.lit(1 << 20))
    own = F.when(F.col("crowded").isNull(), F.floor(F.col("page_id") / per_file))
    p = p.withColumn("file", F.coalesce(own, spread).cast("long"))
    by = Window.partitionBy("file").orderBy("place", "page_id", "hash")
    p = p.withColumn("seq", (F.row_number().over(by) - 1).cast("long"))
    p = p.withColumn("stop", F.sum("len").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return p.select("file", "seq", "page_id", (F.col("stop") - F.col("len")).alias("start"), "stop", "hash")


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The level above (file, seq, start, stop, hash)."""
    up = nodes.groupBy("file", F.floor(F.col("seq") / fanout).cast("long").alias("seq")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "hash"))).alias("below"),
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    text = F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string"), F.array_join("below.hash", ","))
    return up.select("file", "seq", "start", "stop", F.sha2(text, 256).alias("hash"))


def tree(manifest: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels 0 (records) to `levels` (roots)."""
    out = [manifest.select("file", "seq", "start", "stop", "hash")]
    for _ in range(levels):
        out.append(parents(out[-1], fanout))
    return out


def depth(manifest: DataFrame, fanout: int = FANOUT, least: int = 1) -> int:
    """Levels above the records that end in one root for each file."""
    most = manifest.agg(F.max("seq")).first()[0] or 0
    levels = 0
    while fanout ** levels <= most:
        levels += 1
    return max(levels, least)


def audit(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, seq, start, stop): the records of `a` whose hash `b` lacks, found from the roots down."""
    def differing(level: int, of: DataFrame) -> DataFrame:
        other = b[level].select("file", "seq", F.col("hash").alias("other"))
        d = of.join(other, ["file", "seq"], "left")
        return d.where(~F.col("hash").eqNullSafe(F.col("other"))).drop("other")

    wrong = differing(len(a) - 1, a[-1])
    for level in range(len(a) - 2, -1, -1):
        up = wrong.select("file", F.col("seq").alias("up"))
        below = a[level].withColumn("up", F.floor(F.col("seq") / fanout).cast("long"))
        wrong = differing(level, below.join(up, ["file", "up"], "left_semi").drop("up"))
    return wrong.select("file", "seq", "start", "stop")


def damaged(pages: DataFrame, every: int = 53) -> DataFrame:
    """A replica with faults at pages chosen by a hash of their id: one letter replaced, or half lost."""
    pick = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % every
    half = F.floor(F.length("html") / 2).cast("int")
    html = F.when((pick == 0) & (half > 0), F.concat(F.substr("html", F.lit(1), half - 1), F.lit("\u0001"),
                                                     F.substr("html", half + 1, F.length("html"))))
    html = html.when(pick == 1, F.substr("html", F.lit(1), half)).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"))


def differences(m: DataFrame, r: DataFrame, fanout: int = FANOUT, least_levels: int = 3) -> tuple[DataFrame, list[DataFrame]]:
    """(file, page_id, nth, seq, other_seq, status) of the records in which two stored manifests differ, and the first one's tree.

    A record that one replica does not have has no seq there.
    """
    levels = max(depth(m, fanout, least_levels), depth(r, fanout, least_levels))
    a, b = tree(m, levels, fanout), tree(r, levels, fanout)
    order = Window.partitionBy("file", "page_id", "hash").orderBy("seq")

    def found(x: list[DataFrame], y: list[DataFrame], manifest: DataFrame) -> DataFrame:
        d = audit(x, y, fanout).select("file", "seq").join(manifest.select("file", "seq", "page_id", "hash"), ["file", "seq"])
        return stored(d.withColumn("nth", F.row_number().over(order)), "audit-side")

    here, there = found(a, b, m), found(b, a, r)
    same = F.expr("h.file = t.file and h.page_id <=> t.page_id and h.hash = t.hash and h.nth = t.nth")
    pairs = here.alias("h").join(there.alias("t"), same, "full").select(
        F.coalesce("h.file", "t.file").alias("file"), F.expr("if(h.file is null, t.page_id, h.page_id)").alias("page_id"),
        F.col("h.seq").alias("seq"), F.col("t.seq").alias("other_seq"))
    moved = pairs.where("seq is not null and other_seq is not null").withColumn("nth", F.lit(None).cast("int")).withColumn("status", F.lit("moved"))
    # what is left has other bytes: the first of a page with the first of the same page, and so on
    nth = Window.partitionBy("file", "page_id").orderBy(F.coalesce("seq", "other_seq"))
    one = pairs.where("other_seq is null").withColumn("nth", F.row_number().over(nth))
    two = pairs.where("seq is null").withColumn("nth", F.row_number().over(nth))
    left = one.alias("h").join(two.alias("t"), F.expr("h.file = t.file and h.page_id <=> t.page_id and h.nth = t.nth"), "full").select(
        F.coalesce("h.file", "t.file").alias("file"), F.expr("if(h.file is null, t.page_id, h.page_id)").alias("page_id"),
        F.col("h.seq").alias("seq"), F.col("t.other_seq").alias("other_seq"), F.coalesce("h.nth", "t.nth").alias("nth"))
    status = F.when(F.col("seq").isNull(), "added").when(F.col("other_seq").isNull(), "missing").otherwise("changed")
    return moved.unionByName(left.withColumn("status", status)), a


def fixity_audit(pages: DataFrame, replica: DataFrame, per_file: int = PER_FILE, least_levels: int = 3, order: str | None = None,
                 extra: bool = False) -> DataFrame:
    """One row per record: page_id, warc_file, seq, rec_start, rec_stop, record_sha256, file_root, intact, status.

    With `extra` also a row, without place and hash, for each record that only the replica has.
    """
    m, r = stored(leaves(pages, per_file, order), "manifest"), stored(leaves(replica, per_file, order), "replica")
    found, a = differences(m, r, least_levels=least_levels)
    found = stored(found, "audit-differences")
    bad = found.where("seq is not null").select("file", "seq", "status")
    roots = a[-1].select("file", F.col("hash").alias("file_root"))
    out = m.join(bad, ["file", "seq"], "left").join(roots, "file").select(
        "page_id", F.col("file").alias("warc_file"), "seq", F.col("start").alias("rec_start"),
        F.col("stop").alias("rec_stop"), F.col("hash").alias("record_sha256"), "file_root",
        F.col("status").isNull().alias("intact"), F.coalesce("status", F.lit("intact")).alias("status"))
    if extra:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("seq", "long"), ("rec_start", "long"), ("rec_stop", "long"), ("record_sha256", "string"), ("file_root", "string"))]
        more = found.where("status = 'added'").select("page_id", F.col("file").alias("warc_file"), *none, F.lit(False).alias("intact"), "status")
        out = out.unionByName(more)
    return out
