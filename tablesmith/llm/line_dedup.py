"""Line dedup: content-defined chunks of lines, then windows around what they leave, removed after byte comparison.

A passage of `min_lines` lines or more that stands earlier (smallest doc_id, then text hash,
then line) goes, whatever stands around it; nothing but its first place stays. That is found
in two steps:

1. Chunks. A document's lines are hashed; a rolling hash over the last two line hashes ends
   a chunk where it divides by `spread`. A passage that two documents share is therefore cut
   alike in both. Chunks of at least `min_lines` lines that hold a word and occur more than
   once are removed everywhere but at their first place.
2. Edges. What a repeated passage has outside whole chunks, and passages that hold none, are
   found by windows of `min_lines` consecutive lines that hold a word. Windows inside a
   removed chunk are left out: the chunk's first place has them too, and earlier.

Chunks and windows are told apart by bytes: chunks are grouped by their bytes once, with
copies combined before the shuffle, and windows whose 128-bit key repeats are grouped by
their bytes; a key of two texts removes nothing. Hot passages meet in joins of rows without
text, which Spark can split, and nowhere else.

All steps are DataFrame expressions. Defined results: a NULL text counts as empty; rows
that repeat doc_id and text are one document and get the same result; a NULL doc_id comes
first; passages without a word stay; where windows of one first place overlap (a line
repeated in a row), lines of it can go as part of a later window; an empty table gives an
empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, keyed, stored

SPREAD = 3
MIN_LINES = 2
FACTOR = 31


def _chunks(d: DataFrame, spread: int, min_lines: int) -> DataFrame:
    """(doc_id, th, start, n, t): the chunks long enough to be removed."""
    d = d.withColumn("ls", F.split("text", "\n", -1)).drop("text")
    d = d.withColumn("h", F.transform("ls", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
    last = F.size("ls") - 1
    cut = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (
        (F.coalesce(F.get("h", i - 1), F.lit(0)) * FACTOR + F.get("h", i)) % spread == 0))
    d = d.withColumn("cut", cut).drop("h")
    runs = F.transform("cut", lambda e, j: F.struct((F.coalesce(F.get("cut", j - 1), F.lit(-1)) + 1).alias("start"),
                                                    (e - F.coalesce(F.get("cut", j - 1), F.lit(-1))).alias("n")))
    d = d.withColumn("runs", F.filter(runs, lambda r: r["n"] >= min_lines)).drop("cut")
    with_text = F.transform("runs", lambda r: F.struct(
        r["start"].alias("start"), r["n"].alias("n"), F.array_join(F.slice("ls", r["start"] + 1, r["n"]), "\n").alias("t")))
    d = d.select("doc_id", "th", F.explode(with_text).alias("c")).select("doc_id", "th", "c.*")
    d = d.where(F.col("t").rlike(WORD))
    return d.withColumn("k1", F.xxhash64("t")).withColumn("k2", F.xxhash64(F.lit(FACTOR), "t"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The result rows; gone: doc_id, th, and the stretches (start, n) to remove, none of which overlap."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("_t"), *keep)
    d = whole.join(gone, _same(whole, gone), "left").select(whole["doc_id"], "_t", "gone", *keep)
    d = d.withColumn("ls", F.split("_t", "\n", -1))
    # stretches between removed chunks, the end of the text standing as a chunk of no lines
    stops = F.sort_array(F.concat(F.coalesce("gone", F.array().cast("array<struct<start:int,n:int>>")),
                                  F.array(F.struct(F.size("ls").alias("start"), F.lit(0).alias("n")))))
    d = d.withColumn("stops", stops)
    prev = lambda j: F.coalesce(F.get("stops", j - 1)["start"] + F.get("stops", j - 1)["n"], F.lit(0))
    left = F.flatten(F.transform("stops", lambda s, j: F.slice("ls", prev(j) + 1, s["start"] - prev(j))))
    removed = F.aggregate("stops", F.lit(0), lambda a, s: a + s["n"])
    d = d.withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("_t")).otherwise(F.array_join(left, "\n")))
    return d.select("doc_id", F.size("ls").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"),
                    "kept_text", *keep)


def repeated_chunks(base: DataFrame, spread: int = SPREAD, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, th, chunks): start and n of each chunk that stands earlier."""
    chunks = _chunks(base, spread, min_lines)
    place = F.struct("doc_id", "th", "start")
    by_bytes = chunks.groupBy("k1", "k2", "t").agg(F.count("*").alias("c"), F.min(place).alias("first"))
    repeated = by_bytes.groupBy("k1", "k2").agg(
        F.count("*").alias("texts"), F.sum("c").alias("c"), F.min("first").alias("first"))
    repeated = repeated.where((F.col("texts") == 1) & (F.col("c") > 1)).select("k1", "k2", "first")
    gone = chunks.select("k1", "k2", "doc_id", "th", "start", "n").join(repeated, ["k1", "k2"])
    return gone.where(~place.eqNullSafe(F.col("first"))).groupBy("doc_id", "th").agg(
        F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"))).alias("chunks"))


def _windows(base: DataFrame, min_lines: int) -> DataFrame:
    """(doc_id, th, windows): start and key of every window of min_lines lines that holds a word."""
    d = base.withColumn("ls", F.split("text", "\n", -1)).drop("text")
    d = d.withColumn("a", F.transform("ls", lambda x: F.xxhash64(x))).withColumn(
        "b", F.transform("ls", lambda x: F.xxhash64(F.lit(FACTOR), x)))
    d = d.withColumn("w", F.transform("ls", lambda x: x.rlike(WORD))).drop("ls")
    starts = F.when(F.size("a") >= min_lines, F.sequence(F.lit(0), F.size("a") - min_lines)).otherwise(
        F.array().cast("array<int>"))
    starts = F.filter(starts, lambda i: F.array_contains(F.slice("w", i + 1, min_lines), True))
    keys = F.transform(starts, lambda i: F.struct(i.alias("start"), F.xxhash64(F.slice("a", i + 1, min_lines)).alias("k1"),
                                                  F.xxhash64(F.slice("b", i + 1, min_lines)).alias("k2")))
    return d.select("doc_id", "th", keys.alias("windows"))  # no filter on it: that would repeat all of the above


def _inside(i: Column, chunks: Column, min_lines: int) -> Column:
    return F.exists(chunks, lambda c: (c["start"] <= i) & (i + min_lines <= c["start"] + c["n"]))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD,
               min_lines: int = MIN_LINES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text, and `keep`."""
    base = keyed(docs, text, doc_id)
    place = F.struct("doc_id", "th", "start")
    chunks = stored(repeated_chunks(base, spread, min_lines), "line-chunks")
    mine = chunks.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "chunks")
    # a row that repeats doc_id and text is the same document
    rows = _windows(base, min_lines).dropDuplicates(["doc_id", "th"])
    rows = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    left = F.when(F.col("chunks").isNull(), F.col("windows")).otherwise(
        F.filter("windows", lambda w: ~_inside(w["start"], F.col("chunks"), min_lines)))
    windows = stored(rows.select("doc_id", "th", F.explode(left).alias("w")).select("doc_id", "th", "w.*"), "line-windows")
    repeated = windows.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").drop("c")
    found = windows.join(repeated, ["k1", "k2"])
    found = stored(found.select("doc_id", "th", "start", "k1", "k2", (~place.eqNullSafe(F.col("first"))).alias("later")), "line-repeats")
    at = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "k1", "k2")).alias("at"))
    at = base.join(at.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "h"),
                   base["doc_id"].eqNullSafe(F.col("d")) & (base["th"] == F.col("h")))
    at = at.withColumn("ls", F.split("text", "\n", -1))
    at = at.select(F.explode(F.transform("at", lambda w: F.struct(
        w["k1"].alias("k1"), w["k2"].alias("k2"), F.array_join(F.slice("ls", w["start"] + 1, min_lines), "\n").alias("t")))).alias("w"))
    texts = at.select("w.*").groupBy("k1", "k2", "t").agg(F.lit(1).alias("one"))
    mixed = texts.groupBy("k1", "k2").agg(F.count("*").alias("texts")).where("texts > 1")
    edges = found.where("later").join(mixed, ["k1", "k2"], "left_anti").select(
        "doc_id", "th", F.array(F.struct("start", F.lit(min_lines).alias("n"))).alias("chunks"))
    gone = chunks.unionByName(edges).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("chunks")).alias("parts"))
    lines = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1))))
    gone = gone.select("doc_id", "th", F.transform(lines, lambda i: F.struct(i.alias("start"), F.lit(1).alias("n"))).alias("gone"))
    return _without(docs, gone, doc_id, text, keep)
