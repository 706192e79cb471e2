"""Substring dedup over words: windows of words as edges of a de Bruijn graph.

A window of `window` words is an edge from its first to its last `window - 1` words. Runs
of windows with one anchor (see repeats) are paths cut out of the documents. Runs of
equal content are one path, whose first place is found by an aggregation; where paths of
different content share an anchor, their edges are compared one by one, and the edges
that occurred before compact again into unbranched paths: stretches of consecutive edges
whose first places are consecutive too. Joins on content hashes carry source places
(document, word) to all other places. What verifies a place is its two hashes, of the
anchor and of the content; both come from one 64-bit rolling hash over 64-bit word values,
and the words at the source are not read again, so two different words of equal value, or
windows of equal hash at one anchor, would be taken for copies.

A word is removed where a window covers it that starts earlier elsewhere: in a smaller
doc_id, or at an earlier word of the document; windows are judged on the input.

Defined results: a NULL text has no words; a NULL doc_id comes before all others; rows
that repeat doc_id and text are one document and get the same result; rows that share a
doc_id but not a text are ordered by text hash; an empty table gives an empty result.
Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import keyed, stored
from tablesmith.llm.repeats import Rolled, _flat, repeated_runs, same_document, texts, word_values

WINDOW = 20
ANCHOR = 8


def _edges(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, paths in zip(texts(b), b.column("paths").to_pylist()):
                e = Rolled(word_values(t)).every(window)
                at = np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in paths])
                mk = np.repeat(np.array([p["mkey"] for p in paths], np.int64), [p["n"] for p in paths])
                found.append((mk, e[at], at))
            yield _flat(b, found, {"mkey": (0, np.int64), "edge": (1, np.int64), "doc_id": (-1, np.int64),
                                   "th": (-1, np.int64), "start": (2, np.int32)})
    return run


def repeated_spans(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, start, n, src_doc, src_start): n windows from word `start` that occur earlier at the source."""
    place = F.struct("doc_id", "th", "start")
    runs = repeated_runs(base, word_values, ANCHOR, window, "word-runs")
    paths = runs.groupBy("mkey", "chash").agg(F.count("*").alias("places"), F.min(place).alias("first"), F.first("n").alias("n"))
    paths = stored(paths, "word-paths")
    # copies of whole paths
    copies = runs.select("mkey", "chash", "doc_id", "th", "start", "n").join(
        paths.where("places > 1").select("mkey", "chash", "first"), ["mkey", "chash"])
    copies = copies.where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "th", "start", "n", F.col("first.doc_id").alias("src_doc"), F.col("first.start").alias("src_start"))
    # paths of different content at one anchor: edge by edge, at their first places
    crossed = stored(paths.groupBy("mkey").agg(F.count("*").alias("c")).where("c > 1").select("mkey"), "word-crossed")
    open_paths = paths.join(crossed, "mkey", "left_semi").select("first.*", "mkey", "n")
    by_doc = open_paths.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "mkey")).alias("paths"))
    d = base.join(by_doc, same_document(base, by_doc)).select(base["doc_id"], base["th"], "text", "paths")
    edges = stored(d.mapInArrow(_edges(window), "mkey long, edge long, doc_id long, th long, start int"), "word-edges")
    firsts = edges.groupBy("mkey", "edge").agg(F.min(place).alias("first"), F.count("*").alias("c"))
    later = edges.join(firsts.where("c > 1").select("mkey", "edge", "first"), ["mkey", "edge"])
    later = later.where(~place.eqNullSafe(F.col("first")))
    # unbranched: the next edge follows in the document and at the source
    line = Window.partitionBy("doc_id", "th", "src", "shift").orderBy("start")
    later = later.select("doc_id", "th", "start", F.struct("first.doc_id", "first.th").alias("src"),
                         (F.col("first.start") - F.col("start")).alias("shift"))
    later = later.withColumn("path", F.col("start") - F.row_number().over(line))
    joined = later.groupBy("doc_id", "th", "src", "shift", "path").agg(F.min("start").alias("start"), F.max("start").alias("stop"))
    joined = joined.select("doc_id", "th", "start", (F.col("stop") - F.col("start") + 1).cast("int").alias("n"),
                           F.col("src.doc_id").alias("src_doc"), (F.col("start") + F.col("shift")).alias("src_start"))
    return copies.unionByName(joined)


def _rebuild(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for t, spans in zip(texts(b), b.column("spans").to_pylist()):
                words = t.split()  # of bytes: at the six white-space characters only
                if spans:
                    depth = np.zeros(len(words) + 1, np.int32)
                    np.add.at(depth, [s["start"] for s in spans], 1)
                    np.add.at(depth, [s["start"] + s["n"] + window - 1 for s in spans], -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    total.append(len(words))
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                    removed.append(total[-1] - len(words))
                else:
                    total.append(len(words))
                    removed.append(0)
                out = b" ".join(words)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256" if digest else "kept_text": pa.array(kept, pa.string())})
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                    digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (with `digest` its SHA-256, kept_sha256)."""
    base = keyed(docs, text, doc_id)
    spans = stored(repeated_spans(base, window), "word-spans")
    spans = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    d = base.join(spans, same_document(base, spans), "left").select(base["doc_id"], "text", "spans")
    last = "kept_sha256" if digest else "kept_text"
    return d.mapInArrow(_rebuild(window, digest), f"doc_id long, n_words long, n_removed long, {last} string")
