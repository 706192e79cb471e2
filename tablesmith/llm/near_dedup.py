"""Near-dedup by Order MinHash.

A text's symbols are its five-word shingles, each labelled with how often it has occurred
so far. A sketch takes the `RETAINED` labelled shingles with the smallest hashes and keeps
them in text order, so equal sketches need the same shingles in the same order: they
follow the edit similarity, not only the common set. Texts that share one of `SKETCHES`
sketches are candidates. Verification aligns the shingle sequences inside the band of
shifts that the threshold allows; similarity is aligned shingles / (all - aligned), 0.8 or
more links two texts, and linked texts form classes.

Equal word sequences are one class member (combined before any shuffle). At first a
bucket's members are paired with its smallest member only, by an aggregation and a join of
rows without text; buckets of two and of three neighbouring sketches split each bucket
again, each with a smallest member of its own. Each text is verified against the candidate
with which it shares most buckets, then all other candidates that are still in another
class. That leaves most buckets with one class.

Texts of the other, open buckets are compared exactly by their rarest shingles. Shingles
are ordered by how many open texts hold them, rarest first. Two texts of n and m shingles
can only be linked if they share t / (1 + t) (n + m) of them, so a shingle they share must
stand early enough in both orders. What a family of texts has in common stands last, so
members below the threshold meet only where they share something of their own. Each
shingle's texts are first paired with the one most like all others (largest mean logarithm
of its shingles' counts), in rounds, until that links nothing more; that joins what is near
the middle of a family. Then all pairs of different classes that share an early shingle are
verified, the texts of a shingle's largest class on one side only. No link between open
texts is lost, and no group is collected.

Defined results: a text of one to four words is one shingle; texts without words (NULL,
empty) are equal to each other; the smallest doc_id (NULL first) of a class stays, of rows
that repeat doc_id and text one; an empty table gives an empty result. Columns other than
the two named are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import discard, keyed, stored
from tablesmith.llm.repeats import U, Rolled, mix, texts, word_values

SHINGLE = 5
THRESHOLD = 0.8
RETAINED = 3
SKETCHES = 16
DEPTH = 3
_draw = np.random.default_rng(8128)
FLIP = _draw.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
FACTOR = _draw.integers(0, 1 << 62, SKETCHES, dtype=np.uint64) * U(2) + U(1)
LABEL = U(0xD1B54A32D192ED03)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the occurrence-labelled k-word shingles, in text order; all different."""
    if not len(words):
        return np.zeros(0, U)
    h = Rolled(words).every(min(k, len(words)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    if first.all():
        return mix(h)
    at = np.arange(len(s))
    label = np.empty(len(s), U)
    label[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(U)
    return mix(h + label * LABEL)


def sketches(x: np.ndarray) -> np.ndarray:
    """One 64-bit key for each sketch of labelled shingles x."""
    keep = min(RETAINED, len(x))
    out = np.empty((SKETCHES, keep), U)
    for i in range(SKETCHES):
        h = (x ^ FLIP[i]) * FACTOR[i]
        at = np.argpartition(h, keep - 1)[:keep] if keep < len(x) else np.arange(keep)
        out[i] = x[np.sort(at)]
    key = np.zeros(SKETCHES, U)
    for j in range(keep):
        key = mix(key * LABEL + out[:, j])
    return key


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences of different symbols, along shifts of at most `band`."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if not n:
        return head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        return head + tail + len(j)
    ends: list[int] = []  # smallest last place of a common subsequence of each length
    for p in j.tolist():
        at = bisect_left(ends, p)
        if at == len(ends):
            ends.append(p)
        else:
            ends[at] = p
    return head + tail + len(ends)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned shingles / (all - aligned); exact from `threshold` up, never above the truth below it."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    band = int(total * (1 - threshold) / (1 + threshold)) + 1  # most unaligned shingles of a linked pair
    both = aligned(a, b, band)
    return both / (total - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c1, c2, n, keys = [], [], [], []
        for t in texts(b):
            w = word_values(t)
            whole = Rolled(w)
            all_words = whole.stretch(np.array([0]), np.array([len(w)]))[0]
            c1.append(all_words)
            c2.append(mix(w * LABEL + np.arange(len(w), dtype=U)).sum(dtype=U) + U(len(w)))
            x = shingles(w)
            n.append(len(x))
            keys.append(sketches(x).view(np.int64) if len(x) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"), "th": b.column("th"), "c1": pa.array(np.array(c1, U).view(np.int64)),
            "c2": pa.array(np.array(c2, U).view(np.int64)), "n": pa.array(n, pa.int32()), "keys": pa.array(keys, pa.list_(pa.int64()))})


def _linkable() -> Column:
    return F.least("n", "pn") >= F.greatest("n", "pn") * THRESHOLD


def shared_buckets(members: DataFrame, made: list[str]) -> DataFrame:
    """(x, n, depth, bucket): the buckets of texts that share a sketch, by a sketch (depth 0) or several."""
    # a text alone with a sketch is alone in that sketch's narrower buckets too
    tops = F.transform("keys", lambda k, i: F.xxhash64(i, k))
    has = members.where(F.size("keys") > 0).select("x", "n", "keys", F.posexplode(tops).alias("i", "top"))
    shared = has.select("top").groupBy("top").agg(F.count("*").alias("size")).where("size > 1").select("top")
    narrow = F.transform(F.sequence(F.lit(1), F.lit(DEPTH)),
                         lambda depth: F.xxhash64(depth, "i", F.slice(F.concat("keys", "keys"), F.col("i") + 1, depth)))
    rows = has.select("x", "n", "top", narrow.alias("buckets")).join(stored(shared, "near-shared", made), "top", "left_semi")
    return stored(rows.select("x", "n", F.posexplode("buckets").alias("depth", "bucket")), "near-buckets", made)


def candidates(rows: DataFrame) -> DataFrame:
    """(x, p, c): texts and the smallest of a bucket they share, c buckets, lengths that can be linked."""
    first = rows.groupBy("bucket").agg(F.min(F.struct("x", "n")).alias("f"), F.count("*").alias("size")).where("size > 1")
    pairs = rows.join(first.select("bucket", F.col("f.x").alias("p"), F.col("f.n").alias("pn")), "bucket")
    pairs = pairs.where((F.col("x") != F.col("p")) & _linkable())
    return pairs.groupBy("x", "p").agg(F.count("*").alias("c"))


def open_texts(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(xid, x): members of the buckets of one sketch that hold several classes."""
    rows = rows.where("depth = 0").join(roots, "x", "left").select("bucket", "x", F.coalesce("root", "x").alias("root"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("bucket")
    return rows.join(several, "bucket", "left_semi").select("x").distinct().withColumn("xid", F.monotonically_increasing_id())


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingles(word_values(t)) for t in texts(b)]
        sizes = np.array([len(x) for x in found], np.int64)
        at = pa.array(np.repeat(np.arange(len(found)), sizes))
        symbols = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"xid": b.column("xid").take(at), "n": pa.array(np.repeat(sizes, sizes), pa.int32()), "symbol": pa.array(symbols)})


def early_symbols(open_rows: DataFrame, involved: DataFrame, threshold: float) -> DataFrame:
    """(xid, n, middle, symbol, i): each open text's rarest shingles that another one holds, i the place in the order.

    A text of n shingles needs the first n - ceil(threshold n) + 1 of its order, for partners of any length.
    """
    rows = open_rows.join(involved, "x").select("xid", "text").mapInArrow(_symbols, "xid long, n int, symbol long")
    counts = rows.groupBy("symbol").agg(F.count("*").alias("c")).where("c > 1")
    own = rows.join(counts, "symbol").groupBy("xid", "n").agg(F.sort_array(F.collect_list(F.struct("c", "symbol"))).alias("s"))
    alone = (F.col("n") - F.size("s")).alias("alone")  # shingles of this text only come first
    middle = F.aggregate("s", F.lit(0.0), lambda a, s: a + F.log2(s["c"].cast("double"))) / F.col("n")
    early = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1
    own = own.select("xid", "n", "s", alone, middle.alias("middle"), early.alias("early")).where("early > alone")
    own = own.select("xid", "n", "middle", "alone", F.posexplode(F.slice("s", F.lit(1), F.col("early") - F.col("alone"))).alias("k", "s"))
    return own.select("xid", "n", "middle", F.col("s.symbol").alias("symbol"), (F.col("alone") + F.col("k")).alias("i"))


def _meet(threshold: float, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether texts of n and m shingles that share the i-th and the j-th of their orders can share enough."""
    needed = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    return (F.least(n - i, m - j) >= needed) & (F.least(n, m) >= F.greatest(n, m) * threshold)


def middle_pairs(early: DataFrame, threshold: float) -> DataFrame:
    """(a, b): texts and the text of another class that stands in the middle of a shingle's texts. `early` has each text's root."""
    best = early.groupBy("symbol").agg(F.max(F.struct("middle", "xid", "n", "i", "root")).alias("p"),
                                       F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    pairs = early.join(best.select("symbol", "p"), "symbol").where(
        (F.col("root") != F.col("p.root")) & _meet(threshold, F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i")))
    return pairs.select(F.col("xid").alias("a"), F.col("p.xid").alias("b")).distinct()


def all_pairs(early: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of texts of different classes that can be linked by their early shingles."""
    held = early.groupBy("symbol", "root").agg(F.count("*").alias("c"))
    largest = held.groupBy("symbol").agg(F.max(F.struct("c", "root")).alias("l"), F.count("*").alias("k")).where("k > 1")
    few = early.join(largest.select("symbol", F.col("l.root").alias("largest")), "symbol").where("root != largest")
    few = few.select("symbol", F.col("xid").alias("a"), F.col("n").alias("an"), F.col("i").alias("ai"), F.col("root").alias("a_root"))
    pairs = few.join(early, "symbol").where((F.col("a_root") != F.col("root")) & _meet(
        threshold, F.col("an"), F.col("ai"), F.col("n"), F.col("i")))
    return pairs.select(F.greatest("a", "xid").alias("a"), F.least("a", "xid").alias("b")).distinct()


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_p = None, None
        for b in batches:
            ok = []
            for tx, tp in zip(texts(b, "text_x"), texts(b, "text_p")):
                if tp != last:
                    last, last_p = tp, shingles(word_values(tp))
                ok.append(similarity(shingles(word_values(tx)), last_p, threshold) >= threshold)
            yield b.select(["x", "p"]).filter(pa.array(ok, pa.bool_()))
    return run


def verified(pairs: DataFrame, involved: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, p) whose texts are similar."""
    x = involved.select("x", F.col("text").alias("text_x"))
    p = involved.select(F.col("x").alias("p"), F.col("text").alias("text_p"))
    kind = pairs.select("x", "p").schema
    return pairs.select("x", "p").join(x, "x").join(p, "p").select("x", "p", "text_x", "text_p").mapInArrow(_verify(threshold), kind)


def classes(links: DataFrame, made: list[str]) -> DataFrame:
    """(x, root): each linked node and the smallest of its class, by alternating stars."""
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())

    edges = stored(links.select(F.greatest("x", "p").alias("u"), F.least("x", "p").alias("v")).where("u != v").distinct(), "near-edges", made)
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                              F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.where("u != v").distinct(), "near-edges", made)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("x"), F.col("v").alias("root"))


def joined(roots: DataFrame, more: DataFrame, made: list[str]) -> DataFrame:
    """The classes after more links (x, p)."""
    return classes(roots.select("x", F.col("root").alias("p")).unionByName(more), made)


def link_open(open_rows: DataFrame, involved: DataFrame, roots: DataFrame, threshold: float, made: list[str]) -> DataFrame:
    """The classes after every two open texts that can be linked are verified or in one class."""
    if open_rows.isEmpty():
        return roots
    early = stored(early_symbols(open_rows, involved, threshold), "near-early", made)

    def labelled() -> DataFrame:
        names = open_rows.join(roots, "x", "left").select("xid", F.coalesce("root", "x").alias("root"))
        return stored(early.join(names, "xid"), "near-labelled", made)

    def links(pairs: DataFrame) -> DataFrame:
        x, p = open_rows.withColumnRenamed("xid", "a"), open_rows.select(F.col("x").alias("p"), F.col("xid").alias("b"))
        named = stored(pairs.join(x, "a").join(p, "b").select("x", "p"), "near-pairs", made)
        return stored(verified(named, involved, threshold), "near-links", made)

    now = labelled()
    while not (found := links(middle_pairs(now, threshold))).isEmpty():
        roots = joined(roots, found, made)
        now = labelled()
    found = links(all_pairs(now, threshold))
    return roots if found.isEmpty() else joined(roots, found, made)


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, th, class_id (doc_id of the class's smallest), class_size, kept."""
    base, made = keyed(docs, text, doc_id), []
    members = stored(base.mapInArrow(_sketch, "doc_id long, th long, c1 long, c2 long, n int, keys array<long>"), "near-sketches", made)
    x = F.struct("doc_id", "th")
    reps = members.groupBy("c1", "c2").agg(F.min(x).alias("x"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    rows = shared_buckets(reps, made)
    pairs = stored(candidates(rows), "near-pairs", made)
    nodes = rows.select("x").distinct()
    nodes = nodes.select(F.col("x.doc_id").alias("d"), F.col("x.th").alias("h"))
    nodes = nodes.hint("merge")  # grows with the input: never broadcast
    involved = base.join(nodes, base["doc_id"].eqNullSafe(F.col("d")) & (base["th"] == F.col("h")), "left_semi")
    involved = stored(involved.dropDuplicates(["doc_id", "th"]).select(x.alias("x"), "text"), "near-texts", made)
    best = pairs.groupBy("x").agg(F.max_by("p", F.struct("c", F.xxhash64("p"))).alias("p"))
    roots = classes(stored(verified(best, involved, threshold), "near-links", made), made)
    rest = pairs.join(best, ["x", "p"], "left_anti")
    rx, rp = roots.select("x", F.col("root").alias("rx")), roots.select(F.col("x").alias("p"), F.col("root").alias("rp"))
    rest = rest.join(rx, "x", "left").join(rp, "p", "left").where(
        F.coalesce("rx", "x") != F.coalesce("rp", "p")).select("x", "p")
    roots = joined(roots, stored(verified(rest, involved, threshold), "near-links", made), made)
    open_rows = stored(open_texts(rows, roots), "near-open", made)
    roots = link_open(open_rows, involved, roots, threshold, made)
    reps = reps.select("c1", "c2", "x").join(roots, "x", "left").select("c1", "c2", F.coalesce("root", "x").alias("root"))
    out = members.groupBy("doc_id", "th", "c1", "c2").agg(F.count("*").alias("m")).join(reps, ["c1", "c2"])
    out = stored(out.select("doc_id", "th", "m", "root"), "near-classes")
    discard(docs.sparkSession, made)
    sizes = out.groupBy("root").agg(F.sum("m").alias("class_size"))
    out = out.join(sizes, "root").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return out.select("doc_id", "th", F.col("root.doc_id").alias("class_id"), "class_size",
                      (x.eqNullSafe(F.col("root")) & (F.col("copy") == 1)).alias("kept"))
