"""Suffix-array dedup over bytes: sorted suffix runs merged with their common prefixes.

Byte windows of `window` bytes that may repeat are found by their anchors (see repeats).
Runs of equal content repeat as a whole. Where runs of different content share an anchor,
each is cut into parts: windows whose distance from start to anchor lies in one of `PARTS`
ranges. All windows of a part hold its core, the bytes from the last of their starts to the
first of their ends, so equal windows have equal cores and a part whose core occurs once is
dropped; a short passage in many surroundings thus falls apart. Parts of equal cores form a
group. The suffixes that start at a group's anchors are sorted: each task sorts its own, sends them
front-coded (length of the prefix shared with the one before, and the rest) to the task
of the group, and there a loser tree merges the sorted runs. The tree knows for each
run how long a prefix it shares with the last suffix given out, so known prefixes are
never compared again, and it gives the common prefix of neighbours with the order. Of a
group of suffixes, two share a window at offset o before the anchor if they agree on
window - o bytes from it and on o bytes before it: neighbours in suffix order, and in the
order of what stands before, fall into classes at each of the lengths where these change.

Bytes covered by a window that also starts anywhere else are removed, judged on the input.

Defined results: a NULL text counts as empty; rows that repeat doc_id and text are two
documents, and remove each other's windows; a NULL doc_id is a document like others; an
empty table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import keyed, stored
from tablesmith.llm.repeats import U, Rolled, _flat, byte_values, mix, repeated_runs, same_document, texts

WINDOW = 400
ANCHOR = 32
HEAD = struct.Struct("<HHHqqi?")
RUN_BYTES = 32 << 20
PARTS = 8
GROUP_ROWS = 4096


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are known to agree."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 16:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while a[low] == b[low]:
        low += 1
    return low


def front_code(items: list[tuple[bytes, bytes, int, int, int, bool]]) -> bytes:
    """Sorted (suffix, before, doc_id, th, start, null id) as one compressed run."""
    out, last = [], b""
    for s, before, doc, th, start, none in items:
        lcp = common_prefix(last, s)
        out += [HEAD.pack(lcp, len(s) - lcp, len(before), doc, th, start, none), s[lcp:], before]
        last = s
    return zlib.compress(b"".join(out), 1)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(prefix shared with the one before, suffix, rest) of a run, in order."""
    data, at, s = zlib.decompress(blob), 0, b""
    while at < len(data):
        lcp, tail, before, doc, th, start, none = HEAD.unpack_from(data, at)
        at += HEAD.size
        s = s[:lcp] + data[at:at + tail]
        at += tail
        yield lcp, s, (data[at:at + before], doc, th, start, none)
        at += before


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """All suffixes of sorted runs in order, each with the prefix shared with the one given before.

    A loser tree: every head waits with the length it shares with the last winner on its way.
    The longer shared prefix is the smaller suffix; bytes are compared only at equal lengths,
    from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size
    loser = [-1] * size

    def beats(i: int, j: int) -> bool:
        """Whether head i comes before head j; the loser's shared length is renewed."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        x, y = shared[i], shared[j]
        if x != y:
            return x > y
        s, t = a[1], b[1]
        h = common_prefix(s, t, x)
        if h == len(s) or (h < len(t) and s[h] < t[h]):
            shared[j] = h
            return True
        shared[i] = h
        return False

    def play(node: int) -> int:
        if node >= size:
            return node - size
        i, j = play(2 * node), play(2 * node + 1)
        won, lost = (i, j) if beats(i, j) else (j, i)
        loser[node] = lost
        return won

    top = play(1) if size > 1 else 0
    while heads[top] is not None:
        yield shared[top], heads[top][1], heads[top][2]
        heads[top] = nxt = next(runs[top], None)
        shared[top] = nxt[0] if nxt else 0
        node = (top + size) // 2
        while node >= 1:
            if not beats(top, loser[node]):
                top, loser[node] = loser[node], top
            node //= 2


def shared_windows(lcps: list[int], group: list[tuple[bytes, tuple]], window: int, head: int) -> list[list[tuple[int, int]]]:
    """For each suffix of a group (suffix order), the offsets (from, to) of windows that another one has.

    lcps[i]: prefix shared by suffixes i and i + 1; each suffix begins with `head` bytes of the core's hash.
    """
    n = len(group)
    right = np.array(lcps, np.int64) - head
    befores = [g[1][0] for g in group]
    if n == 2:
        low, high = window - int(right[0]), common_prefix(befores[0], befores[1])
        found = [(low, high)] if low <= high else []
        return [found, found]
    order = sorted(range(n), key=befores.__getitem__)
    left = np.array([common_prefix(befores[i], befores[j]) for i, j in zip(order, order[1:])], np.int64)
    order = np.array(order)
    # classes change only where an offset passes one of these
    cuts = np.unique(np.concatenate([[0], window - right, left + 1]))
    cuts = cuts[(cuts >= 0) & (cuts <= window)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    own = np.empty(n, np.int64)
    for low, high in zip(cuts, np.append(cuts[1:], window + 1) - 1):
        by_suffix = np.concatenate([[0], np.cumsum(right < window - low)])
        own[order] = np.concatenate([[0], np.cumsum(left < low)])
        pair = by_suffix * n + own
        _, at, count = np.unique(pair, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(count[at] > 1):
            out[i].append((int(low), int(high)))
    return out


PART_SCHEMA = "doc_id long, th long, start int, n int, anchor int, core long"


def _parts(window: int):
    """Runs cut by the distance from a window's start to its anchor, each part with the hash of its core."""
    most = window - ANCHOR
    width = -(-(most + 1) // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, paths in zip(texts(b), b.column("paths").to_pylist()):
                a, start, n = (np.array([p[c] for p in paths], np.int64) for c in ("anchor", "start", "n"))
                rolled = Rolled(byte_values(t))
                cut = []
                for k, low in enumerate(range(0, most + 1, width)):
                    high = min(low + width - 1, most)
                    far, near = np.minimum(a - start, high), np.maximum(a - start - n + 1, low)
                    at = np.flatnonzero(near <= far)
                    core = rolled.stretch(a[at] - low, a[at] - high + window)
                    cut.append((a[at] - far[at], (far - near)[at] + 1, a[at], mix(core + U(k))))
                found.append(tuple(np.concatenate(c) for c in zip(*cut)))
            yield _flat(b, found, {"doc_id": (-1, np.int64), "th": (-1, np.int64), "start": (0, np.int32), "n": (1, np.int32),
                                   "anchor": (2, np.int32), "core": (3, np.int64)})
    return run


def _single_windows(window: int):
    """Every window of the parts with its core and the hash of its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, paths in zip(texts(b), b.column("paths").to_pylist()):
                start, n, core = (np.array([p[c] for p in paths], np.int64) for c in ("start", "n", "core"))
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append((np.repeat(core, n), Rolled(byte_values(t)).stretch(at, at + window), at))
            yield _flat(b, found, {"core": (0, np.int64), "bytes": (1, np.int64), "doc_id": (-1, np.int64), "th": (-1, np.int64),
                                   "start": (2, np.int32)})
    return run


def _with_paths(base: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """Documents of `rows` with their text and all their rows; at most a document's own rows come together."""
    by_doc = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*cols)).alias("paths"))
    return base.join(by_doc, same_document(base, by_doc)).select(base["doc_id"], base["th"], "text", "paths")


def _suffix_runs(window: int, buckets: int):
    def flush(held: dict[int, list]) -> pd.DataFrame:
        for v in held.values():
            v.sort()
        return pd.DataFrame({"bucket": list(held), "run": [front_code(v) for v in held.values()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            ths = b.column("th").to_pylist()
            for doc, th, t, paths in zip(ids, ths, texts(b), b.column("paths").to_pylist()):
                for p in paths:
                    a, start = p["anchor"], p["start"]
                    key = p["core"] & 0xFFFFFFFFFFFFFFFF
                    s = key.to_bytes(8, "big") + t[a:start + p["n"] - 1 + window]
                    before = t[start:a][::-1]
                    held.setdefault(key % buckets, []).append((s, before, doc or 0, th, start, doc is None))
                    size += len(s) + len(before) + 200
            if size > RUN_BYTES:
                yield pa.RecordBatch.from_pandas(flush(held), preserve_index=False)
                held, size = {}, 0
        if held:
            yield pa.RecordBatch.from_pandas(flush(held), preserve_index=False)
    return run


SPANS = "doc_id long, th long, start int, n int"


def _merged(window: int):
    def spans(lcps: list[int], group: list, out: list) -> None:
        if len(group) < 2:
            return
        for (s, (before, doc, th, start, none)), found in zip(group, shared_windows(lcps, group, window, 8)):
            most, least = len(before), window - (len(s) - 8)
            for low, high in found:
                low, high = max(low, least), min(high, most)
                if low <= high:  # the window at offset o starts at anchor - o
                    out.append((None if none else doc, th, start + most - high, high - low + 1))

    def table(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "th", "start", "n"])

    def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list = []
        group: list = []
        lcps: list[int] = []
        for lcp, s, rest in merge([read_run(x) for x in blobs]):
            if group and lcp >= 8:
                lcps.append(lcp)
            else:
                spans(lcps, group, out)
                group, lcps = [], []
            group.append((s, rest))
            if len(out) > 100_000:
                yield table(out)
                out = []
        spans(lcps, group, out)
        yield table(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("run").to_pylist()):
                held.setdefault(bucket, []).append(blob)
        for blobs in held.values():
            yield from one(blobs)
    return run


def repeated_byte_spans(base: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, th, start, n): n windows from byte `start` that also start elsewhere."""
    spark = base.sparkSession
    runs = repeated_runs(base, byte_values, ANCHOR, window, "byte-runs")
    place = F.struct("doc_id", "th", "start")
    kinds = runs.groupBy("mkey", "chash").agg(F.count("*").alias("places"), F.min(place).alias("first"),
                                              F.first("n").alias("n"), F.min(F.col("anchor") - F.col("start")).alias("off"))
    kinds = stored(kinds, "byte-kinds")
    whole = runs.join(kinds.where("places > 1").select("mkey", "chash"), ["mkey", "chash"], "left_semi")
    crossed = kinds.groupBy("mkey").agg(F.count("*").alias("c"), F.min("places").alias("least"))
    crossed = crossed.where("c > 1 and least = 1").select("mkey")  # else all of the anchor's runs are copies
    crossed = stored(crossed, "byte-crossed")
    open_runs = kinds.join(crossed, "mkey", "left_semi").select("first.*", "n", (F.col("first.start") + F.col("off")).alias("anchor"))
    parts = stored(_with_paths(base, open_runs, "start", "n", "anchor").mapInArrow(_parts(window), PART_SCHEMA), "byte-parts")
    groups = stored(parts.groupBy("core").agg(F.count("*").alias("size")).where("size > 1"), "byte-groups")
    parts = stored(parts.join(groups, "core"), "byte-alike")
    small = _with_paths(base, parts.where(F.col("size") <= group_rows), "start", "n", "anchor", "core")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_runs = small.mapInArrow(_suffix_runs(window, buckets), "bucket long, run binary")
    merged = sorted_runs.repartition(buckets, "bucket").mapInArrow(_merged(window), SPANS)
    large = _with_paths(base, parts.where(F.col("size") > group_rows), "start", "n", "core")
    single = stored(large.mapInArrow(_single_windows(window), "core long, bytes long, doc_id long, th long, start int"), "byte-windows")
    again = single.groupBy("core", "bytes").agg(F.count("*").alias("c")).where("c > 1").select("core", "bytes")
    single = single.join(stored(again, "byte-again"), ["core", "bytes"], "left_semi").withColumn("n", F.lit(1))
    cols = ("doc_id", "th", "start", "n")
    return whole.select(*cols).unionByName(merged).unionByName(single.select(*cols))


def _rebuild(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, count, kept = [], [], [], []
            for t, spans in zip(texts(b), b.column("spans").to_pylist()):
                pieces, at, gone, k = [], 0, 0, 0
                stop = -1
                for start, end in sorted((s["start"], s["start"] + s["n"] - 1 + window) for s in spans or ()):
                    if start > stop:  # touching stretches are one
                        pieces.append(t[at:start])
                        k += 1
                        gone += end - start
                        at = stop = end
                    elif end > stop:
                        gone += end - stop
                        at = stop = end
                pieces.append(t[at:])
                out = b"".join(pieces)
                size.append(len(t))
                removed.append(gone)
                count.append(k)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out)
            last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(count, pa.int64()), last[0]: pa.array(kept, last[1])})
    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                 digest: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes; with `digest` kept_sha256)."""
    base = keyed(docs, text, doc_id)
    spans = stored(repeated_byte_spans(base, window, group_rows), "byte-spans")
    spans = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    d = base.join(spans, same_document(base, spans), "left").select(base["doc_id"], "text", "spans")
    last = "kept_sha256 string" if digest else "kept binary"
    return d.mapInArrow(_rebuild(window, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
