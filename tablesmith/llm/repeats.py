"""Finding windows of symbols (words, bytes) that may occur more than once.

Each window of `window` symbols has an anchor: the place of the smallest hash among its
`k`-grams, the last one of equals. Equal windows have their anchors at the same offset,
so only windows with equal anchor k-grams need to be compared. Consecutive windows with
one anchor form a run. A run is one small row: hash of its anchor, hash of its whole
content, place. Runs whose anchor hash occurs once are dropped by an aggregation of
hashes (combined before the shuffle) and a join, which Spark can split where a hash is
hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import stored

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits (the finaliser of splitmix64, fixed values)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Rolled:
    """Polynomial hashes of any stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        p, self.inverse = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(values * p[: self.n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length."""
        m = max(0, self.n - length + 1)
        return mix((self.sums[length:length + m] - self.sums[:m]) * self.inverse[:m])


def byte_values(text: bytes) -> np.ndarray:
    return BYTE_VALUE[np.frombuffer(text, np.uint8)]


def word_values(text: bytes) -> np.ndarray:
    """One value for each word."""
    b = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~SPACE[b]
    change = np.flatnonzero(np.diff(inside))
    start, stop = change[::2], change[1::2]
    return Rolled(BYTE_VALUE[b]).stretch(start, stop)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, a
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


LOW = U(0xFFFFFFFF)


def runs(rolled: Rolled, k: int, window: int) -> tuple[np.ndarray, ...]:
    """start, number of windows, anchor place, anchor hash, content hash of each run."""
    m = rolled.n - window + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    h = rolled.every(k)
    order = (h & ~LOW) | (LOW - np.arange(len(h), dtype=U))
    anchor = (LOW - (sliding_min(order, window - k + 1) & LOW)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(start, m))
    at = anchor[start]
    return start, count, at, h[at], rolled.stretch(start, start + count - 1 + window)


RUN_SCHEMA = "mkey long, chash long, doc_id long, th long, start int, n int, anchor int"


def _flat(batch: pa.RecordBatch, per_doc: list[tuple[np.ndarray, ...]], names: dict[str, tuple[int, type]]) -> pa.RecordBatch:
    """Rows of all documents: the named parts of per_doc with the document's key beside them."""
    counts = np.array([len(p[0]) for p in per_doc], np.int64)
    at = pa.array(np.repeat(np.arange(len(counts)), counts))
    cols = {}
    for name, (i, kind) in names.items():
        if i < 0:
            cols[name] = batch.column(name).take(at)
        else:
            v = np.concatenate([p[i] for p in per_doc]) if per_doc else np.zeros(0, U)
            cols[name] = pa.array(v.view(np.int64) if v.dtype == U else v.astype(kind))
    return pa.RecordBatch.from_pydict(cols)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def repeated_runs(base: DataFrame, values: Callable[[bytes], np.ndarray], k: int, window: int, name: str) -> DataFrame:
    """RUN_SCHEMA rows of `base` (doc_id, th, text) whose anchor hash occurs more than once; stored."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(Rolled(values(t)), k, window)[3:4] for t in texts(b)]
            yield _flat(b, found, {"mkey": (0, np.int64)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(Rolled(values(t)), k, window) for t in texts(b)]
            yield _flat(b, found, {"mkey": (3, np.int64), "chash": (4, np.int64), "doc_id": (-1, np.int64), "th": (-1, np.int64),
                                   "start": (0, np.int32), "n": (1, np.int32), "anchor": (2, np.int32)})

    often = base.select("text").mapInArrow(hashes, "mkey long").groupBy("mkey").agg(F.count("*").alias("c"))
    often = stored(often.where(F.col("c") > 1).select("mkey"), "anchors")  # stored, so that the join can split hot keys
    return stored(base.mapInArrow(rows, RUN_SCHEMA).join(often, "mkey", "left_semi"), name)


def same_document(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
