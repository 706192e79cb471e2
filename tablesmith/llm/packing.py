"""Lexical retrieval packing: training sequences filled with a document's BM25 neighbours.

Documents are token ids with an end id. What fills whole windows of `width` ids is cut off
first; the rest of each document, its unit, is packed with the units most like it:

- Terms are token ids. How many units hold each one is counted over all units, so the table
  has at most as many rows as the vocabulary has ids; it goes to every task with the mean
  length.
- Units are dealt to shards of about `shard_tokens` ids by their leading term, the one with
  the highest id: BPE learned it last, so it is rare, and copies share it. Terms are laid
  side by side until a shard is full; a term that fills more than one shard is spread over
  several by row number, so no term and no group of copies is hot.
- Each shard is one group: an inverted index (terms, then postings with weights) answers a
  query for each seed, the first unused unit. The seed's window takes unused neighbours by
  falling score, all that fit whole; the best one left is cut to fill the window, and its
  rest is the next seed. So all windows are full but a shard's last, which is cut into
  lengths that are powers of two.

Every id is in exactly one piece. Whole windows go to shards like units, but are not in the index.

Defined results: a NULL or empty text is its end id alone; equal rows are separate
documents; neighbours of equal score (rounded to 9 places) follow in row order; an empty
table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.batch_bpe import batch_encoder
from tablesmith.llm.common import stored, text_of

WIDTH = 2048
SHARD_TOKENS = 1 << 18
END_ID = 1
K1, B = 1.5, 0.75
BATCH_TOKENS = 1 << 19
BATCH_ROWS = 256
UNITS = "doc_id long, start long, doc_tokens long, lead int, ids binary, counts array<int>"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _encode(vocabulary: str, width: int, end_id: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(vocabulary)
        rows: list[tuple] = []
        waiting, counts = 0, np.zeros(1, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in UNITS.split(", ")])

        parts = (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS))
        for b in parts:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, width):
                    part = ids[4 * at:4 * (at + width)]
                    terms = np.frombuffer(part, "<u4")
                    lead = int(terms.max())
                    rows.append((doc_id, at, n, lead, part, None))
                    if len(terms) < width:
                        if lead >= len(counts):
                            counts = np.concatenate([counts, np.zeros(lead + 1, np.int64)])
                        counts[np.unique(terms)] += 1
                waiting += n
                if waiting >= BATCH_TOKENS:
                    yield batch()
                    waiting = 0
        # the last row of a task counts its units that hold each term
        rows.append((None, -1, 0, None, None, counts.tolist()))
        yield batch()
    return run


def units(docs: DataFrame, vocabulary: str, width: int = WIDTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(unit, doc_id, start, doc_tokens, lead, ids) of whole windows and of the rest of each document, and rows of term counts; stored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(_encode(vocabulary, width, end_id), UNITS)
    return stored(rows.withColumn("unit", F.monotonically_increasing_id()), "pack-units")


def bag(ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Terms and how often each occurs."""
    return np.unique(np.frombuffer(ids, "<u4"), return_counts=True)


class Scorer:
    """BM25 weights of a unit's terms from the counts over all units."""

    def __init__(self, df: np.ndarray, n_units: int, mean_length: float):
        # a term that half of all units hold, or more, tells nothing
        self.idf = np.maximum(np.log((n_units - df + 0.5) / (df + 0.5)), 0.0)
        self.mean = max(mean_length, 1.0)

    def weights(self, terms: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean))


def statistics(all_units: DataFrame, width: int = WIDTH) -> Scorer:
    """Counts of all units' terms; one row for each id of the vocabulary comes to the driver, at most."""
    counts = all_units.where("counts is not null").select(F.posexplode("counts").alias("term", "n")).where("n > 0")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    rest = all_units.where(F.octet_length("ids") < 4 * width)
    n, length = rest.agg(F.count("*"), F.sum(F.octet_length("ids") / 4)).first()
    df = np.zeros(int(counts["term"].max()) + 1 if len(counts) else 1, np.int64)
    df[counts["term"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return Scorer(df, n, (length or 0) / max(n, 1))


def shards(tokens: dict[int, int], shard_tokens: int) -> tuple[list[tuple[int, int, int]], int]:
    """(term, first shard, number of shards) for each leading term, and the number of shards in all."""
    out, shard, filled = [], 0, 0
    for term in sorted(tokens):
        parts = max(1, -(-tokens[term] // shard_tokens))
        if filled and filled + tokens[term] > shard_tokens:
            shard, filled = shard + 1, 0
        out.append((term, shard, parts))
        filled += tokens[term]
        if parts > 1:
            shard, filled = shard + parts, 0
    return out, max(1, shard + (filled > 0))


class Index:
    """Inverted index of one shard's units."""

    def __init__(self, ids: list[bytes], scorer: Scorer):
        bags = [bag(x) for x in ids]
        sizes = np.array([len(t) for t, _ in bags], np.int64)
        terms = np.concatenate([t for t, _ in bags]) if bags else np.zeros(0, "<u4")
        weights = [scorer.weights(t, c, len(x) // 4) for (t, c), x in zip(bags, ids)]
        order = np.argsort(terms, kind="stable")
        self.n = len(ids)
        self.unit = np.repeat(np.arange(self.n), sizes)[order]
        self.weight = np.concatenate(weights)[order] if bags else np.zeros(0)
        self.terms, self.at = np.unique(terms[order], return_index=True)
        self.stop = np.append(self.at[1:], len(terms))
        self.queries = [t[scorer.idf[t] > 0] for t, _ in bags]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every unit for the seed's terms, each once."""
        k = np.searchsorted(self.terms, self.queries[seed])
        start, size = self.at[k], self.stop[k] - self.at[k]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        posting = np.arange(total) + np.repeat(start - (ends - size), size)
        return np.round(np.bincount(self.unit[posting], self.weight[posting], self.n), 9)


def fill(ids: list[bytes], scorer: Scorer, width: int = WIDTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (unit, start, length) that hold every id of the units once."""
    index = Index(ids, scorer)
    start, left = np.zeros(len(ids), np.int64), np.array([len(x) // 4 for x in ids], np.int64)
    out, seed, first = [], None, 0
    while True:
        if seed is None:
            while first < len(ids) and not left[first]:
                first += 1
            if first == len(ids):
                return out
            seed = first
        pieces, room = [(seed, int(start[seed]), int(left[seed]))], width - int(left[seed])
        left[seed] = 0
        order = np.flatnonzero(left)
        order = order[np.argsort(-index.scores(seed)[order], kind="stable")]
        seed = None
        open_units = order
        while room and len(open_units):
            open_units = open_units[left[open_units] <= room]
            fits = int(np.searchsorted(np.cumsum(left[open_units]), room, "right"))
            for u in open_units[:fits].tolist():
                pieces.append((u, int(start[u]), int(left[u])))
                room -= int(left[u])
                left[u] = 0
            open_units = open_units[fits:]
        rest = order[left[order] > 0]
        if room and len(rest):
            seed = int(rest[0])
            pieces.append((seed, int(start[seed]), room))
            start[seed] += room
            left[seed] -= room
            room = 0
        out += halved(pieces, width - room) if room else [pieces]


def halved(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two in `total`, largest first."""
    out: list[list[tuple[int, int, int]]] = []
    pieces = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, row = 1 << bit, []
            while room:
                u, at, n = pieces.pop()
                take = min(n, room)
                row.append((u, at, take))
                room -= take
                if take < n:
                    pieces.append((u, at + take, n - take))
            out.append(row)
    return out


def _pack(scorer: Scorer, width: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("unit")
        shard = group.column("shard")[0].as_py()
        ids, doc_id = group.column("ids").to_pylist(), group.column("doc_id").to_pylist()
        start, doc_tokens = group.column("start").to_pylist(), group.column("doc_tokens").to_pylist()
        rest = [k for k, x in enumerate(ids) if len(x) < 4 * width]
        sequences = [[(k, 0, width)] for k, x in enumerate(ids) if len(x) == 4 * width]
        sequences += [[(rest[u], at, n) for u, at, n in s] for s in fill([ids[k] for k in rest], scorer, width)]
        rows = []
        for number, s in enumerate(sequences):
            offset = 0
            for k, at, n in s:
                rows.append((doc_id[k], start[k] + at, n, ids[k][4 * at:4 * (at + n)], doc_tokens[k], (shard << 32) + number, offset))
                offset += n
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])
    return run


def pack(docs: DataFrame, vocabulary: str, width: int = WIDTH, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    all_units = units(docs, vocabulary, width, end_id, doc_id, text)
    scorer = statistics(all_units, width)
    leads = all_units.where("ids is not null").groupBy("lead").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("tokens")).collect()
    dealt, _ = shards({r.lead: r.tokens for r in leads}, shard_tokens)
    dealt = spark.createDataFrame(dealt, "lead int, first long, parts long")  # at most one row for each id of the vocabulary
    rows = all_units.where("ids is not null").drop("counts").join(F.broadcast(dealt), "lead")
    shard = F.col("first") + F.pmod(F.xxhash64("unit"), F.col("parts"))
    rows = rows.select(shard.alias("shard"), "unit", "doc_id", "start", "doc_tokens", "ids")
    return rows.groupBy("shard").applyInArrow(_pack(scorer, width), PIECES)
