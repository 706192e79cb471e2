"""Exact dedup through a cuckoo-filter index over digests of normalised texts.

A text's key is what stands for its content: SHA-256, MD5 and length in bytes, so two texts
are only taken for one where two independent digests and the length agree. The index is a
table of live keys, bucketed by key. Each bucket is served by one
cuckoo filter in one task: a miss proves a key new, a hit is verified against the
whole keys stored in the bucket, and a filter that overflows is rebuilt twice as large from
those keys. Copies are combined before the shuffle, so a text that a third of all rows
share reaches its bucket as one row per map batch.

Defined results: a NULL text counts as empty, empty texts are equal; a NULL doc_id sorts
after all others; of rows that repeat doc_id and text exactly one stays; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import WS, text_of

SLOTS = 4
MAX_KICKS = 200
COMBINE_ROWS = 200_000


class CuckooIndex:
    """Cuckoo filter (16-bit fingerprints, 4 slots) in front of the bucket's stored keys."""

    def __init__(self, n_buckets: int = 64):
        self.keys: dict[bytes, list] = {}
        self.false_hits = 0
        self._clear(n_buckets)

    def _clear(self, n_buckets: int) -> None:
        self.mask = n_buckets - 1
        self.table = [[] for _ in range(n_buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[8:10], "little") or 1
        i = int.from_bytes(digest[:8], "little") & self.mask
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995)) & self.mask

    def may_contain(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        return fp in self.table[i] or fp in self.table[j]

    def get(self, digest: bytes) -> list | None:
        """The stored entry of a live digest: filter first, then the exact key."""
        if not self.may_contain(digest):
            return None
        found = self.keys.get(digest)
        self.false_hits += found is None
        return found

    def insert(self, digest: bytes, entry: list) -> None:
        """Add a digest that is not live yet."""
        self.keys[digest] = entry
        if not self._place(digest):
            self._resize()

    def _place(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        for at in (i, j):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(fp)
                return True
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            fp, self.table[j][slot] = self.table[j][slot], fp
            j = self._other(j, fp)
            if len(self.table[j]) < SLOTS:
                self.table[j].append(fp)
                return True
        return False

    def _resize(self) -> None:
        size = 2 * (self.mask + 1)
        while True:
            self._clear(size)
            if all(self._place(d) for d in self.keys):
                return
            size *= 2

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; its fingerprint leaves the filter too."""
        if self.get(digest) is None:
            return False
        del self.keys[digest]
        fp, i, j = self._places(digest)
        self.table[i if fp in self.table[i] else j].remove(fp)
        return True

    def __len__(self) -> int:
        return len(self.keys)


INDEX_SCHEMA = "digest binary, keep_id long, n_keep long, n long"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest): the key of the text with each white-space run replaced by one space, its SHA-256 first."""
    norm = F.regexp_replace(text_of(text), WS, " ")
    key = F.concat(F.sha2(norm, 256), F.md5(norm), F.lpad(F.hex(F.octet_length(norm)), 16, "0"))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(key).alias("digest"))


def _smaller(a: int | None, b: int | None) -> bool:
    return b is not None and (a is None or b < a)


def _merge(entry: list, keep: int | None, n_keep: int, n: int) -> None:
    entry[2] += n
    if _smaller(entry[0], keep):
        entry[0], entry[1] = keep, n_keep
    elif entry[0] == keep:
        entry[1] += n_keep


def _rows(keys: dict[bytes, list]) -> pd.DataFrame:
    v = list(keys.values())
    return pd.DataFrame({"digest": list(keys), "keep_id": pd.array([x[0] for x in v], dtype="Int64"),
                         "n_keep": np.array([x[1] for x in v], "int64"), "n": np.array([x[2] for x in v], "int64")})


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per digest and at most COMBINE_ROWS digests: the map side of the index."""
    keys: dict[bytes, list] = {}
    for b in batches:
        for d, i in zip(b["digest"], b["doc_id"].astype("object").where(b["doc_id"].notna(), None)):
            i = None if i is None else int(i)
            d = bytes(d)
            if (e := keys.get(d)) is None:
                keys[d] = [i, 1, 1]
            else:
                _merge(e, i, 1, 1)
        if len(keys) >= COMBINE_ROWS:
            yield _rows(keys)
            keys = {}
    if keys:
        yield _rows(keys)


def _serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's buckets: rows with n > 0 are insertions, rows with n < 0 delete the digest."""
    index, dead = CuckooIndex(), set()
    for b in batches:
        keep = b["keep_id"].astype("object").where(b["keep_id"].notna(), None)
        for d, k, nk, n in zip(b["digest"], keep, b["n_keep"], b["n"]):
            d = bytes(d)
            if n < 0:
                dead.add(d)
                continue
            k = None if k is None else int(k)
            if (e := index.get(d)) is None:
                index.insert(d, [k, int(nk), int(n)])
            else:
                _merge(e, k, int(nk), int(n))
    for d in dead:
        index.delete(d)
    if len(index):
        yield _rows(index.keys)


def update_index(inserted: DataFrame, index: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Live keys after inserting `inserted` (doc_id, digest) into `index` and deleting `deleted` (digest).

    A digest that is both inserted and deleted is not live afterwards.
    """
    rows = inserted.select("doc_id", "digest").mapInPandas(_combine, INDEX_SCHEMA)
    if index is not None:
        rows = rows.unionByName(index.select("digest", "keep_id", "n_keep", "n"))
    if deleted is not None:
        gone = deleted.select("digest", F.lit(None).cast("long").alias("keep_id"),
                              F.lit(0).cast("long").alias("n_keep"), F.lit(-1).cast("long").alias("n"))
        rows = rows.unionByName(gone)
    return rows.repartition("digest").mapInPandas(_serve, INDEX_SCHEMA)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    d = digests(docs, doc_id, text)
    live = update_index(d)
    # rows that repeat doc_id and text are counted here and numbered after the join
    own = d.groupBy("doc_id", "digest").agg(F.count("*").alias("m"))
    out = own.join(live, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                      F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"))
