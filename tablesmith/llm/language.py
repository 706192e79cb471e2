"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of the lower-cased letters, word
ends marked by a space. A text gets the language whose profile has the smallest
out-of-place distance: the sum of differences in rank, an n-gram the profile lacks
counting the profile's length. Profiles are counted over all training texts: each task
sums its own counts, Spark sums those of all tasks.

The profiles, `size` numbers per language, go to the workers with the function; their
number is that of the languages, not of documents.

Defined results: `und` and score 0 where the text is NULL or has no letter, or nothing
was learned; equal distances go to the language first by code point, equal counts to the
n-gram smaller by code point; a NULL doc_id is not held out; equal rows get equal
results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
UNKNOWN = "und"
MERGE_AT = 4_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes (two bits of length, three code points), ascending, and their counts."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[a]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first separator after a letter ends its word
    a = np.where(is_letter, a, 32)[keep]
    if not is_letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.concatenate([[32], a, [32][: int(a[-1] != 32)]])
    # small code points: 32-bit codes sort faster; the order is the same as of 64-bit codes
    bits, kind = (10, np.uint32) if a.max() < 1024 else (21, np.uint64)
    a = a.astype(kind)
    one, two = kind(bits), kind(2 * bits)
    top = 30 if kind is np.uint32 else 62
    codes = np.concatenate([
        a[a != 32] << two,
        kind(1 << top) | (a[:-1] << two) | (a[1:] << one),
        kind(2 << top) | (a[:-2] << two) | (a[1:-1] << one) | a[2:]])
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(first, len(codes)))
    codes = codes[first].astype(np.uint64)
    if kind is np.uint32:
        low = np.uint64(1023)
        codes = ((codes >> np.uint64(30)) << np.uint64(62)) | (((codes >> np.uint64(20)) & low) << np.uint64(42)) | (
            ((codes >> np.uint64(10)) & low) << np.uint64(21)) | (codes & low)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes, most frequent first."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def train_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, code, r): the `size` most frequent n-grams of each language, r from 0."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list] = {}
        held = 0
        for b in batches:
            for g, t in zip(b["g"], b["t"]):
                parts.setdefault(g, []).append(found := gram_counts(t))
                held += len(found[0])
                if held > MERGE_AT:
                    parts = {k: [_summed(v)] for k, v in parts.items()}
                    held = 0
        for g, v in parts.items():
            codes, n = _summed(v)
            yield pd.DataFrame({"lang": g, "code": codes.view(np.int64), "n": n})

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("g"), F.col(text).alias("t"))
    n = rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # codes are unsigned: negative ones stand after all others
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code") < 0, "code")
    n = n.withColumn("r", F.row_number().over(order) - 1).where(F.col("r") < size)
    return n.select("lang", "code", "r")


def predict_language(docs: DataFrame, profiles: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     size: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (1 less the distance as a share of the largest)."""
    rows = sorted((r.lang, r.r, r.code) for r in profiles.collect())
    table = {}
    for g in sorted({x[0] for x in rows}):
        codes = np.array([c for k, _, c in rows if k == g], np.int64).view(np.uint64)
        order = np.argsort(codes)
        table[g] = (codes[order], order)

    def guess(t: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(t) if t else (np.zeros(0, np.uint64), None)
        if not len(codes) or not table:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, size)
        rank = np.arange(len(own))
        best, least = UNKNOWN, None
        for g, (known, ranks) in table.items():
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            d = int(np.minimum(np.abs(ranks[at] - rank), size)[hit].sum()) + size * int((~hit).sum())
            if least is None or d < least:
                best, least = g, d
        return best, 1.0 - least / (size * len(own))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [guess(t) for t in b["t"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInPandas(
        run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """The third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
