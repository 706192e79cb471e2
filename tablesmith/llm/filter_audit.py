"""Filter interaction audit: which of five filters removes what, alone, together and in any order.

Every document gets one bit for each filter it fails. Documents are counted by part and
failure bits, and from those at most 32 counts a part the removals of all 32 coalitions of
filters are tabulated: a coalition removes what fails one of its filters at least. The rest
follows from that table. A step of an order removes the difference of two coalitions. The
Shapley values are the exact constrained least-squares fit to the table: kernel weights
(m - 1) / (C(m, s) s (m - s)) for coalitions of s of m filters, the values' sum held to the
removals of all filters, the normal equations solved in rationals. The sum over all m!
orders is m! times the value, a whole number.

Filters on a text (words: maximal runs of anything but space and U+0009 to U+000D):
A under 200 words; B 100 * distinct words < 50 * words; C 100 * capitals A to Z > 3 * code
points; D holds one of #$%&*|; E equals the text of a smaller doc_id, anywhere in the table.

Filters and equal texts are DataFrame expressions and an aggregation; equal texts are told
by two 64-bit hashes and the length. The first doc_id of a text is joined only to texts that
occur more than once, by rows without text, so copies of one text spread over tasks. The
part's rows are made from its counts, in one small group for each part.

Defined results: a NULL text counts as empty and fails A only (and E behind a smaller
doc_id); a NULL doc_id is smaller than all others; rows that share the smallest doc_id of a
text do not fail E; a NULL lang is the part ''; a document has quality or toxic 1 if one of
its label rows has; an empty table gives an empty result. Columns other than those named are
not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import stored, text_of, words_of

FILTERS = "ABCDE"
MARKS = "[#$%&*|]"
ROWS = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_failures(t: Column) -> Column:
    """Bits of the filters A to D that a non-null text fails, A lowest."""
    words = words_of(t)
    few = F.size(words) < 200
    repetitive = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    capitals = 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 3 * F.length(t)
    return sum((c.cast("int") * (1 << k) for k, c in enumerate((few, repetitive, capitals, t.rlike(MARKS)))), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by failure bits and labels; a few rows for each part."""
    t = text_of()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
                    F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(len(FILTERS)), t).alias("k2"), F.length(t).alias("k3"),
                    text_failures(t).alias("mask"))
    copies = d.groupBy("k1", "k2", "k3").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = stored(copies.drop("c"), "audit-copies")  # stored, so that the join can split a hot text
    d = d.join(copies, ["k1", "k2", "k3"], "left")
    later = F.col("first").isNotNull() & F.col("doc_id").isNotNull() & (
        F.col("first.doc_id").isNull() | (F.col("doc_id") > F.col("first.doc_id")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    d = d.select("doc_id", "part", (F.col("mask") + F.coalesce(later, F.lit(False)).cast("int") * 16).alias("mask")).join(marks, "doc_id", "left")
    return d.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.count("*").alias("n"))


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """x with a x = b, by elimination; a is square and regular."""
    rows = [[*r, y] for r, y in zip(a, b)]
    n = len(rows)
    for k in range(n):
        p = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[p] = rows[p], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [r[-1] for r in rows]


def shapley(removed: list[int], m: int = len(FILTERS)) -> list[Fraction]:
    """Shapley values of the game removed[coalition bits], by constrained least squares.

    Minimises the kernel-weighted squares of removed[S] - sum of the members' values over all
    proper coalitions, with the values' sum equal to removed[all]; the last unknown is the
    multiplier of that constraint.
    """
    a = [[Fraction(0)] * (m + 1) for _ in range(m + 1)]
    b = [Fraction(0)] * (m + 1)
    for s in range(1, (1 << m) - 1):
        size = s.bit_count()
        weight = Fraction(m - 1, comb(m, size) * size * (m - size))
        members = [i for i in range(m) if s >> i & 1]
        for i in members:
            b[i] += weight * removed[s]
            for j in members:
                a[i][j] += weight
    for i in range(m):
        a[i][m] = a[m][i] = Fraction(1)
    b[m] = Fraction(removed[-1])
    return solve(a, b)[:m]


def coalitions(counts: dict[int, int], m: int = len(FILTERS)) -> list[int]:
    """What each coalition of filters removes: documents whose failure bits meet its bits."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(1 << m)]


def audit_part(part: str, rows: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its counts (mask, good, toxic, n)."""
    def table(chosen: pd.DataFrame) -> list[int]:
        return coalitions({int(k): int(n) for k, n in chosen.groupby("mask")["n"].sum().items()})

    removed, good, toxic = table(rows), table(rows[rows["good"] == 1]), table(rows[rows["toxic"] == 1])
    total, everyone, orders = int(rows["n"].sum()), len(removed) - 1, factorial(len(FILTERS))
    values = [int(x * orders) for x in shapley(removed)]
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            after, alone = before | 1 << i, 1 << i
            here = removed[after] - removed[before]
            out.append((part, "".join(FILTERS[k] for k in order), step, total - removed[after], here, removed[alone] - here,
                        removed[everyone] - removed[everyone ^ alone], good[after] - good[before], toxic[after] - toxic[before],
                        values[i]))
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    return failures(docs, labels).groupBy("part").applyInPandas(lambda key, rows: audit_part(key[0], rows), ROWS)
