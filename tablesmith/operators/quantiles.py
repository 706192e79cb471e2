"""Exact quantiles (linear interpolation) in two scans, with no group held whole by one task.

1. One aggregation gives each group's count, moments, ends and, from Spark's mergeable
   quantile sketch, a bracket around each wanted rank: the values a little below and above
   it, wider than the sketch's error. Groups of fewer than `4 * accuracy` values take the
   whole range as bracket.
2. A second scan counts, for each group, the values between the brackets (one number each)
   and the different values inside them. Their running counts give every value its rank,
   and the wanted ranks are read off and interpolated.

What is shuffled is one row for each different value inside a bracket: 8 / accuracy of a
large group's values for each quantile, and running counts restart in each bracket. With up
to `GROUPS_IN_MEMORY` groups the brackets are a checked, broadcast table, so rows are never
shuffled by group; beyond that they are joined by a shuffle, which Spark splits where a
group is hot.

NaN counts as the largest value; NULL values are ignored; a NULL key is a group.

method="map" uses Spark's `percentile` (exact; fine for low-cardinality values) and
method="approx" `percentile_approx` (bounded sketch, rank error 1/accuracy).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import qcol

ACCURACY = 10_000
# Brackets of up to this many groups are collected, counted and broadcast.
GROUPS_IN_MEMORY = 50_000


def _ascending(probs) -> None:
    if not probs or list(probs) != sorted(set(probs)) or probs[0] < 0 or probs[-1] > 1:
        raise ValueError("probabilities must ascend from 0 to 1")


def bracket_probabilities(probs, accuracy: int = ACCURACY) -> list[float]:
    """Two probabilities for each wanted one, 4 / accuracy below and above it."""
    return [min(max(p + s * 4.0 / accuracy, 0.0), 1.0) for p in probs for s in (-1, 1)]


def summary(v: Column, probs, accuracy: int = ACCURACY) -> list[Column]:
    """n, mean, std, min, max and the bracket ends b of the values v, as aggregates."""
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            F.max(v).alias("max"), F.percentile_approx(v, bracket_probabilities(probs, accuracy), accuracy).alias("b")]


def brackets(n, low, high, b, k: int, accuracy: int = ACCURACY) -> list[tuple[Column, Column]]:
    """(start, stop) of the k brackets; those that overlap are one, named several times."""
    whole = n < 4 * accuracy
    lo = [F.when(whole, low).otherwise(F.get(b, F.lit(2 * i))) for i in range(k)]
    hi = [F.when(whole, high).otherwise(F.get(b, F.lit(2 * i + 1))) for i in range(k)]
    start, stop = [lo[0]], [hi[-1]]
    for i in range(1, k):
        start.append(F.when(hi[i - 1] >= lo[i], start[i - 1]).otherwise(lo[i]))
        stop.insert(0, F.when(hi[k - 1 - i] >= lo[k - i], stop[0]).otherwise(hi[k - 1 - i]))
    return list(zip(start, stop))


def zone(v: Column, parts: list[tuple[Column, Column]]) -> Column:
    """2 i for values below the i-th bracket and above the one before, 2 i + 1 inside it, NULL above the last."""
    z = F.lit(None).cast("int")
    for i, (start, stop) in reversed(list(enumerate(parts))):
        z = F.when(v < start, 2 * i).when(v <= stop, 2 * i + 1).otherwise(z)
    return z


def joined(a: DataFrame, b: DataFrame, keys: list[str], hint: bool = False) -> DataFrame:
    """Inner join on keys, NULL equal to NULL."""
    named = b.select(*[qcol(k).alias(f"__{k}") for k in keys], *[qcol(c) for c in b.columns if c not in keys])
    named = F.broadcast(named) if hint else named
    same = [qcol(k).eqNullSafe(qcol(f"__{k}")) for k in keys]
    return a.join(named, reduce(lambda x, y: x & y, same)).drop(*[f"__{k}" for k in keys])


def ranked(rows: DataFrame, counts: DataFrame, keys: list[str], probs) -> DataFrame:
    """(keys..., q) from rows (keys..., zone, v) and counts (keys..., n)."""
    names = [qcol(k) for k in keys]
    kept = rows.where("zone is not null").select(*names, "zone", F.when(F.col("zone") % 2 == 1, F.col("v")).alias("v"))
    kept = kept.groupBy(*names, "zone", "v").agg(F.count("*").alias("c"))
    by_zone = kept.groupBy(*names, "zone").agg(F.sum("c").alias("c"))
    order = Window.partitionBy(*names).orderBy("zone")
    before = by_zone.select(*names, "zone", F.coalesce(
        F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    inside = joined(joined(kept.where("zone % 2 = 1"), before, [*keys, "zone"]), counts, keys)
    run = Window.partitionBy(*names, "zone").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("end", F.col("off") + F.sum("c").over(run))
    start, end = F.col("end") - F.col("c"), F.col("end")
    hits = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        hits.append(F.struct(F.lit(i).alias("i"), pos.alias("pos"), lo.alias("lo"), hi.alias("hi"),
                             ((start <= lo) & (lo < end)).alias("at_lo"), ((start <= hi) & (hi < end)).alias("at_hi")))
    found = inside.select(*names, "v", F.inline(F.array(*hits))).where("at_lo or at_hi")
    per_q = found.groupBy(*names, "i", "pos", "lo", "hi").agg(
        F.max(F.when(F.col("at_lo"), F.col("v"))).alias("a"), F.max(F.when(F.col("at_hi"), F.col("v"))).alias("b"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket; use a larger accuracy"))
    q = F.when(F.col("a").isNull() | F.col("b").isNull(), missed.cast("double")).when(F.col("hi") == F.col("lo"), F.col("a")).otherwise(
        (F.col("hi") - F.col("pos")) * F.col("a") + (F.col("pos") - F.col("lo")) * F.col("b"))
    out = per_q.select(*names, "i", q.alias("q")).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("qs"))
    out = out.withColumn("qs", F.when(F.size("qs") < len(probs), F.array(F.struct(F.lit(0).alias("i"), missed.cast("double").alias("q")))).otherwise(F.col("qs")))
    return out.select(*names, F.transform("qs", lambda s: s["q"]).alias("q"))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = ACCURACY,
                      groups_in_memory: int = GROUPS_IN_MEMORY) -> DataFrame:
    """(keys..., q, n, mean, std, min, max): q[i] is the interpolated quantile probs[i] of `value` per group.

    Groups without values are absent. The first scan runs when the result is built.
    """
    if not keys:
        return grouped_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, accuracy).drop("__all")
    names = [qcol(k) for k in keys]
    _ascending(probs)
    vals = df.select(*names, qcol(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = vals.groupBy(*names).agg(*summary(F.col("v"), probs, accuracy)).where("n > 0")
    rows = stats.limit(groups_in_memory + 1).collect()
    small = len(rows) <= groups_in_memory
    if small:
        stats = df.sparkSession.createDataFrame(rows, stats.schema)
    ends = brackets(F.col("n"), F.col("min"), F.col("max"), F.col("b"), len(probs), accuracy)
    edges = stats.select(*names, *[c.alias(f"__{s}{i}") for i, e in enumerate(ends) for s, c in zip("ab", e)])
    placed = joined(vals, edges, keys, hint=small)
    parts = [(F.col(f"__a{i}"), F.col(f"__b{i}")) for i in range(len(probs))]
    found = ranked(placed.select(*names, zone(F.col("v"), parts).alias("zone"), "v"), stats.select(*names, "n"), keys, probs)
    return joined(found, stats.drop("b"), keys, hint=small).select(*names, "q", "n", "mean", "std", "min", "max")


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(position, n, mean, std, min, max, q) for columns read as doubles; q is NULL without values.

    One row for each column comes to the driver after the first scan and is a literal in the second.
    """
    _ascending(probs)
    spark = df.sparkSession
    values = [qcol(c).cast("double") for c in cols]
    stats = df.agg(F.array(*[F.struct(F.lit(i).alias("position"), *summary(v, probs, accuracy)) for i, v in enumerate(values)]).alias("s"))
    stats = stats.select(F.inline("s"))
    rows = stats.collect()
    stats = spark.createDataFrame(rows, stats.schema)
    cells = []
    for v, r in zip(values, rows):
        if r.n:
            lit = [F.lit(x) for x in r.b]
            ends = brackets(F.lit(r.n), F.lit(r["min"]), F.lit(r["max"]), F.array(*lit), len(probs), accuracy)
            cells.append(F.struct(F.lit(r.position).alias("position"), F.when(v.isNotNull(), zone(v, ends)).alias("zone"), v.alias("v")))
    if not cells:
        return stats.drop("b").withColumn("q", F.lit(None).cast("array<double>"))
    found = ranked(df.select(F.inline(F.array(*cells))), stats.select("position", "n"), ["position"], probs)
    return F.broadcast(stats.drop("b")).join(found, "position", "left")


def quantile_agg(c: Column, probs, method: str, accuracy: int = ACCURACY) -> Column:
    """Aggregate-expression form for the one-scan methods."""
    if method == "map":
        return F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))
    if method == "approx":
        return F.percentile_approx(c, [float(p) for p in probs], accuracy)
    raise ValueError("method must be 'distributed', 'map' or 'approx'")
