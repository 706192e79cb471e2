"""Order-preserving ranges of a column, sized by the data, and positions over them.

A sketch of the whole column gives literal cut points, so every later scan finds the same
ranges without a sort, a stored table or partition ids. Each range holds about
`ROWS_PER_RANGE` rows, up to `MOST_RANGES` ranges; sums over the ranges (a few thousand
rows) then join the two levels: what lies before a range, and what lies before a row in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_RANGE = 16_384
MOST_RANGES = 4_096
# Finer ranges by the second column inside one value of the first that fills more than this many ranges.
HOT = 4
SKETCH = 50_000


def order_code(c: Column, kind: T.DataType) -> Column | None:
    """A double that never falls where the column rises; None for types without one."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):  # its first six bytes
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return None


def cut_points(df: DataFrame, value: str, rows_per_range: int = ROWS_PER_RANGE, most: int = MOST_RANGES) -> list[float]:
    """Ascending cut points that part the doubles `value` into ranges of about rows_per_range rows.

    A value that fills whole ranges has a range of its own. At most 2 * most numbers come to the driver.
    """
    # as SQL text: thousands of literals made one by one take seconds
    probs = ", ".join(f"{i / most:.12f}D" for i in range(1, most))
    n, cuts = df.agg(F.count(value), F.expr(f"percentile_approx(`{value}`, array({probs}), {SKETCH})")).first()
    wanted = min(most, math.ceil((n or 0) / rows_per_range))
    if wanted < 2 or not cuts:
        return []
    step = max(1, most // wanted)
    chosen = [c for c in cuts[step - 1::step] if not math.isnan(c)]
    again = {a for a, b in zip(chosen, chosen[1:]) if a == b}
    return sorted({*chosen, *(math.nextafter(c, math.inf) for c in again)})


def range_of(df: DataFrame, value: str, cuts: list[float], out: str) -> DataFrame:
    """Adds `out`, the number of cut points at or below the double `value`; NaN is above all, NULL is -1."""
    cuts = [c for c in cuts if math.isfinite(c)]
    if not cuts:
        return df.withColumn(out, F.when(F.col(value).isNull(), -1).otherwise(0))
    from pyspark.ml.feature import Bucketizer
    ends = [-math.inf, *cuts, math.inf]
    cut = Bucketizer(splits=ends, inputCol="__o", outputCol=out, handleInvalid="keep")
    found = cut.transform(df.withColumn("__o", F.coalesce(F.col(value), F.lit(0.0))))
    return found.withColumn(out, F.when(F.col(value).isNull(), -1).otherwise(F.col(out).cast("int"))).drop("__o")


def numbered(df: DataFrame, first: str, second: str, out: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds `out`, 0, 1, 2, ... in the order of `first` and the double `second`, NULLs first.

    Ranges of `first`; one value of it that fills several ranges is parted by `second`. The
    cut points and the ranges' row counts are literals of the one shuffle that numbers the
    rows. Texts that share their first six bytes are one range.
    """
    spark = df.sparkSession
    code = order_code(F.col(f"`{first}`"), df.schema[first].dataType)
    coded = df.withColumn("__code", code if code is not None else F.lit(0.0))
    cuts = cut_points(coded, "__code", rows_per_range)
    placed = range_of(coded, "__code", cuts, "__r")
    one = F.min(first).eqNullSafe(F.max(first)).alias("one")
    sizes = placed.groupBy("__r").agg(F.count("*").alias("n"), one).collect()
    hot = [r["__r"] for r in sizes if r.one and r.n > HOT * rows_per_range]
    parts = {}
    if hot:
        probs = [i / 256 for i in range(1, 256)]
        inside = placed.where(F.col("__r").isin(hot)).groupBy("__r").agg(F.percentile_approx(second, probs, SKETCH).alias("c"))
        parts = {r["__r"]: sorted(set(r.c or [])) for r in inside.collect()}
    if parts:
        table = spark.createDataFrame(list(parts.items()), "__r int, __c array<double>")
        placed = placed.join(F.broadcast(table), "__r", "left")
        below = F.size(F.filter("__c", lambda c: c <= F.col(second))).cast("int")
        placed = placed.withColumn("__s", F.when(F.col("__c").isNull() | F.col(second).isNull(), -1).otherwise(below)).drop("__c")
    else:
        placed = placed.withColumn("__s", F.lit(-1))
    counts = sorted(tuple(r) for r in placed.groupBy("__r", "__s").agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for r, s, n in counts:  # one row a range
        rows.append((r, s, before))
        before += n
    offsets = spark.createDataFrame(rows, "__r int, __s int, __before long")
    order = Window.partitionBy("__r", "__s").orderBy(F.col(f"`{first}`").asc_nulls_first(), F.col(f"`{second}`").asc_nulls_first())
    placed = placed.join(F.broadcast(offsets), ["__r", "__s"])
    return placed.withColumn(out, F.col("__before") + F.row_number().over(order) - 1).drop("__r", "__s", "__before", "__code")
