"""CSV scans that infer types in one aggregation and keep broken rows apart.

All columns are read as text once; each partition reduces its rows to a few flags for each
column (which types some value does not fit), flags are merged by one aggregation, and one
row for the whole table decides the types. A row with another number of fields than the
header is broken: it takes no part in the decision and comes back as its line.

The types are those of Spark's own inference on clean input: int, bigint, decimal for
longer whole numbers (38 digits at most), double, date, timestamp, boolean, else string;
whole numbers beside fractions make a double, dates beside times a timestamp, any other mix a
string, and a column without a value is a string. Empty fields are NULL and fit all types;
blank lines are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import chunks, qcol

BROKEN = "__line"
COLUMNS_AT_ONCE = 100
# The texts that Spark's reader takes as numbers that are not finite.
NOT_FINITE = ("NaN", "Inf", "+Inf", "-Inf", "Infinity", "+Infinity", "-Infinity")


@dataclass
class CheckedCsv:
    rows: DataFrame  # typed rows of well-formed lines
    broken: DataFrame  # (line) of the others
    schema: T.StructType
    n_rows: int
    n_broken: int


def _flags(c: Column) -> dict[str, Column]:
    """For each type, whether some value does not fit it; the longest whole number; whether there is a value."""
    whole = c.rlike(r"^[+-]?\d+$")
    number = c.rlike(r"^[+-]?(\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?$") | c.isin(*NOT_FINITE)
    day = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & c.try_cast("date").isNotNull()
    time = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$") & c.try_cast("timestamp").isNotNull()

    def misses(fits: Column) -> Column:
        return F.coalesce(F.max(c.isNotNull() & ~fits), F.lit(False))

    return {"any": F.coalesce(F.max(c.isNotNull()), F.lit(False)), "int": misses(whole & c.try_cast("int").isNotNull()),
            "bigint": misses(whole & c.try_cast("bigint").isNotNull()), "whole": misses(whole), "double": misses(number),
            "date": misses(day), "timestamp": misses(time), "boolean": misses(F.lower(c).isin("true", "false")),
            "digits": F.coalesce(F.max(F.when(whole, F.length(F.regexp_replace(c, r"^[+-]?0*", "")))), F.lit(0))}


def decide(flags) -> T.DataType:
    """The narrowest type that all values fit."""
    if not flags["any"]:
        return T.StringType()
    if not flags["int"]:
        return T.IntegerType()
    if not flags["bigint"]:
        return T.LongType()
    if not flags["whole"] and flags["digits"] <= 38:
        return T.DecimalType(max(1, flags["digits"]), 0)
    for name, kind in (("double", T.DoubleType()), ("date", T.DateType()), ("timestamp", T.TimestampType()), ("boolean", T.BooleanType())):
        if not flags[name]:
            return kind
    return T.StringType()


def scan_csv_checked(spark: SparkSession, path: str, **options) -> CheckedCsv:
    """Typed rows and broken lines of the CSV files with a header row below `path`.

    `options` go to Spark's reader (sep, quote, recursiveFileLookup, pathGlobFilter, ...). Two
    scans: the inference, and the read of the result.
    """
    def reader():
        r = spark.read.option("header", True)
        for k, v in options.items():
            r = r.option(k, v)
        return r

    names = reader().csv(path).columns
    if BROKEN in names:
        raise ValueError(f"the column name {BROKEN!r} is reserved")

    # without column pruning a row's fields are counted whatever columns are asked for
    texts = reader().schema(T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])).option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", False).csv(path)
    # Spark refuses to read the line alone, so each row's test reads a field too
    parsed = F.coalesce(F.length(qcol(names[0])), F.lit(0)) >= 0
    good = F.col(BROKEN).isNull() & parsed
    exprs = [F.count_if(good).alias("rows"), F.count_if(~good).alias("broken")]
    for n in names:
        value = F.when(good, qcol(n))
        exprs.append(F.struct(*[x.alias(k) for k, x in _flags(value).items()]).alias(f"c{len(exprs)}"))
    kinds: list[T.DataType] = []
    row = None
    for part in chunks(exprs[2:], COLUMNS_AT_ONCE):
        row = texts.agg(*exprs[:2], *part).first()
        kinds += [decide(f) for f in row[2:]]
    rows = texts.where(good)
    typed = [F.expr(f"try_cast(`{n.replace('`', '``')}` AS {k.simpleString()})").alias(n) for n, k in zip(names, kinds)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return CheckedCsv(rows.select(*typed), texts.where(F.col(BROKEN).isNotNull() & parsed).select(F.col(BROKEN).alias("line")), schema, row["rows"], row["broken"])
