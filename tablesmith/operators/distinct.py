"""Distinct values of all columns as a table that can be kept and added to.

The exact state has, for whole numbers that lie close together, one row for each column and
bucket of 32,768 numbers with a bitmap of those that occur, and one row for each value of
other columns. Partial aggregation makes both before the shuffle, so dense keys cost bits,
not rows. States of two batches are added by OR and by grouping; nothing of the first batch
is read again. The sketch state has one row for each column, a HyperLogLog sketch, and is
added the same way.

Rows are taken apart column by column inside the scan's stage. NULL is kept as a flag; all
NaN are one value, and 0.0 and -0.0 are one; dates, times and texts are compared as they
are; arrays, structs and maps by their JSON text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import chunks, qcol

# position of the column; bucket and bitmap of whole numbers, or a value; whether NULL was seen
STATE = "position int, bucket bigint, bits binary, value string, has_null boolean"
BUCKET = 32_768
# Bitmaps are for columns with this many rows for each bucket of their range, or few buckets.
ROWS_PER_BUCKET = 64
FEW_BUCKETS = 16
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)
CHUNK = 100


def _whole(c: Column, kind: T.DataType) -> Column | None:
    """The value as a whole number, or None for types that have none."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("bigint")
    return c.cast("bigint") if isinstance(kind, WHOLE) else None


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0).cast(kind)).cast("string")  # -0.0 becomes 0.0
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(F.struct(c.alias("v")))
    return c.cast("string")


def bitmap_columns(df: DataFrame) -> list[str]:
    """Columns of whole numbers that lie close together; one scan for their ends."""
    wholes = [(f.name, n) for f in df.schema.fields if (n := _whole(qcol(f.name), f.dataType)) is not None]
    out = []
    for chunk in chunks(wholes, CHUNK):
        if not chunk:
            continue
        row = df.agg(*[x for i, (_, n) in enumerate(chunk) for x in (F.min(n).alias(f"a{i}"), F.max(n).alias(f"b{i}"), F.count(n).alias(f"n{i}"))]).first()
        for i, (name, _) in enumerate(chunk):
            if row[f"n{i}"] and (row[f"b{i}"] - row[f"a{i}"]) // BUCKET < max(FEW_BUCKETS, row[f"n{i}"] // ROWS_PER_BUCKET):
                out.append(name)
    return out


def _cells(df: DataFrame, fields: list, cell) -> DataFrame:
    """Rows (position, x, none) of the columns, one for each cell."""
    structs = [F.struct(F.lit(i).alias("position"), cell(qcol(f.name), f.dataType).alias("x"), qcol(f.name).isNull().alias("none")) for i, f in fields]
    return df.select(F.inline(F.array(*structs)))


def distinct_state(df: DataFrame, bitmaps: list[str] | None = None) -> DataFrame:
    """The exact state of all columns of `df`; `bitmaps` names the columns kept as bitmaps (default: `bitmap_columns`)."""
    bitmaps = bitmap_columns(df) if bitmaps is None else bitmaps
    fields = list(enumerate(df.schema.fields))
    dense = [x for x in fields if x[1].name in bitmaps]
    parts = []
    for chunk in chunks(dense, CHUNK):
        if chunk:
            rows = _cells(df, chunk, _whole).groupBy("position", F.bitmap_bucket_number("x").alias("bucket")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(F.coalesce("x", F.lit(1).cast("bigint")))).alias("bits"), F.max("none").alias("has_null"))
            parts.append(rows.withColumn("value", F.lit(None).cast("string")))
    for chunk in chunks([x for x in fields if x not in dense], CHUNK):
        if chunk:
            rows = _cells(df, chunk, _text).groupBy("position", F.col("x").alias("value")).agg(F.max("none").alias("has_null"))
            parts.append(rows.select("position", F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "value", "has_null"))
    names = [c.split()[0] for c in STATE.split(", ")]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*names) for p in parts])


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows together, from the states alone; they must keep the same columns as bitmaps."""
    rows = reduce(lambda a, b: a.unionByName(b), states)
    names = [c.split()[0] for c in STATE.split(", ")]
    bits = rows.where("bits is not null").groupBy("position", "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.max("has_null").alias("has_null")).withColumn("value", F.lit(None).cast("string"))
    values = rows.where("bits is null").groupBy("position", "value").agg(F.max("has_null").alias("has_null"))
    values = values.withColumn("bucket", F.lit(None).cast("bigint")).withColumn("bits", F.lit(None).cast("binary"))
    return bits.select(*names).unionByName(values.select(*names))


def added(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after another batch of the same columns; reads the state and the batch only."""
    kept = {r.position for r in state.where("bits is not null").select("position").distinct().collect()}  # one row a column
    return merged(state, distinct_state(batch, [c for i, c in enumerate(batch.columns) if i in kept]))


def _names(rows: DataFrame, schema: T.StructType) -> DataFrame:
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, f.name) for i, f in enumerate(schema.fields)], "position int, column string")
    return F.broadcast(names).join(rows, "position", "left")


def counts(state: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, values, has_null): distinct values without NULL, and whether there is one."""
    per_row = F.when(F.col("value").isNotNull(), 1).when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    found = state.groupBy("position").agg(F.sum(per_row).alias("values"), F.max("has_null").alias("has_null"))
    return _names(found, schema).select("column", F.coalesce("values", F.lit(0)).cast("bigint").alias("values"),
                                        F.coalesce("has_null", F.lit(False)).alias("has_null"))


def sketch_state(df: DataFrame, lg_k: int = 14) -> DataFrame:
    """(position, sketch, has_null): one HyperLogLog sketch for each column, about 1.04 / 2**(lg_k / 2) relative error."""
    parts = []
    for chunk in chunks(list(enumerate(df.schema.fields)), CHUNK):
        structs = []
        for i, f in chunk:
            c = qcol(f.name)
            n = _whole(c, f.dataType)
            structs.append(F.struct(F.lit(i).alias("position"), F.hll_sketch_agg(_text(c, f.dataType) if n is None else n, lg_k).alias("sketch"),
                                    F.coalesce(F.max(c.isNull()), F.lit(False)).alias("has_null")))
        parts.append(df.agg(F.array(*structs).alias("s")).select(F.inline("s")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def merged_sketches(*states: DataFrame) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b), states)
    return rows.groupBy("position").agg(F.hll_union_agg("sketch").alias("sketch"), F.max("has_null").alias("has_null"))


def sketch_counts(state: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, values, has_null) as estimates."""
    return _names(state.select("position", F.hll_sketch_estimate("sketch").alias("values"), "has_null"), schema).select(
        "column", F.coalesce("values", F.lit(0)).cast("bigint").alias("values"), F.coalesce("has_null", F.lit(False)).alias("has_null"))
