"""File scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import qcol

# Fixed value: file-name filter for CSV uploads (case-insensitive `.csv`).
CSV_GLOB = "*.[cC][sS][vV]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = True, sampling_ratio: float = 1.0) -> DataFrame:
    """CSV with a header row. Inference costs one extra pass over the input (or over a
    `sampling_ratio` share of it), so pass `schema` when it is known.
    `csv_checked.scan_csv_checked` infers by one aggregation and keeps broken lines."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True).option("samplingRatio", sampling_ratio)
    return r.csv(path)


def scan_csv_dir(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                 infer: bool = True) -> DataFrame:
    """Every `.csv` file (any letter case) below a directory; other files are ignored."""
    r = (spark.read.option("header", True).option("recursiveFileLookup", True)
         .option("pathGlobFilter", CSV_GLOB))
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def scan_sample(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First n rows in a stated order (a bare limit is not deterministic)."""
    return df.orderBy(*[qcol(c).asc() for c in order_by]).limit(int(n))
