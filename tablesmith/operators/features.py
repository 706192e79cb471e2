"""Feature preparation: task inference, label, selection modes, imputation, encoding,
assembly and a deterministic split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import is_numeric, qcol, require_columns
from tablesmith.functions.names import is_id_like
from tablesmith.functions.numbers import to_double
from tablesmith.functions.text import split_names
from tablesmith.operators.corr import corr_with_target

# Fixed values that must equal the reference's.
CORR_THRESHOLD = 0.20
TRAIN_FRACTION = 0.8
SEED = 42
# Internal column names (a source column may already be called `label` or `features`).
LABEL = "__label"
FEATURES = "__features"
# Hash split resolution: a row's bucket is one of this many.
SPLIT_BUCKETS = 1000


def infer_task(df: DataFrame, target: str, task: str | None = None) -> str:
    """Explicit choice wins; a numeric target means regression, anything else classification."""
    if task in ("regression", "classification"):
        return task
    require_columns(df, [target])
    return "regression" if is_numeric(df.schema[target].dataType) else "classification"


def index_label(df: DataFrame, target: str, out: str = LABEL, handle_invalid: str = "skip"):
    """String target -> index (most frequent = 0, ties alphabetical); rows with a null or
    unseen label are skipped. Returns (fitted StringIndexerModel, indexed table)."""
    from pyspark.ml.feature import StringIndexer
    require_columns(df, [target])
    tmp = f"{out}__src"
    src = df.withColumn(tmp, qcol(target).cast("string"))
    model = StringIndexer(inputCol=tmp, outputCol=out, handleInvalid=handle_invalid).fit(src)
    return model, model.transform(src).drop(tmp)


def numeric_candidates(df: DataFrame, target: str, match: str = "substring") -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name != target and not is_id_like(f.name, match)]


def string_candidates(df: DataFrame, target: str) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name != target]


def select_all(df: DataFrame, target: str, categorical: bool = True,
               match: str = "substring") -> tuple[list[str], list[str]]:
    """Mode A: every numeric candidate, plus the string columns when asked."""
    return numeric_candidates(df, target, match), (string_candidates(df, target) if categorical else [])


def selection_by_corr(df: DataFrame, label: str, candidates: list[str],
                      threshold: float = CORR_THRESHOLD, nulls: str = "zero") -> DataFrame:
    """(feature, r, selected): |r| with the label >= threshold; when nothing passes,
    every candidate is selected. One aggregation; the fallback looks at <= #features rows."""
    cast = df.select(*[to_double(qcol(c)).alias(c) for c in candidates],
                     qcol(label).cast("double").alias("__y"))
    r = corr_with_target(cast, "__y", candidates, nulls)
    passed = F.coalesce(F.abs(F.col("r")) >= F.lit(threshold), F.lit(False))
    any_passed = F.max(passed.cast("int")).over(Window.partitionBy(F.lit(1)))
    return r.select("feature", "r", (passed | (any_passed == 0)).alias("selected"))


def select_custom(df: DataFrame, target: str, names: str | list[str], categorical: bool = True,
                  match: str = "substring") -> tuple[list[str], list[str], list[str]]:
    """Mode C: the named columns. No numeric named -> all numeric candidates; categorical
    asked but no string named -> all string columns. Returns (numeric, string, notes)."""
    req = split_names(names) if isinstance(names, str) else [n.strip() for n in names if n.strip()]
    req = list(dict.fromkeys(req))  # a column named twice is one feature
    nums, strs = numeric_candidates(df, target, match), string_candidates(df, target)
    chosen_n = [r for r in req if r in nums]
    chosen_s = [r for r in req if r in strs]
    notes = []
    if not chosen_n:
        chosen_n = nums
        notes.append("no numeric feature named: all numeric candidates used")
    if categorical and not chosen_s:
        chosen_s = strs
        notes.append("no string feature named: all string columns used")
    return chosen_n, chosen_s, notes


def split_bucket(keys: list[str]) -> Column:
    """0..SPLIT_BUCKETS-1 from the md5 of the key text: independent of partitioning; NULL keys have a bucket too."""
    text = F.coalesce(qcol(keys[0]).cast("string"), F.lit("\u0000NULL")) if len(keys) == 1 else \
        F.concat_ws("\u0001", *[qcol(k).cast("string") for k in keys])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return h % F.lit(SPLIT_BUCKETS)


def split_flag(keys: list[str], fraction: float = TRAIN_FRACTION) -> Column:
    """True for the training part."""
    return split_bucket(keys) < F.lit(int(round(fraction * SPLIT_BUCKETS)))


def train_test_split(df: DataFrame, keys: list[str] | None = None, fraction: float = TRAIN_FRACTION,
                     method: str = "hash", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Key-hash split, the same however the table is partitioned; randomSplit without keys."""
    if method == "random" or not keys:
        a, b = df.randomSplit([fraction, 1 - fraction], seed=seed)
        return a, b
    flag = split_flag(keys, fraction)
    return df.filter(flag), df.filter(~flag)


def impute_mean(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """NULL/NaN -> column mean, computed on doubles (an int column is not truncated)."""
    from pyspark.ml.feature import Imputer
    require_columns(df, cols)
    tmp = [f"{c}__dbl" for c in cols]
    src = df.select("*", *[to_double(qcol(c)).alias(t) for c, t in zip(cols, tmp)])
    outs = [f"{c}{suffix}" if suffix else f"{c}__imp" for c in cols]
    model = Imputer(inputCols=tmp, outputCols=outs, strategy="mean").fit(src)
    res = model.transform(src).drop(*tmp)
    if not suffix:
        res = res.drop(*cols)
        for c, o in zip(cols, outs):
            res = res.withColumnRenamed(o, c)
    return res


def index_categorical(df: DataFrame, cols: list[str], suffix: str = "_idx",
                      handle_invalid: str = "keep"):
    """Many categorical columns -> indices in one fit (one job for all columns).
    Values are cast to text first; unseen/NULL go to an extra last index."""
    from pyspark.ml.feature import StringIndexer
    require_columns(df, cols)
    tmp = [f"{c}__str" for c in cols]
    src = df.select("*", *[qcol(c).cast("string").alias(t) for c, t in zip(cols, tmp)])
    model = StringIndexer(inputCols=tmp, outputCols=[f"{c}{suffix}" for c in cols],
                          handleInvalid=handle_invalid).fit(src)
    return model, model.transform(src).drop(*tmp)


def hash_bucket(col: str, buckets: int) -> Column:
    """0..buckets-1 from the column's name and the value's text; NULL has a bucket like any value."""
    text = F.coalesce(qcol(col).cast("string"), F.lit("\u0000NULL"))
    return F.pmod(F.xxhash64(F.lit(col), text), F.lit(buckets).cast("bigint"))


def hash_collisions(df: DataFrame, cols: list[str], buckets: int) -> DataFrame:
    """(column, levels, used, shared): values, buckets they fall into, and values that share theirs with another.

    One row for each different value of a column is shuffled; nothing is kept on the driver.
    """
    require_columns(df, cols)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value"), hash_bucket(c, buckets).alias("bucket")) for c in cols])
    levels = df.select(F.inline(cells)).groupBy("column", "bucket", "value").agg(F.lit(1).alias("one"))
    filled = levels.groupBy("column", "bucket").agg(F.count("*").alias("n"))
    return filled.groupBy("column").agg(F.sum("n").alias("levels"), F.count("*").alias("used"),
                                        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"))


def one_hot(df: DataFrame, index_cols: list[str], suffix: str = "_vec"):
    """Indices -> one-hot vectors, last category dropped (so the extra 'unseen' bucket of
    a keep-indexer is all zeros). Returns (fitted OneHotEncoderModel, table)."""
    from pyspark.ml.feature import OneHotEncoder
    model = OneHotEncoder(inputCols=index_cols,
                          outputCols=[c.removesuffix("_idx") + suffix for c in index_cols]).fit(df)
    return model, model.transform(df)


def assemble_features(df: DataFrame, cols: list[str], out: str = FEATURES) -> DataFrame:
    """Numeric columns and vectors -> one vector; invalid values are kept (as NaN)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def nonzero_slots(vec_col: str) -> Column:
    """array<struct<slot, value>> of a vector's non-zero slots, of a sparse one without making it dense.

    A Python function: no built-in expression reads the slots of a sparse vector.
    """
    from pyspark.sql.functions import udf

    @udf("array<struct<slot:int,value:double>>")
    def slots(v):
        if v is None:
            return None
        pairs = zip(v.indices, v.values) if hasattr(v, "indices") else enumerate(v.toArray())
        return [(int(i), float(x)) for i, x in pairs if x != 0]

    return slots(qcol(vec_col))


def vector_long(df: DataFrame, vec_col: str, key_cols: list[str], names: list[str]) -> DataFrame:
    """(keys..., slot, feature, value) for the non-zero slots of a vector column."""
    keys = [qcol(k) for k in key_cols]
    ex = df.select(*keys, F.inline(nonzero_slots(vec_col)))
    return ex.select(*keys, "slot", F.get(F.array(*[F.lit(n) for n in names]), F.col("slot")).alias("feature"), "value")


def one_hot_long(df: DataFrame, vec_col: str, key_cols: list[str], name: str | None = None) -> DataFrame:
    """Long form of an encoder's vectors: (keys..., column, slot, value) for each 1."""
    keys = [qcol(k) for k in key_cols]
    return df.select(*keys, F.lit(name or vec_col).alias("column"), F.inline(nonzero_slots(vec_col)))
