"""train(): from a raw table to a fitted, self-contained pipeline and its report.

Every fitted step (casts, mean imputation, category indexing, one-hot, assembly, model)
sits inside one PipelineModel fitted on the training part only, so the saved model
scores raw tables. Passes over the data: one profile aggregation (drop rules, plus
approximate level counts for categorical columns and a classification target), label
index (classification), correlation selection (mode B), an all-null guard on the
training part, the fitted preparation, the fit of the learner (tree learners get the training
rows dealt into parts of bounded size), and the metric aggregations over the persisted
(label, prediction, score) columns of the test part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (Imputer, IndexToString, OneHotEncoder, SQLTransformer,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array

from tablesmith.functions.columns import is_numeric, orderable, qcol
from tablesmith.operators import evaluate as ev
from tablesmith.operators import features as fx
from tablesmith.operators.train import CHECKPOINT_INTERVAL, choose_algorithm, kept_row_bytes, make_estimator, spread
from tablesmith.session import ensure_checkpoint_dir
from tablesmith.sources.sinks import save_model


@dataclass
class TrainResult:
    model: object
    task: str
    algorithm: str
    numeric: list[str]
    categorical: list[str]
    slot_names: list[str]
    metrics: DataFrame
    importances: DataFrame
    predictions: DataFrame
    prediction: str = "prediction"  # name of the prediction column; another one where the table has such a column
    selection: DataFrame | None = None
    labels: list[str] | None = None
    notes: list[str] = field(default_factory=list)
    path: str | None = None


def _sql_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def free_name(name: str, taken: list[str]) -> str:
    """`name`, or the first of name_2, name_3, ... that no column has."""
    out, k = name, 1
    low = {t.lower() for t in taken}
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out


@dataclass
class Names:
    """Output columns of a model; internal ones are numbered, so no source name can meet them."""
    prediction: str
    raw: str
    probability: str
    predicted: str

    @classmethod
    def beside(cls, columns: list[str], target: str) -> "Names":
        clash = [c for c in columns if c.lower() == fx.LABEL or re.fullmatch(r"__(features|[nmciv]\d+)", c.lower())]
        if clash:
            raise ValueError(f"column names reserved for the pipeline: {clash}")
        return cls(*[free_name(n, columns) for n in ("prediction", "rawPrediction", "probability", f"predicted_{target}")])


def build_stages(numeric: list[str], categorical: list[str], algo: str,
                 labels: list[str] | None, names: Names, hash_buckets: int | None = None,
                 checkpoint_interval: int = CHECKPOINT_INTERVAL) -> list:
    """Stages from raw columns to a prediction. The k-th numeric column becomes __n{k}, imputed
    __m{k}; the k-th text column __c{k}, its index __i{k}, its vector __v{k}. With hash_buckets the index is the
    hash bucket, computed in SQL, and no list of levels is kept."""
    n = [f"{k}" for k in range(len(numeric))]
    c = [f"{k}" for k in range(len(categorical))]
    sel = ["*"]
    sel += [f"try_cast(nullif(trim(cast({_sql_name(x)} as string)), '') as double) AS __n{k}" for k, x in zip(n, numeric)]
    if hash_buckets is None:
        sel += [f"cast({_sql_name(x)} as string) AS __c{k}" for k, x in zip(c, categorical)]
    else:  # the same rule as features.hash_bucket
        lit = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        sel += [f"cast(pmod(xxhash64({lit(x)}, coalesce(cast({_sql_name(x)} as string), concat(char(0), 'NULL'))), {int(hash_buckets)}L) as double) AS __i{k}"
                for k, x in zip(c, categorical)]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")]
    inputs = []
    if numeric:
        stages.append(Imputer(inputCols=[f"__n{k}" for k in n], outputCols=[f"__m{k}" for k in n], strategy="mean"))
        inputs += [f"__m{k}" for k in n]
    if categorical:
        if hash_buckets is None:
            stages.append(StringIndexer(inputCols=[f"__c{k}" for k in c], outputCols=[f"__i{k}" for k in c], handleInvalid="keep"))
        # buckets beyond those of the training part are all zeros, as unseen levels are
        stages.append(OneHotEncoder(inputCols=[f"__i{k}" for k in c], outputCols=[f"__v{k}" for k in c],
                                    handleInvalid="error" if hash_buckets is None else "keep"))
        inputs += [f"__v{k}" for k in c]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=fx.FEATURES, handleInvalid="keep"))
    model = make_estimator(algo, checkpoint_interval=checkpoint_interval)
    model.setPredictionCol(names.prediction)
    if labels is not None:
        if model.hasParam("rawPredictionCol"):
            model.setRawPredictionCol(names.raw)
        if model.hasParam("probabilityCol"):
            model.setProbabilityCol(names.probability)
    stages.append(model)
    if labels is not None:
        stages.append(IndexToString(inputCol=names.prediction, outputCol=names.predicted, labels=labels))
    return stages


def source_slots(slots: list[str], numeric: list[str], categorical: list[str]) -> list[str]:
    """Vector slots by the names of the source columns: the column, or column_vec_level."""
    out = []
    for s in slots:
        m = re.fullmatch(r"__(m|v)(\d+)(?:_(.*))?", s, re.S)
        out.append(s if m is None else numeric[int(m[2])] if m[1] == "m" else f"{categorical[int(m[2])]}_vec_{m[3]}")
    return out


def _profile_pass(df: DataFrame, approx_cols: list[str]) -> tuple[dict, dict, int]:
    """One aggregation -> ({column: 'empty' | 'constant' | None}, {column: approx levels}, rows)."""
    exprs = [F.count(F.lit(1)).alias("rows")]
    fields = list(enumerate(df.schema.fields))
    for i, f in fields:
        c = qcol(f.name)
        exprs.append(F.count(c).alias(f"n{i}"))
        exprs.append((F.min(c).eqNullSafe(F.max(c)) if orderable(f.dataType) else F.lit(False)).alias(f"s{i}"))
        if f.name in approx_cols:
            exprs.append(F.approx_count_distinct(c).alias(f"d{i}"))
    row = df.agg(*exprs).first().asDict()
    reasons, levels = {}, {}
    for i, f in fields:
        nonnull = row[f"n{i}"]
        reasons[f.name] = "empty" if nonnull == 0 else (
            "constant" if row[f"s{i}"] and nonnull == row["rows"] else None)
        if f"d{i}" in row:
            levels[f.name] = row[f"d{i}"]
    return reasons, levels, row["rows"]


def train(df: DataFrame, target: str, mode: str = "B", task: str | None = None,
          algorithm: str | None = None, categorical: bool = True, features: str | list[str] = "",
          threshold: float = fx.CORR_THRESHOLD, split_keys: list[str] | None = None,
          fraction: float = fx.TRAIN_FRACTION, split: str = "hash", nulls: str = "zero",
          max_categories: int | None = None, max_classes: int | None = None,
          hash_buckets: int | None = None, checkpoint_interval: int = CHECKPOINT_INTERVAL, match: str = "substring",
          save_path: str | None = None, drop_rules: bool = True) -> TrainResult:
    """Fit and evaluate one model; see the module doc for the steps.

    Every text column is one-hot encoded with all its levels, which the fitted indexer
    keeps on the driver and in the saved model: name the features, or set `categorical`
    to False, where a table has identifier-like text.
    Tree learners checkpoint every `checkpoint_interval` iterations (-1: never).
    With `hash_buckets` text columns are encoded by the hash bucket of their value instead:
    driver and model then hold the buckets, not the levels (`features.hash_collisions` tells
    how many values share one); only the caller chooses this. A caller may set limits on
    (approximate) level counts: columns above `max_categories` are left out and listed in
    `notes`, a target above `max_classes` raises.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)  # tree learners checkpoint their node ids / predictions there
    notes: list[str] = []
    if target not in df.columns:
        raise ValueError(f"the table has no column {target!r}")
    task = fx.infer_task(df, target, task)  # from the schema

    # one pass: drop rules for every column, plus approximate level counts where the
    # caller set a limit on them
    approx = [f.name for f in df.schema.fields if not is_numeric(f.dataType)] \
        if (categorical and max_categories is not None) else []
    if task == "classification" and max_classes is not None and target not in approx:
        approx.append(target)
    reasons, levels, n_rows = _profile_pass(df, approx)
    if drop_rules:
        df = df.drop(*[c for c, r in reasons.items() if r])
        if target not in df.columns:
            raise ValueError(f"target {target!r} is empty or constant")

    labels = None
    if task == "classification":
        if max_classes is not None and levels[target] > max_classes:
            raise ValueError(f"about {levels[target]} classes in {target!r}, more than max_classes={max_classes}")
        idx_model, lab = fx.index_label(df, target)
        labels = list(idx_model.labels)
    else:
        lab = df.withColumn(fx.LABEL, fx.to_double(qcol(target)))
    lab = lab.dropna(subset=[fx.LABEL])

    # candidates come from the source columns only: the label never becomes a feature
    selection = None
    if mode == "A":
        num, cat = fx.select_all(df, target, categorical, match)
    elif mode == "B":
        cands = fx.numeric_candidates(df, target, match)
        selection = fx.selection_by_corr(lab, fx.LABEL, cands, threshold, nulls) if cands else None
        sel_rows = selection.collect() if selection is not None else []
        if selection is not None:  # keep the computed rows (one per candidate), not the plan
            selection = spark.createDataFrame([tuple(r) for r in sel_rows], "feature string, r double, selected boolean")
        num = [r["feature"] for r in sel_rows if r["selected"]]
        if sel_rows and not any(r["r"] is not None and abs(r["r"]) >= threshold for r in sel_rows):
            notes.append(f"no feature reaches |r| >= {threshold}: all numeric candidates used")
        cat = fx.string_candidates(df, target) if categorical else []
    else:
        num, cat, more = fx.select_custom(df, target, features, categorical, match)
        notes += more
    if not num and not cat:
        raise ValueError("no column is left to learn from")

    if max_categories is not None and cat:
        skipped = [c for c in cat if levels.get(c, 0) > max_categories]
        if skipped:
            notes.append(f"skipped high-cardinality categorical columns: {skipped}")
            cat = [c for c in cat if c not in skipped]

    algo, more = choose_algorithm(task, algorithm, len(labels) if labels is not None else None)
    notes += more

    # the training part is not cached here: the learners persist their own compact
    # inputs (binned tree points, assembled instances) for their iterations
    train_df, test_df = fx.train_test_split(lab, split_keys, fraction, split)
    if not train_df.take(1):
        raise ValueError("the training part is empty")
    if not test_df.take(1):
        notes.append("the test part is empty: the metrics are NULL")
    if num:  # Imputer cannot fit a column with no number (NULL and NaN are none) in the training part
        values = [fx.to_double(qcol(c)) for c in num]
        present = train_df.agg(*[F.count(F.when(~F.isnan(v), v)) for v in values]).first()
        empty = [c for c, n in zip(num, present) if n == 0]
        if empty:
            notes.append(f"dropped features with no value in the training part: {empty}")
            num = [c for c in num if c not in empty]
    if not num and not cat:
        raise ValueError("no feature has a value in the training part")

    out = Names.beside(df.columns, target)
    stages = build_stages(num, cat, algo, labels, out, hash_buckets, checkpoint_interval)
    at = len(stages) - (1 if labels is None else 2)  # the learner
    prepared = Pipeline(stages=stages[:at]).fit(train_df)
    slots = len(ev.slot_names(prepared.transform(train_df), fx.FEATURES))
    dealt = spread(train_df, num + cat, n_rows, kept_row_bytes(stages[at], slots))
    model = PipelineModel([*prepared.stages, stages[at].fit(prepared.transform(dealt)), *stages[at + 1:]])

    preds = model.transform(test_df)
    names = source_slots(ev.slot_names(preds, fx.FEATURES), num, cat)
    # the test part is scored once: the metric passes read the persisted (label,
    # prediction, raw score) columns and the few metric rows are materialised before the
    # cache is released
    keep = [qcol(fx.LABEL).alias("label"), qcol(out.prediction).alias("prediction")]
    has_score = task == "classification" and out.raw in preds.columns
    if has_score:
        keep.append(F.get(vector_to_array(qcol(out.raw)), F.lit(1)).alias("score"))
    scored = preds.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if task == "regression":
            rows = ev.regression_metrics(scored).collect()
        else:
            rows = ev.classification_metrics(scored).collect()
            if has_score and scored.select("label").distinct().limit(3).count() == 2:
                rows += ev.area_under_roc(scored).collect()
            else:
                notes.append("auc left out: the test part does not have exactly two labels")
    finally:
        scored.unpersist()
    metrics = spark.createDataFrame([(r["metric"], r["value"]) for r in rows], "metric string, value double")
    last = model.stages[-2] if labels is not None else model.stages[-1]
    if hasattr(last, "featureImportances"):
        importances = ev.feature_importance(spark, last, names)
    else:
        importances = ev.model_coefficients(spark, last, names).select("feature", "value")
    path = save_model(model, save_path) if save_path else None
    return TrainResult(model=model, task=task, algorithm=algo, numeric=num, categorical=cat,
                       slot_names=names, metrics=metrics, importances=importances,
                       predictions=preds, prediction=out.prediction, selection=selection, labels=labels, notes=notes, path=path)


def report(result: TrainResult, name: str = "") -> DataFrame:
    """One table for the status view: (section, name, value) rows."""
    spark = result.metrics.sparkSession
    info = spark.createDataFrame(
        [("model", "algorithm", result.algorithm), ("model", "task", result.task),
         ("model", "name", name)], "section string, name string, value string")
    m = result.metrics.select(F.lit("metric").alias("section"), F.col("metric").alias("name"),
                              F.col("value").cast("string").alias("value"))
    i = result.importances.select(F.lit("importance").alias("section"), F.col("feature").alias("name"),
                                  F.col("value").cast("string").alias("value"))
    return info.unionByName(m).unionByName(i)
