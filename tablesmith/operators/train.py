"""Estimators with the reference's settings, and fit/predict helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablesmith.functions.columns import is_numeric, qcol
from tablesmith.operators.features import FEATURES, LABEL, SEED

# Fixed values that must equal the reference's.
RF_TREES = 100
GBT_ITERATIONS = 50
LOGISTIC_ITERATIONS = 50
# Tree learners cache node ids and checkpoint them (to spark.checkpoint.dir) every few
# iterations, so a lost executor re-runs a short lineage, not the whole fit.
CHECKPOINT_INTERVAL = 10
# What a task of a tree learner may read of the rows it keeps for its iterations, about.
TASK_BYTES = 64 << 20

REGRESSORS = ("LinearRegression", "RandomForestRegressor", "GBTRegressor")
CLASSIFIERS = ("LogisticRegression", "RandomForestClassifier", "GBTClassifier")


def choose_algorithm(task: str, choice: str | None, n_classes: int | None = None) -> tuple[str, list[str]]:
    """Resolve the algorithm name. Regression defaults to GBT, classification to a random
    forest; GBT classification needs two classes and otherwise falls back to a forest."""
    notes = []
    if task == "regression":
        algo = choice if choice in REGRESSORS else "GBTRegressor"
    else:
        algo = choice if choice in CLASSIFIERS else "RandomForestClassifier"
        if algo == "GBTClassifier" and n_classes is not None and n_classes > 2:
            notes.append(f"GBTClassifier needs 2 classes, found {n_classes}: RandomForestClassifier used")
            algo = "RandomForestClassifier"
    return algo, notes


def make_estimator(algo: str, features: str = FEATURES, label: str = LABEL, seed: int = SEED,
                   checkpoint_interval: int = CHECKPOINT_INTERVAL):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    common = dict(featuresCol=features, labelCol=label)
    if algo == "LinearRegression":
        return R.LinearRegression(**common)
    if algo == "RandomForestRegressor":
        return R.RandomForestRegressor(numTrees=RF_TREES, seed=seed, cacheNodeIds=True,
                                       checkpointInterval=checkpoint_interval, **common)
    if algo == "GBTRegressor":
        return R.GBTRegressor(maxIter=GBT_ITERATIONS, seed=seed, checkpointInterval=checkpoint_interval,
                              **common)
    if algo == "LogisticRegression":
        return C.LogisticRegression(maxIter=LOGISTIC_ITERATIONS, **common)
    if algo == "RandomForestClassifier":
        return C.RandomForestClassifier(numTrees=RF_TREES, seed=seed, cacheNodeIds=True,
                                        checkpointInterval=checkpoint_interval, **common)
    if algo == "GBTClassifier":
        return C.GBTClassifier(maxIter=GBT_ITERATIONS, seed=seed, checkpointInterval=checkpoint_interval,
                               **common)
    raise ValueError(f"unknown algorithm {algo!r}")


def kept_row_bytes(estimator, slots: int) -> int:
    """About the bytes an iteration of a tree learner reads for one row (measured for 100 trees); 0 for other learners.

    For every tree a row has a sample count and a node id, which is read once more when it is renewed;
    its slots are binned to one int each.
    """
    if not estimator.hasParam("maxBins"):
        return 0
    trees = estimator.getNumTrees() if estimator.hasParam("numTrees") else 1
    return 12 * trees + 4 * slots + 250


def spread(df: DataFrame, cols: list[str], rows: int, row_bytes: int) -> DataFrame:
    """`cols` and the label in parts of at most TASK_BYTES (for at most `rows` rows); a small table stays as it is.

    Tree learners keep a table as it is dealt out, and a small file with many rows is one task's. Rows are dealt
    evenly whatever they hold, and ordered by their values: tree learners sample by part and place, so reruns agree.
    """
    parts = -(-rows * row_bytes // TASK_BYTES)
    if parts <= 1:
        return df
    order = [qcol(c) if is_numeric(df.schema[c].dataType) else qcol(c).cast("string") for c in (LABEL, *cols)]
    return df.select(LABEL, *[qcol(c) for c in cols]).repartition(parts).sortWithinPartitions(*order)


def fit_pipeline(stages: list, df: DataFrame):
    """Fit a stage list on a table -> PipelineModel."""
    from pyspark.ml import Pipeline
    return Pipeline(stages=stages).fit(df)


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df)
