"""Model metrics as DataFrame aggregations (one pass per metric family) and
model read-outs (importances, coefficients) with named vector slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import qcol

def _metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    structs = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
               for k, v in metrics.items()]
    return df.agg(F.array(*structs).alias("m")).select(F.inline("m"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       metrics=("rmse", "r2")) -> DataFrame:
    """(metric, value) for rmse and r2 in one aggregation.
    r2 = 1 - SSE/SST with SST about the mean; SST = 0 gives NULL."""
    y, p = qcol(label).cast("double"), qcol(prediction).cast("double")
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    sq = (y - p) * (y - p)
    sst = F.var_pop(y) * F.count(y)
    known = {"rmse": F.sqrt(F.avg(sq)), "mse": F.avg(sq), "mae": F.avg(F.abs(y - p)),
             "r2": F.lit(1.0) - F.try_divide(F.sum(sq), sst)}
    return _metric_rows(df, {m: known[m] for m in metrics})


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): at most classes^2 rows; partial counts before the shuffle."""
    return df.groupBy(qcol(label).cast("double").alias("label"),
                      qcol(prediction).cast("double").alias("prediction")) \
             .agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           metrics=("accuracy", "weightedPrecision", "weightedRecall")) -> DataFrame:
    """(metric, value): accuracy and label-weighted precision/recall from the confusion
    counts (tiny after the first aggregation)."""
    conf = confusion_counts(df, label, prediction)
    per_label = conf.groupBy("label").agg(
        F.sum("n").alias("c"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    per_pred = conf.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("pr"))
    j = per_label.join(per_pred, "label", "left")
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pr")), F.lit(0.0))
    n = F.sum("c")
    known = {"accuracy": F.sum("tp") / n,
             "weightedPrecision": F.sum(F.col("c") * prec) / n,
             "weightedRecall": F.sum("tp") / n}
    return _metric_rows(j, {m: known[m] for m in metrics})


def area_under_roc(df: DataFrame, label: str = "label", score: str = "score",
                   rows_per_range: int | None = None) -> DataFrame:
    """(metric='auc', value): exact area under the ROC curve, ties counted half.

    Rows collapse to distinct scores with positive/negative counts (partial aggregation).
    Scores are parted into ranges sized by the data (operators/ranks.py, literal cut points);
    positives above each range come from a prefix sum over the ranges' totals, positives above
    each score inside its range from a window per range. Both read the same exchange, nothing
    is stored, and no step ranks all rows in one task. Labels above 0.5 are positive; a NaN
    score is above all others; scores of NULL are left out.
    """
    from tablesmith.operators.ranks import ROWS_PER_RANGE, cut_points, range_of
    s = df.select(qcol(score).cast("double").alias("s"),
                  (qcol(label).cast("double") > 0.5).cast("long").alias("pos")) \
          .filter(F.col("s").isNotNull())
    cuts = cut_points(s, "s", rows_per_range or ROWS_PER_RANGE)
    g = s.groupBy("s").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n"))
    b = range_of(g, "s", cuts, "bucket")
    tot = b.groupBy("bucket").agg(F.sum("p").alias("bp"))
    above = tot.select("bucket", F.coalesce(F.sum("bp").over(
        Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("p_above"))
    j = b.join(F.broadcast(above), "bucket")  # one row a range, a few thousand at most
    w = Window.partitionBy("bucket").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("p_gt", F.col("p_above") + F.coalesce(F.sum("p").over(w), F.lit(0)))
    num = F.sum(F.col("n").cast("double") * (F.col("p_gt") + F.col("p") * 0.5))
    den = F.sum(F.col("p")).cast("double") * F.sum(F.col("n")).cast("double")
    return _metric_rows(j, {"auc": F.try_divide(num, den)})


def slot_names(df: DataFrame, features_col: str) -> list[str]:
    """Names of the vector slots from the assembler metadata (schema only)."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    names = {}
    for group in attrs.values():
        for a in group:
            names[a["idx"]] = a.get("name", f"f{a['idx']}")
    n = meta.get("num_attrs", len(names))
    return [names.get(i, f"f{i}") for i in range(n)]


def feature_importance(spark, model, names: list[str]) -> DataFrame:
    """(feature, value) from a tree model's importances, largest first."""
    imp = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, value double").orderBy(
        F.col("value").desc(), F.col("feature"))


def model_coefficients(spark, model, names: list[str]) -> DataFrame:
    """(class, feature, value) linear coefficients, largest magnitude first; `class` is
    NULL for a single coefficient vector and the class index for multinomial models."""
    rows = []
    if getattr(model, "numClasses", 2) > 2 and hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        for k in range(m.shape[0]):
            rows += [(k, n, float(v)) for n, v in zip(names, m[k])]
    else:
        rows = [(None, n, float(v)) for n, v in zip(names, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "class int, feature string, value double").orderBy(
        F.abs(F.col("value")).desc(), F.col("feature"))
