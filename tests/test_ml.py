import random

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import evaluate as ev
from tablesmith.operators import features as fx
from tablesmith.plans.training import train
from tablesmith.sources.sinks import load_model
from tablesmith.session import scratch_path


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        x, z = rnd.uniform(0, 10), rnd.uniform(0, 10)
        cat = ["north", "south", "east"][i % 3]
        rows.append((i, x, z, cat, 3 * x + rnd.gauss(0, 0.5), "hi" if x > 5 else "lo"))
    return spark.createDataFrame(rows, "row_id int, x double, z double, region string, y double, cls string")


def test_planted_signal_regression(spark, planted):
    res = train(planted, "y", mode="A", algorithm="RandomForestRegressor", split_keys=["row_id"])
    imp = res.importances.collect()
    assert imp[0]["feature"] == "x"
    m = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert m["r2"] > 0.9
    assert "row_id" not in res.numeric  # id-like name excluded


def test_linear_regression_coefficients(spark, planted):
    res = train(planted, "y", mode="A", algorithm="LinearRegression", categorical=False, split_keys=["row_id"])
    coef = {r["feature"]: r["value"] for r in res.importances.collect()}
    assert coef["x"] == pytest.approx(3.0, abs=0.1)


def test_mode_b_selects_signal(spark, planted):
    res = train(planted, "y", mode="B", algorithm="LinearRegression", categorical=False, split_keys=["row_id"])
    sel = {r["feature"]: r["selected"] for r in res.selection.collect()}
    assert sel["x"] and not sel["z"]
    assert res.numeric == ["x"]


def test_mode_b_fallback_when_nothing_passes(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("y"))
    sel = fx.selection_by_corr(df, "y", ["a"], 0.99).collect()
    assert sel[0]["selected"] is True
    res = train(df, "y", mode="B", threshold=0.99, algorithm="LinearRegression", split_keys=["row_id"])
    assert res.numeric == ["a"] and any("all numeric candidates" in n for n in res.notes)


def test_string_target_classification_no_leak(spark, planted):
    res = train(planted, "cls", mode="A", split_keys=["row_id"])
    assert res.task == "classification" and "cls" not in res.categorical
    assert res.algorithm == "RandomForestClassifier"
    m = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert m["accuracy"] > 0.9 and "auc" in m


def test_gbt_three_classes_falls_back(spark, planted):
    res = train(planted, "region", mode="A", algorithm="GBTClassifier", split_keys=["row_id"])
    assert res.algorithm == "RandomForestClassifier" and res.notes


def test_fractional_target_as_classification_is_indexed(spark, planted):
    df = planted.withColumn("t", (F.col("row_id") % 2) + 0.5)
    res = train(df, "t", mode="A", task="classification", algorithm="LogisticRegression", split_keys=["row_id"])
    assert res.labels is not None and len(res.labels) == 2


def test_column_named_label_and_features(spark, planted):
    df = planted.withColumnRenamed("z", "label").withColumnRenamed("region", "features")
    res = train(df, "y", mode="A", algorithm="LinearRegression", split_keys=["row_id"])
    assert "label" in res.numeric and "features" in res.categorical


def test_all_null_feature_in_train_part_is_dropped(spark, planted):
    flag = fx.split_flag(["row_id"], 0.8)
    df = planted.withColumn("w", F.when(~flag, F.lit(1.0)))  # values only in the test part
    res = train(df, "y", mode="A", algorithm="LinearRegression", categorical=False, split_keys=["row_id"])
    assert "w" not in res.numeric and any("no value" in n for n in res.notes)


def test_auc_left_out_with_one_test_label(spark):
    base = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("x"))
    in_train = fx.split_flag(["k"], 0.8)
    # label 'b' only on some training rows: the test part holds one label
    df = base.withColumn("t", F.when(in_train & (F.col("k") % 2 == 0), "b").otherwise("a"))
    res = train(df, "t", mode="A", split_keys=["k"], algorithm="RandomForestClassifier")
    assert res.predictions.select(fx.LABEL).distinct().count() == 1
    metrics = {r["metric"] for r in res.metrics.collect()}
    assert "auc" not in metrics and "accuracy" in metrics
    assert any("auc left out" in n for n in res.notes)


def test_timestamp_and_boolean_categoricals_are_indexed(spark, planted):
    df = planted.withColumn("when", F.to_timestamp(F.lit("2024-01-01 00:00:00")) +
                            F.make_interval(days=(F.col("row_id") % 4).cast("int"))) \
                .withColumn("flag", F.col("row_id") % 2 == 0).drop("cls")
    res = train(df, "y", mode="A", algorithm="LinearRegression", split_keys=["row_id"])
    assert {"when", "flag", "region"} <= set(res.categorical)
    assert any(n.startswith("when_vec_") for n in res.slot_names)


def test_save_load_scores_raw_table(spark, planted):
    path = scratch_path(spark, "model-test")
    res = train(planted, "y", mode="A", algorithm="GBTRegressor", split_keys=["row_id"], save_path=path)
    raw = planted.drop("y")
    a = res.model.transform(raw).select("row_id", "prediction")
    b = load_model(path).transform(raw).select("row_id", "prediction")
    assert a.exceptAll(b).count() == 0 and b.count() == 400


def test_unseen_and_null_category_all_zero(spark, planted):
    res = train(planted.drop("cls"), "y", mode="A", algorithm="LinearRegression", split_keys=["row_id"])
    new = spark.createDataFrame([(9999, 1.0, 1.0, "west"), (10000, 1.0, 1.0, None)],
                                "row_id int, x double, z double, region string")
    from pyspark.ml.functions import vector_to_array
    out = res.model.transform(new).select(vector_to_array(fx.FEATURES).alias("f")).collect()
    names = res.slot_names
    region_slots = [i for i, n in enumerate(names) if n.startswith("region")]
    for r in out:
        assert all(r["f"][i] == 0.0 for i in region_slots)


def test_imputer_uses_double_mean(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, None)], "k int, v int")
    out = {r["k"]: r["v"] for r in fx.impute_mean(df, ["v"]).collect()}
    assert out[4] == pytest.approx(7 / 3)


def test_metrics_match_spark_evaluators(spark):
    from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                       RegressionEvaluator)
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 2)), float(rnd.randint(0, 2)), rnd.random() * 5, rnd.random() * 5,
             round(rnd.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, prediction double, y double, p double, s double")
    m = {r["metric"]: r["value"] for r in ev.classification_metrics(df).collect()}
    for name in ("accuracy", "weightedPrecision", "weightedRecall"):
        ref = MulticlassClassificationEvaluator(metricName=name).evaluate(df)
        assert m[name] == pytest.approx(ref, abs=1e-12)
    r = {x["metric"]: x["value"] for x in ev.regression_metrics(df, "y", "p").collect()}
    for name in ("rmse", "r2"):
        ref = RegressionEvaluator(labelCol="y", predictionCol="p", metricName=name).evaluate(df)
        assert r[name] == pytest.approx(ref, abs=1e-9)
    b = df.withColumn("label", (F.col("label") > 0).cast("double"))
    auc = ev.area_under_roc(b, "label", "s", rows_per_range=60).first()["value"]
    ref = BinaryClassificationEvaluator(rawPredictionCol="s", numBins=0).evaluate(b)
    assert auc == pytest.approx(ref, abs=1e-12)


def test_hash_split_is_partitioning_independent(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = fx.train_test_split(df.repartition(1), ["k"])[0].count()
    b = fx.train_test_split(df.repartition(7), ["k"])[0].count()
    assert a == b and 700 < a < 900


def test_one_hot_long_agrees_with_vector(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", "a"][i % 4]) for i in range(40)], "k int, c string")
    _, idx = fx.index_categorical(df, ["c"])
    enc, vec = fx.one_hot(idx, ["c_idx"])
    long = {(r["k"], r["slot"]) for r in fx.one_hot_long(vec, "c_vec", ["k"]).collect()}
    from pyspark.ml.functions import vector_to_array
    dense = {(r["k"], i) for r in vec.select("k", vector_to_array("c_vec").alias("v")).collect()
             for i, x in enumerate(r["v"]) if x == 1.0}
    assert long == dense


def test_split_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else i % 11, i) for i in range(100)], "k int, v int")
    a, b = fx.train_test_split(df, ["k"])
    assert a.count() + b.count() == 100


def test_all_levels_are_encoded_unless_the_caller_sets_a_limit(spark):
    df = spark.range(10010).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 1001).alias("word"),
                                   (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    res = train(df, "y", mode="A", algorithm="LinearRegression", split_keys=["row_id"])
    assert res.categorical == ["word"] and len(res.slot_names) == 1002
    res = train(df, "y", mode="A", algorithm="LinearRegression", split_keys=["row_id"], max_categories=500)
    assert res.categorical == [] and any("word" in n for n in res.notes)


def test_split_without_keys_keeps_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("v"))
    a, b = fx.train_test_split(df)
    assert a.count() + b.count() == 1000 and 100 < b.count() < 300


def test_awkward_column_names(spark):
    """Names with dots, a source column `prediction`, x beside x__impact, r beside r_vec, a name given twice."""
    rnd = random.Random(3)
    rows = [(i, rnd.random(), rnd.random(), ["u", "v"][i % 2], float(i % 3), ["p", "q", "w"][i % 3], 1.0 * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, `a.b` double, x__impact double, r string, prediction double, r_vec string, `raw``x` double")
    df = df.withColumn("y", 2 * F.col("`a.b`") + F.when(F.col("r") == "u", 5.0).otherwise(1.0) + F.col("prediction"))
    res = train(df, "y", mode="A", algorithm="GBTRegressor", split_keys=["row_id"])
    assert res.numeric == ["a.b", "x__impact", "prediction", "raw`x"] and res.categorical == ["r", "r_vec"]
    assert res.prediction == "prediction_2" and {"prediction", "prediction_2"} <= set(res.predictions.columns)
    assert {"a.b", "x__impact", "prediction", "raw`x", "r_vec_u", "r_vec_v", "r_vec_vec_p"} <= set(res.slot_names)
    assert res.importances.first()["feature"] in ("r_vec_u", "r_vec_v")
    res = train(df, "r", mode="C", features="x__impact, x__impact, a.b", categorical=False, split_keys=["row_id"],
                algorithm="LogisticRegression")
    assert res.numeric == ["x__impact", "a.b"] and "predicted_r" in res.predictions.columns
    path = scratch_path(spark, "awkward")
    res = train(df.withColumnRenamed("y", "t.y"), "t.y", mode="C", features="a.b", categorical=False, algorithm="LinearRegression",
                split_keys=["row_id"], save_path=path)
    assert load_model(path).transform(df).where("prediction_2 is null").count() == 0


def test_feature_of_nulls_and_nans_is_dropped(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"),
                                 F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).alias("w"))
    res = train(df, "y", mode="C", features="x,w", categorical=False, algorithm="LinearRegression", split_keys=["row_id"])
    assert res.numeric == ["x"] and any("no value" in n for n in res.notes)


def test_auc_over_many_ranges(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(4)
    df = spark.createDataFrame([(float(rnd.random() < 0.3), rnd.choice([0.25, 0.5, rnd.random(), rnd.gauss(0, 1)])) for _ in range(4000)],
                               "label double, s double").repartition(5)
    ref = BinaryClassificationEvaluator(rawPredictionCol="s", numBins=0).evaluate(df)
    for rows in (10, 300, 10**6):
        out = ev.area_under_roc(df, "label", "s", rows_per_range=rows)
        assert out.first()["value"] == pytest.approx(ref, abs=1e-12)
    nan = spark.createDataFrame([(1.0, float("nan")), (0.0, 5.0), (0.0, None), (1.0, float("inf")), (0.0, float("-inf"))], "label double, s double")
    assert ev.area_under_roc(nan, "label", "s", rows_per_range=1).first()["value"] == 1.0


def test_hashed_encoding_of_many_levels(spark):
    """A million levels: no list of them in the model, scored after a reload, and the planted signal found."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("it's "), F.col("id")).alias("word"), (F.col("id") % 10).cast("double").alias("x"),
                               F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("group"))
    df = df.withColumn("y", 2 * F.col("x") + F.when(F.col("group") == "g1", 50.0).when(F.col("group").isNull(), -20.0).otherwise(0.0))
    path = scratch_path(spark, "hashed")
    res = train(df, "y", mode="A", algorithm="LinearRegression", split_keys=["row_id"], hash_buckets=64, save_path=path)
    assert res.categorical == ["word", "group"] and len(res.slot_names) <= 1 + 2 * 64
    assert not any(type(s).__name__ == "StringIndexerModel" for s in res.model.stages)
    assert {r["metric"]: r["value"] for r in res.metrics.collect()}["r2"] > 0.99
    new = spark.createDataFrame([(1, "never seen", 3.0, "g1"), (2, None, 3.0, None), (3, "x", 3.0, "other")], "row_id long, word string, x double, `group` string")
    got = {r["row_id"]: r["prediction"] for r in load_model(path).transform(new).collect()}
    assert got[1] == pytest.approx(56, abs=2) and got[2] == pytest.approx(-14, abs=2)
    rep = {r["column"]: r for r in fx.hash_collisions(df, ["word", "group"], 64).collect()}
    assert (rep["word"]["levels"], rep["word"]["used"], rep["word"]["shared"]) == (n, 64, n)
    assert rep["group"]["levels"] == 4 and rep["group"]["used"] + rep["group"]["shared"] // 2 >= 4


def test_sql_and_column_form_of_the_hash_agree(spark):
    from tablesmith.plans.training import Names, build_stages
    df = spark.createDataFrame([("a",), (None,), ("it's",)], "`o'\\\\b` string")
    c = df.columns[0]
    stage = build_stages([], [c], "LinearRegression", None, Names.beside(df.columns, "y"), 97)[0]
    out = stage.transform(df).select("__i0", fx.hash_bucket(c, 97).cast("double").alias("b")).collect()
    assert all(r["__i0"] == r["b"] for r in out)


@pytest.mark.parametrize("algorithm", ["RandomForestRegressor", "RandomForestClassifier"])
def test_forest_rows_are_dealt_into_bounded_parts(spark, monkeypatch, algorithm):
    """A file read by one task must not put all training rows into one part; all rows are learnt, reruns agree."""
    from pyspark.ml import classification, regression
    from tablesmith.operators import train as ops
    kind = getattr(regression, algorithm, None) or getattr(classification, algorithm)
    seen, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, d: (seen.append(
        [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]), fit(self, d))[1])
    monkeypatch.setattr(ops, "RF_TREES", 5)
    monkeypatch.setattr(ops, "TASK_BYTES", 64 << 10, raising=False)  # about 200 rows
    k = F.col("id") % 4
    df = spark.range(0, 2000, 1, 1).select(F.col("id").alias("row_id"), k.alias("x"), F.when(F.col("id") % 3 > 0, "b").alias("c"),
                                           (k * 10.0).alias("y") if "Regressor" in algorithm else F.concat(F.lit("l"), k).alias("y"))
    res = [train(df, "y", mode="C", features="x,c", algorithm=algorithm, split_keys=["row_id"]) for _ in range(2)]
    assert sum(seen[0]) == df.filter(fx.split_flag(["row_id"])).count()
    assert len(seen[0]) > 5 and max(seen[0]) <= 250
    trees = [r.model.stages[-1 if r.labels is None else -2].toDebugString.split("\n", 1)[1] for r in res]
    assert trees[0] == trees[1]


@pytest.mark.parametrize("algorithm", ["GBTRegressor", "GBTClassifier"])
def test_boosted_rows_are_dealt_into_bounded_parts(spark, monkeypatch, algorithm):
    """The other tree learners of train() share the forests' step: no part grows with the table, no row is lost."""
    from pyspark.ml import classification, regression
    from tablesmith.operators import train as ops
    kind = getattr(regression, algorithm, None) or getattr(classification, algorithm)
    seen, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, d: (seen.append(
        [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]), fit(self, d))[1])
    monkeypatch.setattr(ops, "GBT_ITERATIONS", 2)
    monkeypatch.setattr(ops, "TASK_BYTES", 64 << 10, raising=False)  # about 250 rows
    for rows in (1000, 4000):
        k = F.col("id") % 2
        df = spark.range(0, rows, 1, 1).select(F.col("id").alias("row_id"), k.alias("x"), F.when(F.col("id") % 3 > 0, "b").alias("c"),
                                               (k * 10.0).alias("y") if "Regressor" in algorithm else F.concat(F.lit("l"), k).alias("y"))
        train(df, "y", mode="C", features="x,c", algorithm=algorithm, split_keys=["row_id"])
        assert sum(seen[-1]) == df.filter(fx.split_flag(["row_id"])).count()
        assert max(seen[-1]) <= 250
