import pytest
from pyspark.sql import functions as F

from tablesmith.operators import charts as ch
from tablesmith.plans.chart import ChartSpec, chart_data


@pytest.fixture
def mixed(spark):
    rows = [("a", "1"), ("a", " 2 "), ("b", "x"), (None, "4"), ("", ""), ("c", "abc")]
    return spark.createDataFrame(rows, "k string, v string")


def test_bar_aggregates_and_missing_bucket(spark, mixed):
    got = {r["key"]: r["value"] for r in ch.bar(mixed, "k", "v", "sum").collect()}
    assert got == {"a": 3.0, "b": 0.0, "__MISSING__": 4.0, "c": 0.0}
    mean = {r["key"]: r["value"] for r in ch.bar(mixed, "k", "v", "mean").collect()}
    assert mean["b"] is None and mean["__MISSING__"] == 2.0  # 4 and blank (=0)
    cnt = {r["key"]: r["value"] for r in ch.bar(mixed, "k", "v", "count").collect()}
    assert cnt["b"] == 0.0 and cnt["a"] == 2.0
    mx = {r["key"]: r["value"] for r in ch.bar(mixed, "k", "v", "max").collect()}
    assert mx["c"] is None


def test_top_n_orders_and_breaks_ties(spark, mixed):
    rows = ch.bar(mixed, "k", "v", "sum", n=2).collect()
    assert [(r["key"], r["value"]) for r in rows] == [("__MISSING__", 4.0), ("a", 3.0)]


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    h = ch.histogram(df, "v", bins=4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 0, 0]


def test_histogram_counts_all_rows(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    h = ch.histogram(df, "v", bins=10).collect()
    assert sum(r["n"] for r in h) == 100 and len(h) == 10


def test_boxplot_linear_interpolation(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4]], "k string, v double")
    r = ch.boxplot(df, "k", "v").first()
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"]) == (1.0, 1.75, 2.5, 3.25, 4.0)


def test_vote(spark, mixed):
    roles = {r["column"]: r["role"] for r in ch.infer_numeric_vote(mixed).collect()}
    assert roles == {"k": "categorical", "v": "numeric"}  # v: 4 of 6 read as numbers


def test_grouped_bar_pivot(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "k string, g string, v double")
    p = {r["key"]: r.asDict() for r in ch.grouped_bar(df, "k", "g", "v", pivot_values=["x", "y"]).collect()}
    assert p["a"]["x"] == 1.0 and p["a"]["y"] == 2.0 and p["b"]["y"] is None


def test_chart_dispatch_and_checks(spark, mixed):
    assert chart_data(mixed, ChartSpec("pie", x="k")).count() == 4
    with pytest.raises(ValueError):
        chart_data(mixed, ChartSpec("histogram", x="k"))
    with pytest.raises(ValueError):
        chart_data(mixed, ChartSpec("bar", x="k"))
    df = spark.createDataFrame([(1.0, 2.0, "3"), (2.0, 4.1, "x"), (3.0, 6.3, "5")], "a double, b double, c string")
    hm = chart_data(df, ChartSpec("heatmap"))
    assert hm.count() == 9


def test_chart_on_ordered_sample(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("k"),
                                 F.col("id").cast("double").alias("v"))
    spec = ChartSpec("bar", x="k", y="v", agg="count", sample_rows=10, order_by=["id"])
    got = {r["key"]: r["value"] for r in chart_data(df, spec).collect()}
    assert got == {"0": 4.0, "1": 3.0, "2": 3.0}
    with pytest.raises(ValueError):
        chart_data(df, ChartSpec("bar", x="k", y="v", sample_rows=10))


def test_histogram_with_known_range(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    a = [tuple(r) for r in ch.histogram(df, "v", bins=5).orderBy("bin").collect()]
    b = [tuple(r) for r in ch.histogram(df, "v", bins=5, value_range=(0.0, 99.0)).orderBy("bin").collect()]
    assert a == b


def test_chart_reductions_through_the_spec(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("x"), (F.col("id") % 17).cast("double").alias("y"))
    assert chart_data(df, ChartSpec("line", x="x", y="y", width=10)).count() <= 40
    assert chart_data(df, ChartSpec("scatter", x="x", y="y", levels=2)).where("level = 0").first()["n"] == 500
    assert [r["n"] for r in chart_data(df, ChartSpec("histogram", x="x", bins=5, rule="depth")).orderBy("bin").collect()] == [100] * 5
    assert chart_data(df, ChartSpec("histogram", x="x", rule="width")).agg(F.sum("n")).first()[0] == 500
    with pytest.raises(ValueError):
        chart_data(df, ChartSpec("histogram", x="x", rule="other"))
