
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import profile as pr
from tablesmith.operators.corr import corr_matrix, corr_pairs, corr_with_target
from tablesmith.plans.profile import profile
from tablesmith.queries.common import lineitem_nulls
from conftest import SF_MID


def _fixture(spark):
    rows = [(1, None, 5, 5, "a", 1.0), (2, None, 5, None, "b", 2.0), (3, None, 5, 5, None, 3.0)]
    return spark.createDataFrame(rows, "k int, empty double, const int, const_null int, s string, x double")


def test_drop_rules(spark):
    kept, report = pr.drop_empty_constant(_fixture(spark))
    assert {r["column"]: r["reason"] for r in report.collect()} == {"empty": "empty", "const": "constant"}
    assert kept.columns == ["k", "const_null", "s", "x"]  # constant + nulls is kept


def test_one_row_table_is_all_constant(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    _, report = pr.drop_empty_constant(df)
    assert sorted(r["column"] for r in report.collect()) == ["a", "b"]


def test_profile_rows(spark):
    p = {r["column"]: r for r in pr.profile_table(_fixture(spark)).collect()}
    assert p["const_null"]["missing"] == 1 and p["const_null"]["reason"] is None
    assert p["k"]["role"] == "numeric" and p["s"]["role"] == "string"
    assert p["s"]["nonnull"] == 2 and p["k"]["rows"] == 3


def test_bigint_and_decimal_are_numeric(spark):
    df = spark.sql("select cast(1 as bigint) a, cast(2 as smallint) b, cast(3.5 as decimal(5,2)) c, true d, "
                   "date'2024-01-01' e, timestamp'2024-01-01 00:00:00' f")
    roles = {r["column"]: r["role"] for r in pr.profile_table(df).collect()}
    assert roles == {"a": "numeric", "b": "numeric", "c": "numeric", "d": "string", "e": "string", "f": "string"}


def test_distinct_counts_null_is_a_value(spark):
    d = {r["column"]: r["distinct"] for r in pr.distinct_counts(_fixture(spark)).collect()}
    assert d["const_null"] == 2 and d["empty"] == 1 and d["k"] == 3


def test_profile_is_two_aggregations_whatever_the_width(spark):
    """Pass count does not grow with the column count."""
    def jobs_for(ncols):
        df = spark.range(1000).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(ncols)])
        sc = spark.sparkContext
        group = f"prof{ncols}"
        sc.setJobGroup(group, group)
        p = profile(df)
        p.correlations.collect()
        n = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setJobGroup("", "")
        return n
    # AQE runs each shuffle stage as its own job; what matters is that the count is fixed
    assert jobs_for(4) == jobs_for(24) <= 8


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    r = corr_pairs(df, nulls="zero").first()["r"]
    assert r is None
    m = {(x["x"], x["y"]): x["r"] for x in corr_matrix(df).collect()}
    assert m[("a", "a")] is None and m[("b", "b")] == pytest.approx(1.0)


def test_corr_modes_on_lineitem(spark):
    li = lineitem_nulls(spark, SF_MID)
    z = corr_with_target(li, "l_extendedprice", ["l_quantity"], "zero").first()["r"]
    p = corr_with_target(li, "l_extendedprice", ["l_quantity"], "pairwise").first()["r"]
    assert z == pytest.approx(0.0032931, abs=1e-6)
    assert p == pytest.approx(0.0046054, abs=1e-6)


def test_corr_matrix_min_count(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert all(r["r"] == 0.0 for r in corr_matrix(df).collect())


def _gappy(spark, n):
    cell = lambda i: F.when((F.col("id") + i) % 9 != 0, ((F.col("id") * (i + 3)) % 17).cast("double")).otherwise(float("nan"))
    return spark.range(300).select(*[cell(i).alias(f"c{i}") for i in range(n)])


@pytest.mark.parametrize("nulls", ["zero", "pairwise"])
def test_corr_is_the_same_at_every_width(spark, nulls):
    import numpy as np
    d = _gappy(spark, 2).toPandas()
    exp = (d.fillna(0.0) if nulls == "zero" else d.dropna()).corr().iloc[0, 1]
    for n in (2, 48, 49):
        r = corr_pairs(_gappy(spark, n), nulls=nulls).where("a = 'c0' AND b = 'c1'").first()["r"]
        assert np.isclose(r, exp, atol=1e-12)


@pytest.mark.parametrize("n", [8, 60])
def test_corr_reads_its_input_once(spark, n):
    df = _gappy(spark, n)
    for out in (corr_pairs(df), corr_matrix(df, nulls="pairwise"), corr_with_target(df, "c0")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_describe_matches_pandas(spark):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in [1, 2, 3, 4, 10, None]], "v double")
    d = pr.describe(df).first()
    import pandas as pd
    s = pd.Series([1, 2, 3, 4, 10], dtype=float).describe()
    assert d["count"] == 5 and d["mean"] == pytest.approx(s["mean"]) and d["std"] == pytest.approx(s["std"])
    assert (d["q1"], d["median"], d["q3"]) == (s["25%"], s["50%"], s["75%"])


def test_profile_plan_end_to_end_from_csv(spark):
    from tablesmith.plans.profile import correlation_dict
    from tablesmith.session import scratch_path
    from tablesmith.sources import files as fs
    from tablesmith.sources import sinks as sk
    from conftest import SF_SMALL
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    messy = part.select(F.col("p_partkey").alias(" part key"), F.col("p_size").alias("size (cm)"),
                        F.col("p_retailprice").alias("retail-price"), F.col("p_brand").alias("brand"),
                        F.lit(3).alias("const"), F.lit(None).cast("string").alias("empty"))
    path = scratch_path(spark, "profile-csv")
    sk.write_csv(messy, path)
    p = profile(fs.scan_csv(spark, path))
    assert p.dropped == {"const": "constant", "empty": "empty"}
    assert p.table.columns == ["part_key", "size_cm", "retail_price", "brand"]
    assert p.numeric == ["part_key", "size_cm", "retail_price"] and p.string == ["brand"]
    assert p.targets == ["part_key", "size_cm", "retail_price"] and p.can_train
    corr = correlation_dict(p)
    assert set(corr) == {"part_key___size_cm", "part_key___retail_price", "size_cm___retail_price"}
    assert corr["part_key___retail_price"] == pytest.approx(
        part.select(F.corr("p_partkey", "p_retailprice")).first()[0], abs=1e-9)


def test_describe_all_null_column_and_methods_agree(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    d = {r["column"]: r for r in pr.describe(df).collect()}
    assert d["b"]["count"] == 0 and d["b"]["mean"] is None and d["b"]["median"] is None
    m = {r["column"]: r for r in pr.describe(df, method="map").collect()}
    for k in ("count", "mean", "std", "min", "q1", "median", "q3", "max"):
        assert d["a"][k] == pytest.approx(m["a"][k])
