import pytest
from pyspark.sql import functions as F

from tablesmith.session import scratch_path
from tablesmith.sources import csv_checked as cc


def _files(spark, *texts):
    import os
    path = scratch_path(spark, "checked").removeprefix("file:")
    os.makedirs(path)
    for i, t in enumerate(texts):
        with open(f"{path}/{i}.csv", "w") as f:
            f.write(t)
    return path


CLEAN = [
    "i,l,d,x,b,s,day,ts,none\n1,3000000000,123456789012345678901,1.5,true,a,2024-01-05,2024-01-05 10:00:00,\n-2,4,5,1e3,FALSE,,1999-12-31,1999-12-31T01:02:03,\n",
    "a,b,c\n1,2.5,2024-01-01\n2,3,2024-01-01 05:06:07\n,,\n",
    "a,b\n1,x\n2024-01-01,true\n",
    "a\n007\n+5\n",
    "a,b\n\"x, y\",\"1\"\n\"q \"\"z\"\"\",2\n",
    "a,b\nNaN,Infinity\n1,-Inf\n",
    "a,b\n",
]


@pytest.mark.parametrize("k", range(len(CLEAN)))
def test_types_equal_sparks_on_clean_input(spark, k):
    path = _files(spark, CLEAN[k])
    res = cc.scan_csv_checked(spark, path)
    want = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert res.rows.schema == want.schema == res.schema
    assert res.broken.count() == res.n_broken == 0 and res.n_rows == want.count()
    assert sorted(map(str, res.rows.collect())) == sorted(map(str, want.collect()))


def test_broken_rows_come_back_and_none_is_lost(spark):
    path = _files(spark, "i,x,n\n1,2.5,abc\n3,4.5,z,extra\n4\n\n6,,\n", "i,x,n\n7,8,abc\n9,oops\n")
    res = cc.scan_csv_checked(spark, path)
    assert res.rows.schema.simpleString() == "struct<i:int,x:double,n:string>"  # broken rows have no say
    assert sorted(tuple(r) for r in res.rows.collect() if r["x"] is not None) == [(1, 2.5, "abc"), (7, 8.0, "abc")]
    assert sorted(r["line"] for r in res.broken.collect()) == ["3,4.5,z,extra", "4", "9,oops"]
    assert (res.n_rows, res.n_broken) == (3, 3) and res.rows.count() == 3
    assert res.rows.select("i").count() == 3  # a narrow read finds the same rows


def test_wide_table_and_options(spark):
    names = [f"c{i}" for i in range(230)]
    path = _files(spark, ";".join(names) + "\n" + ";".join(map(str, range(230))) + "\n")
    res = cc.scan_csv_checked(spark, path, sep=";")
    assert {t for _, t in res.rows.dtypes} == {"int"} and res.n_rows == 1
    assert res.rows.agg(F.sum("c229")).first()[0] == 229
