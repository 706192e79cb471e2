"""Operators built to avoid one hot task: results equal brute force on skewed fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import charts as ch
from tablesmith.operators import profile as pr
from tablesmith.operators.quantiles import column_quantiles, grouped_quantiles


def test_quantiles_with_a_hot_group(spark):
    rnd = random.Random(11)
    rows = [("hot", round(rnd.gauss(50, 10), 2)) for _ in range(3000)]
    rows += [("cold", float(v)) for v in (1, 2, 3, 4)] + [("one", 7.0)]
    rows += [("hot", 50.0)] * 500  # a repeated value inside the hot group
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["k"]: r["q"] for r in grouped_quantiles(df, ["k"], "v", probs).collect()}
    for k in ("hot", "cold", "one"):
        vals = np.array([v for kk, v in rows if kk == k])
        assert got[k] == pytest.approx(list(np.quantile(vals, probs)), abs=1e-9)


def test_quantiles_global(spark):
    df = spark.range(1001).select(F.lit(1).alias("g"), (F.col("id") * 3 % 1001).cast("double").alias("v"))
    q = grouped_quantiles(df.drop("g"), [], "v", [0.1, 0.5, 0.9]).first()["q"]
    assert q == pytest.approx([100.0, 500.0, 900.0])


def test_line_positions_are_consecutive_across_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 977).alias("x"), F.col("id").cast("double").alias("y")) \
              .repartition(9)
    got = ch.line_series(df, "x", "y").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(5000))
    keys = [(r["x"], r["y"]) for r in got]
    assert keys == sorted(keys)


def test_boxplot_methods_agree(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice("abc"), float(rnd.randint(0, 100))) for _ in range(2000)],
                               "k string, v double")
    a = {r["key"]: tuple(r)[1:] for r in ch.boxplot(df, "k", "v").collect()}
    b = {r["key"]: tuple(r)[1:] for r in ch.boxplot(df, "k", "v", method="map").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


@pytest.mark.parametrize("groups_in_memory", [50_000, 1])
def test_quantiles_inside_narrow_brackets(spark, groups_in_memory):
    """An accuracy so low that brackets are parts of the range; NULL keys, NaN, infinities, ties."""
    rnd = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [("a", rnd.gauss(0, 5)) for _ in range(4000)] + [("b", float(rnd.randint(0, 3))) for _ in range(3000)]
    rows += [(None, rnd.random()) for _ in range(2500)] + [("c", x) for x in [nan] * 300 + [inf] * 100 + [-inf] * 100 + [1.0] * 900]
    rows += [("d", 7.0)] * 2000 + [("e", None), ("e", 4.0), ("f", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.501, 0.75, 1.0]
    out = grouped_quantiles(df, ["k"], "v", probs, accuracy=100, groups_in_memory=groups_in_memory)
    got = {r["k"]: r for r in out.collect()}
    assert got.keys() == {"a", "b", None, "c", "d", "e"}
    for k, r in got.items():
        vals = np.sort(np.array([v for kk, v in rows if kk == k and v is not None]))  # NaN last
        for p, q in zip(probs, r["q"]):
            at = (len(vals) - 1) * p
            lo, hi = vals[int(np.floor(at))], vals[int(np.ceil(at))]
            want = lo if np.floor(at) == np.ceil(at) else lo * (np.ceil(at) - at) + hi * (at - np.floor(at))
            assert q == pytest.approx(want, abs=1e-9, nan_ok=True)
        assert r["n"] == len(vals)


def test_column_quantiles_equal_the_map_method(spark):
    df = spark.range(6000).select(*[((F.col("id") * (7 + i)) % (911 * (i + 1))).cast("double").alias(f"c{i}") for i in range(4)],
                                  F.lit(None).cast("double").alias("none"))
    a = {r["position"]: r for r in column_quantiles(df, df.columns, [0.25, 0.5, 0.75], accuracy=200).collect()}
    for i, c in enumerate(df.columns[:-1]):
        want = df.select(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
        assert a[i]["q"] == pytest.approx(want)
    assert a[4]["q"] is None and a[4]["n"] == 0


def test_quantiles_shuffle_little_and_store_nothing(spark):
    """The second scan's exchange holds the values inside the brackets only."""
    df = spark.range(200_000).select(F.hash("id").cast("double").alias("v"))
    out = column_quantiles(df, ["v"], [0.25, 0.5, 0.75])
    assert "Exchange" in out._jdf.queryExecution().executedPlan().toString()
    r = df.agg(F.percentile_approx("v", [0.2496, 0.2504], 10_000)).first()[0]
    assert df.where(F.col("v").between(*r)).count() < 0.002 * 200_000


def test_no_rdd_and_no_checkpoint_in_the_operators():
    import glob
    import os
    import tablesmith.operators as ops
    for path in glob.glob(os.path.join(os.path.dirname(ops.__file__), "*.py")):
        text = open(path).read()
        assert ".rdd" not in text and "checkpoint(" not in text, path


def test_line_positions_with_hot_values_nulls_and_text(spark):
    from tablesmith.operators.ranks import numbered
    rnd = random.Random(6)
    rows = [(5 if rnd.random() < 0.6 else rnd.randint(0, 30), rnd.random()) for _ in range(3000)]
    rows += [(None, 1.0), (None, None), (5, None), (5, float("nan")), (5, 0.5), (5, 0.5)]
    df = spark.createDataFrame(rows, "x int, y double").repartition(4)
    for d in (df, df.select((F.col("x") * F.lit(0.5)).alias("x"), "y"), df.select(F.concat(F.lit("same beginning "), F.format_string("%03d", "x")).alias("x"), "y"),
              df.select(F.timestamp_seconds("x").alias("x"), "y"), df.select(F.array("x").alias("x"), "y")):
        got = numbered(d, "x", "y", "pos", rows_per_range=100).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(len(rows)))
        want = d.orderBy(F.col("x").asc_nulls_first(), F.col("y").asc_nulls_first()).collect()
        assert [(r["x"], repr(r["y"])) for r in got] == [(r["x"], repr(r["y"])) for r in want]
    assert numbered(df.limit(0), "x", "y", "pos").count() == 0


def test_line_pixels_draw_the_same_line(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 999), rnd.gauss(0, 3)) for _ in range(5000)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "x int, y double").repartition(3)
    pts = [(x, y) for x, y in rows if x is not None]
    lo, hi = min(x for x, _ in pts), max(x for x, _ in pts)
    want = set()
    for p in range(20):
        inside = [(x, y) for x, y in pts if min(int((x - lo) / (hi - lo) * 20), 19) == p]
        want |= {(p, *q) for q in (min(inside), max(inside), min(inside, key=lambda t: (t[1], t[0])), min(inside, key=lambda t: (-t[1], t[0])))}
    got = ch.line_pixels(df, "x", "y", 20).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) <= 80
    one = spark.createDataFrame([(4, 1.0), (4, 3.0)], "x int, y double")
    assert {tuple(r) for r in ch.line_pixels(one, "x", "y", 5).collect()} == {(0, 4, 1.0), (0, 4, 3.0)}
    assert ch.line_pixels(one.limit(0), "x", "y", 5).count() == 0
    with pytest.raises(ValueError):
        ch.line_pixels(spark.createDataFrame([("a", 1.0)], "x string, y double"), "x", "y", 5)


def test_scatter_tiles_roll_up(spark):
    rnd = random.Random(1)
    pts = [(rnd.random() ** 2, rnd.gauss(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(pts + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    got = ch.scatter_tiles(df, "x", "y", levels=5, nulls="skip").collect()
    by_level = {}
    for r in got:
        by_level.setdefault(r["level"], {})[r["ix"], r["iy"]] = r["n"]
    assert {k: sum(v.values()) for k, v in by_level.items()} == {k: 3000 for k in range(6)}
    for k in range(5):
        for (i, j), n in by_level[k].items():
            assert n == sum(m for (a, b), m in by_level[k + 1].items() if (a >> 1, b >> 1) == (i, j))
    assert ch.scatter_tiles(df.limit(0), "x", "y").count() == 0
    one = ch.scatter_tiles(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double"), "x", "y", levels=2)
    assert {tuple(r) for r in one.collect()} == {(0, 0, 0, 3), (1, 0, 0, 3), (2, 0, 0, 3)}


def test_histogram_rules(spark):
    rnd = random.Random(12)
    vals = [rnd.gauss(10, 2) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "v double")
    h = ch.histogram_width_bins(df, "v", nulls="skip").orderBy("bin").collect()
    q = np.quantile(vals, [0.25, 0.75])
    want = int(np.ceil((max(vals) - min(vals)) / (2 * (q[1] - q[0]) / 2000 ** (1 / 3))))
    assert len(h) == want and sum(r["n"] for r in h) == 2000
    e = ch.histogram_equal_depth(df, "v", 8, nulls="skip").orderBy("bin").collect()
    assert [r["n"] for r in e] == [250] * 8
    assert [r["lo"] for r in e] + [e[-1]["hi"]] == pytest.approx(list(np.quantile(vals, [i / 8 for i in range(9)])))
    same = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert [tuple(r) for r in ch.histogram_equal_depth(same, "v", 4).collect()] == [(0, 3.0, 3.0, 5)]
    assert ch.histogram_width_bins(same, "v").collect()[0]["n"] == 5
    assert ch.histogram_equal_depth(same.limit(0), "v").count() == 0 and ch.histogram_width_bins(same.limit(0), "v").count() == 0


def test_distinct_state_is_added_without_the_first_batch(spark):
    from tablesmith.operators import distinct as di
    rnd = random.Random(5)
    def table(n, seed):
        rnd.seed(seed)
        rows = [(rnd.randint(0, 70_000), rnd.choice([None, rnd.randint(-10**15, 10**15)]), rnd.choice([0.0, -0.0, float("nan"), 1.5, None]),
                 rnd.choice(["a", "b", None, "", str(rnd.randint(0, 50))]), None, rnd.random() < 0.5) for _ in range(n)]
        return rows, spark.createDataFrame(rows, "dense int, sparse long, d double, s string, none date, flag boolean").repartition(3)
    (r1, d1), (r2, d2) = table(900, 1), table(700, 2)
    key = lambda v: "nan" if isinstance(v, float) and v != v else v + 0.0 if isinstance(v, float) else v
    want = {c: len({key(r[i]) for r in r1 + r2 if r[i] is not None}) for i, c in enumerate(d1.columns)}
    first = di.distinct_state(d1)
    assert di.bitmap_columns(d1) == ["dense", "flag"]
    both = di.added(first, d2)
    got = {r["column"]: (r["values"], r["has_null"]) for r in di.counts(both, d1.schema).collect()}
    assert got == {c: (want[c], any(r[i] is None for r in r1 + r2)) for i, c in enumerate(d1.columns)}
    again = di.counts(di.added(both, d2), d1.schema)
    assert {r["column"]: r["values"] for r in again.collect()} == want
    sketch = di.merged_sketches(di.sketch_state(d1), di.sketch_state(d2))
    for r in di.sketch_counts(sketch, d1.schema).collect():
        assert abs(r["values"] - want[r["column"]]) <= 0.05 * want[r["column"]] + 1
    plan = pr.distinct_counts(d1)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert {r["distinct"] for r in pr.distinct_counts(d1.limit(0)).collect()} == {0}


def test_comoment_tiles(spark):
    from tablesmith.operators import comoments as cm
    n = 70  # three tiles a side
    cells = [F.when((F.col("id") + i) % 11 != 0, ((F.col("id") * (i + 3)) % 101).cast("double")) for i in range(n)]
    df = spark.range(900, numPartitions=9).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    got = {(r["i"], r["j"]): r for r in cm.pearson_from_moments(cm.pair_moments(df, df.columns, nulls="pairwise")).collect()}
    want = df.toPandas().corr()
    assert got.keys() == {(i, j) for i in range(n) for j in range(i, n)}
    for (i, j), r in got.items():
        assert r["r"] == pytest.approx(want.iloc[i, j], abs=1e-10)
    one = cm.pair_moments(df, df.columns, ["c3"], "pairwise").collect()
    assert {(r["i"], r["j"]) for r in one} == {(i, 0) for i in range(n)}
    assert all(r["c"] == pytest.approx(got[min(r["i"], 3), max(r["i"], 3)]["c"], abs=1e-6) for r in one)


def test_comoment_tree_merges_many_partitions(spark, monkeypatch):
    from tablesmith.operators import comoments as cm
    monkeypatch.setattr(cm, "FAN_IN", 3)
    df = spark.range(400, numPartitions=40).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    r = cm.pearson_from_moments(cm.pair_moments(df, ["a", "b"])).where("i = 0 and j = 1").first()["r"]
    assert r == pytest.approx(df.select(F.corr("a", "b")).first()[0], abs=1e-12)


def test_ranges_are_even_and_follow_the_size(spark):
    """Ranges of many different scores hold about as many rows each, so windows over them have even tasks."""
    from tablesmith.operators.ranks import cut_points, range_of
    df = spark.range(400_000).select((F.hash("id") / 7919.0).alias("s"))
    for per_range, least in ((4_000, 90), (20_000, 18)):
        cuts = cut_points(df, "s", per_range)
        sizes = sorted(r["count"] for r in range_of(df, "s", cuts, "r").groupBy("r").count().collect())
        assert len(sizes) >= least and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert cut_points(df.limit(10), "s") == []
