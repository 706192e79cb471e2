"""Registered queries: feature preparation (2.H), training and evaluation (2.I),
model sink and scoring (2.A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablesmith.operators import evaluate as ev
from tablesmith.operators import features as fx
from tablesmith.operators.train import make_estimator
from tablesmith.plans.training import report, train
from tablesmith.queries.common import LI_NULLS_SQL, T, lineitem_nulls, r6
from tablesmith.session import scratch_path
from tablesmith.sources import sinks as sk

QUERIES: dict = {}
ORACLE: dict = {}


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _rank_sql(table, col):
    return (f"(SELECT {col} AS v, row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 AS idx "
            f"FROM {table} GROUP BY {col})")


# ---------------------------------------------------------------- 2.H features

@q("index_label", f"""SELECT c_custkey, c_mktsegment, CAST(f.idx AS DOUBLE) AS label
FROM customer JOIN {_rank_sql('customer', 'c_mktsegment')} f ON c_mktsegment = f.v""")
def index_label(spark, sf):
    _, df = fx.index_label(T(spark, sf, "customer"), "c_mktsegment", out="label")
    return df.select("c_custkey", "c_mktsegment", "label")


LI_NUM_FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@q("select_all", f"SELECT {', '.join(LI_NUM_FEATS)}, l_extendedprice FROM lineitem")
def select_all(spark, sf):
    li = T(spark, sf, "lineitem")
    num, cat = fx.select_all(li, "l_extendedprice", categorical=False)
    return li.select(*num, *cat, "l_extendedprice")


def _zero_corr(a, y, src):
    e = f"corr(coalesce(CAST({a} AS DOUBLE), 0), coalesce(CAST({y} AS DOUBLE), 0))"
    return f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END"


SEL_CORR_SQL = f"""WITH r AS (
  SELECT 'p_partkey' AS feature, {_zero_corr('p_partkey', 'p_retailprice', 'part')} AS r FROM part
  UNION ALL SELECT 'p_size', {_zero_corr('p_size', 'p_retailprice', 'part')} FROM part)
SELECT feature, round(r, 6) AS r,
  coalesce(abs(r) >= 0.2, false) OR NOT max(coalesce(abs(r) >= 0.2, false)) OVER () AS selected FROM r"""


@q("select_by_corr", SEL_CORR_SQL)
def select_by_corr(spark, sf):
    part = T(spark, sf, "part")
    cands = fx.numeric_candidates(part, "p_retailprice")
    s = fx.selection_by_corr(part, "p_retailprice", cands, fx.CORR_THRESHOLD, "zero")
    return s.select("feature", r6(F.col("r")).alias("r"), "selected")


@q("select_custom", "SELECT l_quantity, l_discount, l_returnflag, l_extendedprice FROM lineitem")
def select_custom(spark, sf):
    li = T(spark, sf, "lineitem")
    num, cat, _ = fx.select_custom(li, "l_extendedprice", "l_quantity, l_discount ,, l_returnflag, nope", True)
    return li.select(*num, *cat, "l_extendedprice")


@q("impute_mean", f"""SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, avg(l_quantity) OVER ()), 8) AS l_quantity,
  round(coalesce(l_extendedprice, avg(l_extendedprice) OVER ()), 8) AS l_extendedprice FROM {LI_NULLS_SQL}""")
def impute_mean(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = fx.impute_mean(li, ["l_quantity", "l_extendedprice"])
    # means of 2-decimal values can end on a 6th-decimal tie: round at 8
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 8).alias("l_quantity"),
                      F.round("l_extendedprice", 8).alias("l_extendedprice"))


@q("index_categorical", f"""SELECT p_partkey, CAST(b.idx AS DOUBLE) AS p_brand_idx, CAST(t.idx AS DOUBLE) AS p_type_idx
FROM part JOIN {_rank_sql('part', 'p_brand')} b ON p_brand = b.v JOIN {_rank_sql('part', 'p_type')} t ON p_type = t.v""")
def index_categorical(spark, sf):
    _, df = fx.index_categorical(T(spark, sf, "part"), ["p_brand", "p_type"])
    return df.select("p_partkey", "p_brand_idx", "p_type_idx")


@q("one_hot", f"""SELECT p_partkey, 'p_type' AS "column", CAST(t.idx AS INTEGER) AS slot, CAST(1.0 AS DOUBLE) AS value
FROM part JOIN {_rank_sql('part', 'p_type')} t ON p_type = t.v""")
def one_hot(spark, sf):
    _, idx = fx.index_categorical(T(spark, sf, "part"), ["p_type"])
    _, df = fx.one_hot(idx, ["p_type_idx"])
    return fx.one_hot_long(df, "p_type_vec", ["p_partkey"], "p_type")


@q("assemble_features", f"""SELECT p_partkey, 0 AS slot, 'p_size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size <> 0
UNION ALL SELECT p_partkey, 1, 'p_retailprice', p_retailprice FROM part WHERE p_retailprice <> 0
UNION ALL SELECT p_partkey, CAST(2 + t.idx AS INTEGER), 'p_type_vec_' || p_type, CAST(1.0 AS DOUBLE)
FROM part JOIN {_rank_sql('part', 'p_type')} t ON p_type = t.v""")
def assemble_features(spark, sf):
    _, idx = fx.index_categorical(T(spark, sf, "part"), ["p_type"])
    _, enc = fx.one_hot(idx, ["p_type_idx"])
    vec = fx.assemble_features(enc, ["p_size", "p_retailprice", "p_type_vec"])
    names = ev.slot_names(vec, fx.FEATURES)
    return fx.vector_long(vec, fx.FEATURES, ["p_partkey"], names)


@q("train_test_split", """SELECT o_orderkey,
  CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 800
       THEN 'train' ELSE 'test' END AS part FROM orders""")
def train_test_split(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey")
    fit, test = fx.train_test_split(o, ["o_orderkey"], 0.8)
    return fit.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# ---------------------------------------------------------------- 2.I training

def _lr_on_lineitem(spark, sf):
    li = T(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    vec = fx.assemble_features(li.withColumn(fx.LABEL, F.col("l_extendedprice")), ["l_quantity"])
    return make_estimator("LinearRegression").fit(vec), ev.slot_names(vec, fx.FEATURES)


@q("fit_linear_regression", """SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem
UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem""")
def fit_linear_regression(spark, sf):
    model, names = _lr_on_lineitem(spark, sf)
    rows = [(names[0], round(float(model.coefficients[0]), 4)), ("intercept", round(float(model.intercept), 4))]
    return spark.createDataFrame(rows, "term string, value double")


@q("model_coefficients", "SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem")
def model_coefficients(spark, sf):
    model, names = _lr_on_lineitem(spark, sf)
    return ev.model_coefficients(spark, model, names).select("feature", F.round("value", 4).alias("value"))


def _parts_sql(table, key, cols):
    """The source with its training flag, by the split rule of the library."""
    return (f"s AS (SELECT {key}, {cols}, CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 800 "
            f"AS in_train FROM {table})")


# Models whose result SQL can state: a line through one feature, means of a feature's levels, rules of a feature.

LINE_SQL = f"""WITH {_parts_sql('part', 'p_partkey', 'p_retailprice')},
m AS (SELECT regr_slope(p_retailprice, p_partkey) AS a, regr_intercept(p_retailprice, p_partkey) AS b,
      avg(p_partkey) AS mean FROM s WHERE in_train)"""


def _line(spark, sf, **kw):
    return train(T(spark, sf, "part"), "p_retailprice", mode="C", features="p_partkey", algorithm="LinearRegression",
                 categorical=False, split_keys=["p_partkey"], **kw)


def _line_terms(spark, model):
    """(term, value) of a fitted pipeline: the imputer's mean, the slope, the intercept."""
    mean, line = model.stages[1].surrogateDF.first()[0], model.stages[-1]
    rows = [("mean", float(mean)), ("slope", float(line.coefficients[0])), ("intercept", float(line.intercept))]
    return spark.createDataFrame(rows, "term string, value double").select("term", F.round("value", 6).alias("value"))


LINE_TERMS_SQL = LINE_SQL + """
SELECT 'mean' AS term, round(mean, 6) AS value FROM m UNION ALL SELECT 'slope', round(a, 6) FROM m
UNION ALL SELECT 'intercept', round(b, 6) FROM m"""


def _size_model(spark, sf, target, algo):
    size = (F.col("p_size") % 4).alias("size_class")
    d = T(spark, sf, "part").select("p_partkey", size, "p_retailprice", (size * 10.0).alias("grade"))
    return train(d.select("p_partkey", "size_class", target), target, mode="C", features="size_class", algorithm=algo,
                 categorical=False, split_keys=["p_partkey"])


@q("fit_rf_regressor", f"""WITH {_parts_sql('part', 'p_partkey', 'CAST(p_size % 4 * 10 AS DOUBLE) AS grade')}
SELECT p_partkey, grade AS __label, grade AS prediction FROM s WHERE NOT in_train""")
def fit_rf_regressor(spark, sf):
    res = _size_model(spark, sf, "grade", "RandomForestRegressor")
    return res.predictions.select("p_partkey", fx.LABEL, r6(F.col("prediction")).alias("prediction"))


# A planted table: the price depends on a small number and a two-level text; a third column does not matter.
CELLS = ("p_size % 4 AS size_class, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS shape, p_partkey % 97 AS noise, "
         "p_retailprice + 400.0 * (p_size % 4) + CASE WHEN p_size > 25 THEN 300.0 ELSE 0.0 END AS price")
CELLS_SQL = f"""WITH {_parts_sql('part', 'p_partkey', CELLS)},
m AS (SELECT size_class, shape, avg(price) AS mean FROM s WHERE in_train GROUP BY ALL),
p AS (SELECT p_partkey, price, mean FROM s JOIN m USING (size_class, shape) WHERE NOT in_train)"""


def _cells_model(spark, sf):
    """Mode B on the planted table: correlation keeps size_class and drops noise, the text is indexed and encoded."""
    d = T(spark, sf, "part").selectExpr("p_partkey", *CELLS.split(", "))
    return train(d, "price", mode="B", algorithm="GBTRegressor", split_keys=["p_partkey"])


@q("fit_gbt_regressor", CELLS_SQL + "\nSELECT p_partkey, price AS __label, round(mean, 4) AS prediction FROM p")
def fit_gbt_regressor(spark, sf):
    res = _cells_model(spark, sf)
    return res.predictions.select("p_partkey", fx.LABEL, F.round("prediction", 4).alias("prediction"))


@q("fit_logistic_regression", f"""WITH {_parts_sql('orders', 'o_orderkey', """(o_orderstatus = 'F')::INT AS finished,
      CASE WHEN o_totalprice >= 200000 THEN 'large' ELSE 'small' END AS size""")},
pos AS (SELECT size FROM s GROUP BY size ORDER BY count(*), size DESC LIMIT 1),
o AS (SELECT finished, ln(count(*) FILTER (s.size = pos.size) / count(*) FILTER (s.size <> pos.size)) AS odds
      FROM s, pos WHERE in_train GROUP BY finished)
SELECT 'finished' AS term, round(a.odds - b.odds, 4) AS value FROM o a, o b WHERE a.finished = 1 AND b.finished = 0
UNION ALL SELECT 'intercept', round(odds, 4) FROM o WHERE finished = 0""")
def fit_logistic_regression(spark, sf):
    d = T(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
        F.when(F.col("o_totalprice") >= 200000, "large").otherwise("small").alias("size"))
    res = train(d, "size", mode="C", features="finished", algorithm="LogisticRegression", categorical=False,
                split_keys=["o_orderkey"])
    line = res.model.stages[-2]
    rows = [("finished", float(line.coefficients[0])), ("intercept", float(line.intercept))]
    return spark.createDataFrame(rows, "term string, value double").select("term", F.round("value", 4).alias("value"))


def _bands(spark, sf, table, key, source, algo):
    zone = F.col(source) % 4
    d = T(spark, sf, table).select(key, zone.alias("zone"), F.when(zone == 1, "high").when(
        zone == 3, "middle").otherwise("low").alias("band"))
    return train(d, "band", mode="C", features="zone", algorithm=algo, categorical=False, split_keys=[key])


def _bands_sql(table, key, source, middle):
    band = f"CASE {source} % 4 WHEN 1 THEN 'high' WHEN 3 THEN '{middle}' ELSE 'low' END AS band"
    return f"WITH {_parts_sql(table, key, band)} SELECT {key}, band, band AS predicted_band FROM s WHERE NOT in_train"


@q("fit_rf_classifier", _bands_sql("customer", "c_custkey", "c_nationkey", "middle"))
def fit_rf_classifier(spark, sf):
    res = _bands(spark, sf, "customer", "c_custkey", "c_nationkey", "RandomForestClassifier")
    return res.predictions.select("c_custkey", "band", "predicted_band")


@q("fit_gbt_classifier", """WITH s AS (SELECT doc_id, quality, regexp_matches(coalesce(text, ''), '[#$%&*|<>]')::INT AS marked,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 800 AS in_train FROM documents JOIN labels USING (doc_id)),
m AS (SELECT marked, (avg(quality) > 0.5)::INT::VARCHAR AS predicted_quality FROM s WHERE in_train GROUP BY marked)
SELECT doc_id, quality, predicted_quality FROM s JOIN m USING (marked) WHERE NOT in_train""")
def fit_gbt_classifier(spark, sf):
    """Labelled quality from whether a text holds marks: what most training documents of its kind have."""
    marked = F.coalesce(F.col("text"), F.lit("")).rlike("[#$%&*|<>]").cast("int").alias("marked")
    d = T(spark, sf, "documents").select("doc_id", marked).join(T(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    res = train(d, "quality", mode="C", task="classification", features="marked", algorithm="GBTClassifier", categorical=False,
                split_keys=["doc_id"])
    return res.predictions.select("doc_id", "quality", "predicted_quality")


@q("fit_pipeline", LINE_TERMS_SQL)
def fit_pipeline(spark, sf):
    return _line_terms(spark, _line(spark, sf).model)


@q("predict", LINE_SQL + """
SELECT p_partkey, p_retailprice AS __label, round(a * p_partkey + b, 4) AS prediction FROM s, m WHERE NOT in_train""")
def predict(spark, sf):
    return _line(spark, sf).predictions.select("p_partkey", fx.LABEL, F.round("prediction", 4).alias("prediction"))


# How much of the label each feature explains on its own decides the order of the importances.
@q("feature_importance", f"""WITH {_parts_sql('part', 'p_partkey', "p_size % 4 AS x1, p_partkey % 5 AS x2, p_partkey % 3 AS x3, 9.0 * (p_size % 4) + 3.0 * (p_partkey % 5) + 1.0 * (p_partkey % 3) AS y")},
r AS (SELECT 'x1' AS feature, corr(x1, y) AS r FROM s WHERE in_train UNION ALL SELECT 'x2', corr(x2, y) FROM s WHERE in_train
      UNION ALL SELECT 'x3', corr(x3, y) FROM s WHERE in_train)
SELECT feature, row_number() OVER (ORDER BY abs(r) DESC) AS place, true AS positive FROM r""")
def feature_importance(spark, sf):
    d = T(spark, sf, "part").selectExpr("p_partkey", "p_size % 4 AS x1", "p_partkey % 5 AS x2", "p_partkey % 3 AS x3",
                                        "9.0 * (p_size % 4) + 3.0 * (p_partkey % 5) + 1.0 * (p_partkey % 3) AS y")
    res = train(d, "y", mode="C", features="x1,x2,x3", algorithm="RandomForestRegressor", categorical=False, split_keys=["p_partkey"])
    place = F.row_number().over(Window.orderBy(F.desc("value"))).cast("bigint")  # one row a feature
    return res.importances.select("feature", place.alias("place"), (F.col("value") > 0).alias("positive"))


@q("train_report", CELLS_SQL + """
SELECT * FROM (VALUES ('model', 'algorithm', 'GBTRegressor'), ('model', 'task', 'regression'), ('model', 'name', 'prices')) AS v(section, name, value)
UNION ALL SELECT 'metric', 'rmse', printf('%.4f', sqrt(avg((price - mean) * (price - mean)))) FROM p
UNION ALL SELECT 'metric', 'r2', printf('%.4f', 1 - sum((price - mean) * (price - mean)) / (var_pop(price) * count(*))) FROM p
UNION ALL SELECT 'importance', n, 'listed' FROM (VALUES ('size_class'), ('shape_vec_big'), ('shape_vec_small')) AS f(n)""")
def train_report(spark, sf):
    rows = report(_cells_model(spark, sf), "prices")
    number = F.format_string("%.4f", F.expr("try_cast(value AS double)"))
    return rows.select("section", "name", F.when(F.col("section") == "metric", number).when(
        F.col("section") == "importance", "listed").otherwise(F.col("value")).alias("value"))


@q("sink_model", LINE_TERMS_SQL)
def sink_model(spark, sf):
    path = sk.model_path(scratch_path(spark, "models"), owner=7, name="part_price")
    return _line_terms(spark, sk.load_model(_line(spark, sf, save_path=path).path))


@q("score_saved_model", LINE_SQL + "\nSELECT p_partkey, round(a * p_partkey + b, 4) AS prediction FROM s, m")
def score_saved_model(spark, sf):
    path = scratch_path(spark, "model")
    _line(spark, sf, save_path=path)
    scored = sk.load_model(path).transform(T(spark, sf, "part"))
    return scored.select("p_partkey", F.round("prediction", 4).alias("prediction"))


# ---------------------------------------------------------------- evaluators on rule-based predictions

REG_SRC = "(SELECT l_extendedprice AS y, l_quantity * 1400.0 AS p FROM lineitem)"


def _reg_preds(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1400.0).alias("prediction"))


@q("eval_rmse", f"SELECT 'rmse' AS metric, round(sqrt(avg((y - p) * (y - p))), 6) AS value FROM {REG_SRC}")
def eval_rmse(spark, sf):
    return ev.regression_metrics(_reg_preds(spark, sf), metrics=("rmse",)).select("metric", r6(F.col("value")).alias("value"))


@q("eval_r2", f"SELECT 'r2' AS metric, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS value FROM {REG_SRC}")
def eval_r2(spark, sf):
    return ev.regression_metrics(_reg_preds(spark, sf), metrics=("r2",)).select("metric", r6(F.col("value")).alias("value"))


CLS_SQL = """WITH d AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END AS label,
  CASE WHEN o_totalprice >= 250000 THEN 0.0 WHEN o_totalprice >= 100000 THEN 1.0 ELSE 2.0 END AS prediction FROM orders),
conf AS (SELECT label, prediction, count(*) AS n FROM d GROUP BY 1, 2),
pl AS (SELECT label, sum(n) AS c, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM conf GROUP BY 1),
pp AS (SELECT prediction AS label, sum(n) AS pr FROM conf GROUP BY 1)"""


def _cls_preds(spark, sf):
    o = T(spark, sf, "orders")
    label = (F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0))
    pred = (F.when(F.col("o_totalprice") >= 250000, 0.0).when(F.col("o_totalprice") >= 100000, 1.0).otherwise(2.0))
    return o.select(label.alias("label"), pred.alias("prediction"))


def _cls(metric):
    def run(spark, sf):
        m = ev.classification_metrics(_cls_preds(spark, sf), metrics=(metric,))
        return m.select("metric", r6(F.col("value")).alias("value"))
    return run


QUERIES["eval_accuracy"] = _cls("accuracy")
ORACLE["eval_accuracy"] = CLS_SQL + "\nSELECT 'accuracy' AS metric, round(sum(tp) / sum(c), 6) AS value FROM pl"
QUERIES["eval_weighted_precision"] = _cls("weightedPrecision")
ORACLE["eval_weighted_precision"] = CLS_SQL + ("\nSELECT 'weightedPrecision' AS metric, "
                                               "round(sum(c * coalesce(tp / pr, 0)) / sum(c), 6) AS value "
                                               "FROM pl LEFT JOIN pp USING (label)")
QUERIES["eval_weighted_recall"] = _cls("weightedRecall")
ORACLE["eval_weighted_recall"] = CLS_SQL + "\nSELECT 'weightedRecall' AS metric, round(sum(tp) / sum(c), 6) AS value FROM pl"


@q("eval_auc", """WITH d AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS s FROM orders),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d)
SELECT 'auc' AS metric, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0)
  / (sum(y) * (count(*) - sum(y))), 6) AS value FROM r""")
def eval_auc(spark, sf):
    o = T(spark, sf, "orders")
    d = o.select((F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("score"))
    return ev.area_under_roc(d, "label", "score").select("metric", r6(F.col("value")).alias("value"))
