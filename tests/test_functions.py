from pyspark.sql import functions as F

from tablesmith.functions.names import is_id_like, sanitize_name, sanitize_names
from tablesmith.functions.numbers import js_number, to_double
from tablesmith.functions.text import file_extension, split_list, split_names


def test_sanitize_default_and_strict():
    assert sanitize_name(" a b") == "a_b"
    assert sanitize_name("x-y") == "x_y"
    assert sanitize_name("p/q") == "p_q"
    assert sanitize_name("cost (usd)") == "cost_usd"
    assert sanitize_name("x-y", strict=True) == "xy"
    assert sanitize_name("cost (usd)", strict=True) == "cost_usd"


def test_sanitize_collisions():
    assert sanitize_names([" a b", "a_b", "x-y", "p/q", "cost (usd)"]) == ["a_b", "a_b_2", "x_y", "p_q", "cost_usd"]
    assert sanitize_names(["A", "a"]) == ["A", "a_2"]


def test_id_like_substring_and_token():
    assert is_id_like("wrongside2014")          # substring rule catches 'id'
    assert not is_id_like("wrongside2014", "token")
    assert is_id_like("user_id", "token")
    assert is_id_like("sno") and not is_id_like("value")


def test_js_number_edge_cases(spark):
    vals = ["", " 12 ", "1e3", ".5", "-3.", "abc", "1d", "NaN", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(js_number(F.col("v"))).collect()]
    assert got == [0.0, 12.0, 1000.0, 0.5, -3.0, None, None, None, 0.0]
    skip = [r[0] for r in df.select(js_number(F.col("v"), nulls="skip")).collect()]
    assert skip[-1] is None


def test_to_double(spark):
    df = spark.createDataFrame([(" 3 ",), ("",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(to_double("v")).collect()] == [3.0, None, None, None]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a, b,,c ", "file.Name.CSV")], "s string, f string")
    r = df.select(split_list("s").alias("l"), file_extension("f").alias("e")).first()
    assert r["l"] == ["a", "b", "c"] and r["e"] == "csv"
    assert split_names(" x, ,y ") == ["x", "y"]


def test_checkpoint_dir_is_read_from_the_session(spark):
    from tablesmith.session import _is_local, ensure_checkpoint_dir, scratch_path
    d = ensure_checkpoint_dir(spark)
    assert d and _is_local(spark)
    assert scratch_path(spark, "x").startswith(d.rstrip("/") + "/tablesmith/x-")


def test_no_local_checkpoint_folder_on_a_cluster():
    import pytest as _pytest

    from tablesmith.session import ensure_checkpoint_dir

    class _Conf:
        def get(self, key, default=None):
            return "yarn" if key == "spark.master" else default

    class _Remote:  # a session without SparkContext access and no checkpoint folder
        conf = _Conf()

        @property
        def sparkContext(self):
            raise RuntimeError("remote session")

    with _pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Remote())


def test_number_ignores_white_space_and_nan(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from tablesmith.functions.numbers import js_number
    s = spark.createDataFrame([("\t12\n",), ("\t",), ("\u00a07",)], "v string")
    assert [r[0] for r in s.select(js_number("v")).collect()] == [12.0, 0.0, 7.0]
    n = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in n.select(js_number(F.col("v"), T.DoubleType())).collect()] == [0.0, 0.0, 2.0]
    assert [r[0] for r in n.select(js_number(F.col("v"), T.DoubleType(), "skip")).collect()] == [None, None, 2.0]
