"""Every registered query against its DuckDB SQL on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tools.compare import TABLES, canon, type_mismatches

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF_SMALL)
    assert type_mismatches(sdf, con, ORACLE[key]) == []
    got = sdf.toPandas()
    exp = con.execute(ORACLE[key]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert canon(got) == canon(exp)


def test_every_key_registered():
    assert sum(not k.startswith("op") and k != "pipeline" for k in entry.queries()) >= 87
    assert set(ORACLE) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["key", "value"] and 0 < len(rows) <= 3
