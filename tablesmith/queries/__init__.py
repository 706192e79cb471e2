"""Registry of every implemented operator as a (spark, sf_dir) -> DataFrame query, with
the DuckDB SQL that computes the same result where one exists."""

from __future__ import annotations

from tablesmith.queries import activity, charts, ml, tables

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (tables, charts, activity, ml):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)

flagship = charts.flagship
