"""String helpers used by feature requests and file filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(c) -> Column:
    """'a, b,,c ' -> ['a','b','c']: split on commas, trim, drop blanks."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def file_extension(c) -> Column:
    """Lower-cased text after the last '.'."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.element_at(F.split(col, r"\."), -1))


def split_names(text: str) -> list[str]:
    """Driver-side twin of split_list for a request string."""
    trimmed = map(str.strip, text.split(",") if text else ())
    return list(filter(None, trimmed))
