"""Number parsing as Column expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: decimal number text accepted by the browser-style `Number(v)` rule.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Fixed value: white space that the browser's `Number(v)` ignores around a number.
BLANKS = (" \t\n\v\f\r"
          "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_number(c, dtype: T.DataType | None = None, nulls: str = "zero") -> Column:
    """Browser `Number(v)` semantics as a double Column.

    Blank or whitespace text becomes 0, decimal text is parsed, anything else is NULL
    (dropped by aggregates). The browser also reads "Infinity" and hexadecimal text such as
    "0x10" as numbers; here they are text and dropped. A SQL NULL was shown to the browser as '' and so also becomes
    0 with ``nulls="zero"``; ``nulls="skip"`` keeps it NULL. Numeric and boolean columns
    need no parsing; their NaN is a missing value like NULL.
    """
    col = _col(c)
    missing = col.isNull()
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        v = col.cast("double")
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            v = F.when(~F.isnan(v), v)
            missing = v.isNull()
    else:
        s = F.btrim(col.cast("string"), F.lit(BLANKS))
        v = (F.when(s == "", F.lit(0.0))
             .when(s.rlike(NUMBER_PATTERN), s.try_cast("double")))
    if nulls == "zero":
        v = F.when(missing, F.lit(0.0)).otherwise(v)
    return v


def to_double(c) -> Column:
    """Blank text to NULL, then a cast to double that yields NULL instead of failing."""
    return F.nullif(F.trim(_col(c).cast("string")), F.lit("")).try_cast("double")
