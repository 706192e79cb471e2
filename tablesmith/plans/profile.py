"""The full table profile in two aggregations, whatever the column count:

1. per column: rows, non-null, missing, min<=>max  -> roles, drop reasons, missing counts
2. correlations of all surviving numeric columns (of the first `max_cols` if given), all
   pairs in one scan

The reference needed ~3 jobs per column plus one per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablesmith.functions.names import is_id_like
from tablesmith.operators.corr import corr_pairs
from tablesmith.operators.filters import MIN_TRAIN_ROWS
from tablesmith.operators.profile import profile_table
from tablesmith.operators.schema import sanitize_columns


@dataclass
class Profile:
    table: DataFrame          # the cleaned table (names sanitised, empty/constant dropped)
    columns: list[dict]       # one dict per original column (profile rows)
    rows: int
    numeric: list[str]
    string: list[str]
    dropped: dict[str, str]
    targets: list[str]
    can_train: bool
    correlations: DataFrame   # (a, b, r)


def profile(df: DataFrame, max_cols: int | None = None, nulls: str = "zero", match: str = "substring",
            sanitize: bool = True) -> Profile:
    if sanitize:
        df = sanitize_columns(df)
    cols = [r.asDict() for r in profile_table(df).orderBy("position").collect()]  # pass 1
    dropped = {c["column"]: c["reason"] for c in cols if c["reason"]}
    kept = df.drop(*dropped)
    numeric = [c["column"] for c in cols if c["role"] == "numeric" and c["column"] not in dropped]
    string = [c["column"] for c in cols if c["role"] != "numeric" and c["column"] not in dropped]
    rows = cols[0]["rows"] if cols else 0
    targets = [c for c in numeric if not is_id_like(c, match)]
    corr = corr_pairs(kept, numeric, max_cols, nulls)  # pass 2 (lazy)
    return Profile(table=kept, columns=cols, rows=rows, numeric=numeric, string=string,
                   dropped=dropped, targets=targets,
                   can_train=bool(targets) and rows >= MIN_TRAIN_ROWS, correlations=corr)


def correlation_dict(p: Profile) -> dict[str, float | None]:
    """{'a___b': r} as the profile page shows it (missing r shown as None)."""
    return {f"{r['a']}___{r['b']}": r["r"] for r in p.correlations.collect()}
