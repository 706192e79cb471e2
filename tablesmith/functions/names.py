"""Column-name rules. Names are schema metadata, so these run on the driver."""

from __future__ import annotations

import re

# Fixed values that must equal the reference's for the same results.
# Default name cleaning: strip, then these replacements in this order.
DEFAULT_REPLACEMENTS = ((" ", "_"), ("-", "_"), ("/", "_"), ("(", ""), (")", ""))
# Name fragments that mark a column as an identifier, not a measure.
ID_FRAGMENTS = ("index", "id", "sno")


def sanitize_name(name: str, strict: bool = False) -> str:
    """Clean one column name.

    default: strip; space, '-', '/' become '_'; '(' and ')' are removed.
    strict:  strip; space becomes '_'; every other non-word character is removed.
    """
    s = name.strip()
    if strict:
        return re.sub(r"[^\w]", "", s.replace(" ", "_"))
    for old, new in DEFAULT_REPLACEMENTS:
        s = s.replace(old, new)
    return s


def sanitize_names(names: list[str], strict: bool = False) -> list[str]:
    """Clean all names; a name that collides with an earlier one gets `_2`, `_3`, ..."""
    out: list[str] = []
    taken: set[str] = set()
    for n in names:
        base = sanitize_name(n, strict) or "col"
        cand, k = base, 2
        while cand.lower() in taken:  # Spark resolves names case-insensitively
            cand = f"{base}_{k}"
            k += 1
        taken.add(cand.lower())
        out.append(cand)
    return out


def is_id_like(name: str, match: str = "substring", fragments=ID_FRAGMENTS) -> bool:
    """True when the name looks like an identifier.

    substring: any fragment occurs anywhere in the lower-cased name (so `wrongside` matches `id`).
    token:     a fragment equals one `_`-separated token of the lower-cased name.
    """
    low = name.lower()
    if match == "token":
        toks = set(low.split("_"))
        return any(f in toks for f in fragments)
    return any(f in low for f in fragments)
