"""Rounding on which two engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values may fall on a rounding boundary, where the order of adding or the way of rounding decides; this moves them off it.
NUDGE = 1e-12


def rounded(value: str | Column, places: int) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(NUDGE), places)


def rounded_sql(sql: str) -> str:
    """The SQL with every round(x, n) as round((x) + NUDGE, n)."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, i, comma = 1, k + 6, -1
        while depth:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = i
            i += 1
        inner = rounded_sql(sql[k + 6 : comma])
        out += [sql[at:k], "round((", inner, f") + {NUDGE}::double", sql[comma:i]]
        at = i
    return "".join(out) + sql[at:]
