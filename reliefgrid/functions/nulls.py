"""Scalar helpers that keep a missing value missing where Spark's own functions would skip it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value, fn) -> Column:
    """fn(value), with value worked out once, however often fn names it."""
    return F.element_at(F.transform(F.array(_col(value)), fn), 1)


def guarded(fn, *cols) -> Column:
    """fn of all columns, null if any of them is."""
    cols = [_col(c) for c in cols]
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), fn(*cols))


def null_min(*cols) -> Column:
    return guarded(F.least, *cols)


def null_clip(c, low, high) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def try_number(c, kind: str = "double") -> Column:
    """The number that a text holds, else null; blanks around it, ideographic ones too, don't matter."""
    return strip(c).try_cast(kind)


def strip(c) -> Column:
    return F.regexp_replace(_col(c), r"^[\s　]+|[\s　]+$", "")


def zero_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(0))


def safe_ratio(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))
