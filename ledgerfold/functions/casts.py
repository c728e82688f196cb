"""Explicit casts from raw STRING columns.

ANSI mode is on, so every cast goes through ``try_cast``: bad input becomes
NULL instead of failing the job. NaN is turned into NULL at the door because
``NaN > x`` is true in Spark and ``median`` counts NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(~F.isnan(c), c)


def money(c) -> Column:
    """C1: '$1,234.50' → 1234.5; 'None', '', junk → NULL."""
    stripped = F.regexp_replace(_c(c).cast("string"), r"[$,]", "")
    return nan_to_null(F.trim(stripped).try_cast("double"))


def timestamp(c) -> Column:
    """date/time string → TIMESTAMP (session zone UTC); bad → NULL."""
    return _c(c).cast("string").try_cast("timestamp")


def number(c) -> Column:
    """Numeric coercion; the literal 'None' and junk → NULL."""
    return nan_to_null(F.trim(_c(c).cast("string")).try_cast("double"))


def mod_sort_key(c) -> Column:
    """C4: first digit run of a modification number as integer, else 0.

    '0'→0, '10'→10, 'P00002'→2, 'A'→0, NULL→0.
    """
    digits = F.regexp_extract(_c(c).cast("string"), r"(\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))
