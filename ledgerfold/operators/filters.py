"""Row filters and predicates (F1–F11) and deterministic key sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The physical-deliverable numeric range and letter series.
PSC_NUMERIC_RANGE = (10, 99)
PSC_LETTERS = ("Y", "Z")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_physical_prefix(psc) -> Column:
    """F1, prefix rule: first char Y/Z (any case) or the first two chars are 10..99.

    NULL/empty → false. Written as an exact regex plus a redundant
    ``startsWith``/range disjunction that the Parquet reader can push down to
    skip row groups when psc is a raw scan column.
    """
    return F.coalesce(_prefix_predicate(psc), F.lit(False))


def _prefix_predicate(psc) -> Column:
    """F1 as a bare predicate (NULL for NULL codes): a Filter drops NULL, and without the
    coalesce wrapper the startsWith/range disjunction reaches the Parquet ``PushedFilters``."""
    p = _c(psc)
    exact = p.rlike(r"^([YyZz]|[1-9][0-9])")
    pushable = (p.startswith("Y") | p.startswith("Z") | p.startswith("y") | p.startswith("z")
                | ((p >= F.lit("10")) & (p < F.lit(":"))))
    return pushable & exact


def is_physical_whole(psc) -> Column:
    """F2, whole-code rule: trimmed+upper starts with Y/Z, or the whole code is an int 10..99.

    So 4-digit supply codes like '5820' are false while '0015' and ' 15' are true.
    """
    s = F.upper(F.regexp_replace(_c(psc), r"^\s+|\s+$", ""))
    ok = s.startswith("Y") | s.startswith("Z") | s.rlike(r"^\+?0*[1-9][0-9]$")
    return F.coalesce(ok, F.lit(False))


def physical_filter(df: DataFrame, rule: str = "prefix", psc_col: str = "psc") -> DataFrame:
    """Keep physical deliverables by the chosen rule ("prefix" | "whole")."""
    pred = _prefix_predicate(psc_col) if rule == "prefix" else is_physical_whole(psc_col)
    return df.filter(pred)


def drop_null_keys(df: DataFrame, key: str = "piid") -> DataFrame:
    """Spark keeps NULL group keys, pandas drops them – drop explicitly."""
    return df.filter(F.col(key).isNotNull())


def value_floor(df: DataFrame, min_value: float, col: str = "base_value") -> DataFrame:
    """contract-level floor (applied after the fold): keep base ≥ min."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) >= F.lit(min_value)))


def top_n_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values of ``col`` (ties by value, ascending).

    One partial-aggregated group-by, then TakeOrderedAndProject: the result is
    at most n rows, so it is safe to broadcast.
    """
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(n))


def in_top_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """rows whose ``col`` is among the top-n values (semi join, n-row broadcast)."""
    top = F.broadcast(top_n_values(df, col, n).select(col))
    return df.join(top, on=col, how="left_semi")


def sample_keys(df: DataFrame, n: int, key: str = "piid", seed: int = 42) -> DataFrame:
    """Exactly n distinct keys without replacement, deterministic for a seed.

    Keys are ranked by md5(seed||key) – a distributed, reproducible order –
    and the first n are kept (TakeOrderedAndProject keeps n rows per task).
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return keys.withColumn("_h", h).orderBy("_h", key).limit(n).select(key)


def keep_sampled(df: DataFrame, sampled_keys: DataFrame, key: str = "piid") -> DataFrame:
    """All actions of the sampled contracts (left-semi join)."""
    return df.join(sampled_keys, on=key, how="left_semi")
