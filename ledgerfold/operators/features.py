"""Structured features.

Category levels are bounded before they leave Spark: rare-level grouping
keeps the top-N levels (N-row broadcast), and one-hot columns are built from
that bounded level list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import scalars
from ledgerfold.operators.filters import top_n_values
from ledgerfold.operators.quantiles import median, quantiles
from ledgerfold.session import materialize

MAX_LEVELS = 256

# What a missing calendar feature becomes (None: the column's median, cut to a whole number).
CALENDAR_DEFAULTS = {"contract_start_year": None, "contract_start_quarter": 1, "contract_start_month": 1,
                     "contract_duration_planned_days": 365, "is_end_of_fiscal_year": 0, "years_since_2015": None}


def median_impute(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """NULL → exact median of the non-NULL values (found by distributed selection)."""
    return df.withColumn(out or col, F.coalesce(F.col(col).cast("double"), F.lit(median(df, col)).cast("double")))


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Constant defaults per column."""
    return df.na.fill(defaults)


def rare_level_grouping(df: DataFrame, col: str, top_n: int, out: str | None = None) -> DataFrame:
    """M8: NULL → 'UNKNOWN'; levels outside the top_n most frequent → 'OTHER'."""
    out = out or f"{col}_grouped"
    filled = df.withColumn("_lvl", F.coalesce(F.col(col).cast("string"), F.lit("UNKNOWN")))
    top = F.broadcast(top_n_values(filled, "_lvl", top_n).select(F.col("_lvl").alias("_top")))  # ≤ top_n rows
    return (filled.join(top, filled["_lvl"] == top["_top"], "left")
                  .withColumn(out, F.when(F.col("_top").isNotNull(), F.col("_lvl")).otherwise(F.lit("OTHER")))
                  .drop("_lvl", "_top"))


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct levels of an already-bounded category column (checked ≤ max_levels)."""
    vals = [r[0] for r in df.select(col).distinct().orderBy(col).limit(max_levels + 1).collect()]
    if len(vals) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels; group rare levels first")
    return vals


def one_hot(df: DataFrame, col: str, prefix: str, drop_first: bool = False,
            level_list: list[str] | None = None) -> DataFrame:
    """M7: 0/1 column per level named prefix_level (levels sorted); NULL rows all-zero.

    N6 keeps every level; N8 drops the first (``drop_first``).
    """
    lv = level_list if level_list is not None else [v for v in levels(df, col) if v is not None]
    if drop_first:
        lv = lv[1:]
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in lv]) \
             .na.fill(0, subset=[f"{prefix}_{v}" for v in lv])


def temporal_features(df: DataFrame, start: str, planned_end: str) -> DataFrame:
    """C20: start year/quarter/month, end-of-fiscal-year flag, years since 2015, planned days."""
    return df.withColumns(scalars.calendar_features(start, planned_end))


def join_temporal(df: DataFrame, temporal: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined, rate): ``df`` with the calendar features that ``temporal`` has for its key, defaults where it has none
    (CALENDAR_DEFAULTS; a median is taken over the joined rows and cut to a whole number), and one row n_rows,
    n_matched, match_rate. A key that repeats in ``temporal`` counts once, by its smallest start."""
    cols = [c for c in CALENDAR_DEFAULTS if c in temporal.columns]
    one = temporal.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("_t"))
    j = materialize(df.join(one, key, "left").select(*[df[c] for c in df.columns], F.col("_t").isNotNull().alias("_matched"), *[F.col(f"_t.{c}").alias(c) for c in cols]))
    rate = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_matched").alias("n_matched")).withColumn("match_rate", F.try_divide("n_matched", "n_rows"))
    middle = quantiles(j, [c for c in cols if CALENDAR_DEFAULTS[c] is None], [0.5], True)
    filled = {c: middle[c][0] if CALENDAR_DEFAULTS[c] is None else CALENDAR_DEFAULTS[c] for c in cols}
    return j.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(v).cast("int")) for c, v in filled.items()}).drop("_matched"), rate


def align_inner(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(aligned, counts): rows whose key both feature sets have, with the columns of both, and one row n_left,
    n_right, n_both of distinct keys. A NULL key matches nothing."""
    both = left.join(right, key, "inner")
    keys = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full")
    counts = keys.filter(F.col(key).isNotNull()).agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"))
    return both, counts


def structured_features(df: DataFrame, base_col: str = "initial_cost") -> DataFrame:
    """M9: the structured feature set (no final value: it would leak the label).

    log size, modifications, median-imputed offers, grouped categories (top 10
    contract types, top 8 competition levels), supply category, calendar
    features with defaults, log duration and three interactions.
    """
    f = df.withColumn("log_base_value", scalars.signed_log(base_col))
    f = f.withColumn("num_modifications", F.coalesce(F.col("num_modifications").cast("double"), F.lit(1.0)))
    f = median_impute(f, "num_offers", "num_offers_imputed")
    f = rare_level_grouping(f, "contract_type", 10, "contract_type_grouped")
    f = rare_level_grouping(f, "competition", 8, "extent_competed_grouped")
    f = f.withColumn("psc_category4", scalars.psc_category4("psc"))
    for c, default in CALENDAR_DEFAULTS.items():
        if c in f.columns:
            fill = F.lit(median(f, c)).cast("int").cast("double") if default is None else F.lit(float(default))
            f = f.withColumn(c, F.coalesce(F.col(c).cast("double"), fill))
    if "contract_duration_planned_days" in f.columns:
        f = f.withColumn("log_duration_days", scalars.signed_log("contract_duration_planned_days"))
    eofy = F.col("is_end_of_fiscal_year") if "is_end_of_fiscal_year" in f.columns else F.lit(0.0)
    return f.withColumns(scalars.interactions("log_base_value", "num_modifications", "num_offers_imputed", eofy))
