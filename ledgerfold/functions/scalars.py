"""Scalar derivations on labelled contracts (C5–C24). All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def final_cost(exercised, all_options) -> Column:
    """Exercised value, else all-options value."""
    return F.coalesce(_c(exercised), _c(all_options))


def growth_pct_history(initial, final) -> Column:
    """(f-i)/i*100 only when i>0 and both present (history variant)."""
    i, f = _c(initial), _c(final)
    return F.when((i > 0) & f.isNotNull(), (f - i) / i * 100.0)


def growth_pct_baseline(base, final) -> Column:
    """(f-b)/|b|*100, NULL when b is 0 or missing (baseline-vs-ultimate variant)."""
    b, f = _c(base), _c(final)
    return F.when((b != 0) & f.isNotNull(), (f - b) / F.abs(b) * 100.0)


def epoch_us(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def days_between(later, earlier) -> Column:
    """Whole days of (later - earlier), floored like a timedelta's .days.

    2024-01-01 06:00 minus 2024-01-02 18:00 is -2 (datediff would say -1).
    """
    diff = epoch_us(later) - epoch_us(earlier)
    return F.floor(diff / F.lit(US_PER_DAY)).cast("bigint")


def label_keep_null(x, threshold) -> Column:
    """1/0 by strict ``x > t``; NULL stays NULL."""
    x = _c(x)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(x.isNotNull(), (x > t).cast("int"))


def label_null_zero(x, threshold) -> Column:
    """C11: 1/0 by strict ``x > t``; NULL → 0."""
    x = _c(x)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce((x > t).cast("int"), F.lit(0))


def signed_log(x) -> Column:
    """sign(x)*log1p(|x|), NULL → 0."""
    x = F.coalesce(_c(x).cast("double"), F.lit(0.0))
    return F.signum(x) * F.log1p(F.abs(x))


def log1p_filled(x) -> Column:
    """log1p(coalesce(x, 0)); NULL when x <= -1."""
    x = F.coalesce(_c(x).cast("double"), F.lit(0.0))
    return F.when(x > -1, F.log1p(x))


def inf_to_zero(x) -> Column:
    """C14: ±inf → 0."""
    x = _c(x)
    return F.when(F.abs(x) == F.lit(float("inf")), F.lit(0.0)).otherwise(x)


# Value-tier bin edges (right-closed) and their labels.
VALUE_TIER_EDGES = (0.0, 1e6, 5e6, 25e6, 100e6)
VALUE_TIER_LABELS = ("<1M", "1M-5M", "5M-25M", "25M-100M", ">100M")


def value_tier(x) -> Column:
    """(0,1M] (1M,5M] (5M,25M] (25M,100M] (100M,inf) – right-closed; else NULL."""
    x = _c(x)
    e, lab = VALUE_TIER_EDGES, VALUE_TIER_LABELS
    expr = F.when((x > e[0]) & (x <= e[1]), lab[0])
    for k in range(1, 4):
        expr = expr.when((x > e[k]) & (x <= e[k + 1]), lab[k])
    return expr.when(x > e[4], lab[4])


def psc_category(psc) -> Column:
    """Upper-cased first character of the supply code."""
    return F.upper(F.substring(_c(psc), 1, 1))


def psc_category4(psc) -> Column:
    """C17: Y_construction / Z_maintenance / num_supplies / OTHER (NULL → 'U' → OTHER)."""
    ch = F.upper(F.substring(F.coalesce(_c(psc), F.lit("U")), 1, 1))
    return (F.when(ch == "Y", "Y_construction")
            .when(ch == "Z", "Z_maintenance")
            .when(ch.rlike("^[0-9]$"), "num_supplies")
            .otherwise("OTHER"))


def clip(x, lo, hi) -> Column:
    """Clip into [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def text_length(x) -> Column:
    """Character length, NULL → 0."""
    return F.coalesce(F.length(_c(x)), F.lit(0))


def calendar_features(start, planned_end) -> dict[str, Column]:
    """C20: calendar features of the start date."""
    s = _c(start)
    return {
        "contract_start_year": F.year(s),
        "contract_start_quarter": F.quarter(s),
        "contract_start_month": F.month(s),
        "is_end_of_fiscal_year": (F.month(s) == 9).cast("int"),
        "years_since_2015": F.year(s) - 2015,
        "contract_duration_planned_days": days_between(planned_end, start),
    }


def interactions(log_base, mods, offers, eofy) -> dict[str, Column]:
    """size×complexity, competition×size, EOFY×size."""
    lb = _c(log_base)
    return {
        "size_x_mods": lb * F.log1p(_c(mods).cast("double")),
        "competition_x_size": _c(offers) * lb,
        "eofy_x_size": _c(eofy) * lb,
    }


def growth_pct_program(baseline, current) -> Column:
    """(current-baseline)/baseline*100; NULL when baseline is 0/NULL."""
    b, c = _c(baseline), _c(current)
    return F.when(b != 0, (c - b) / b * 100.0)


def months_between_ym(later_ym, earlier_ym) -> Column:
    """Whole months between two 'YYYY-MM' strings."""
    def ym(c):
        d = F.try_to_timestamp(F.concat(_c(c), F.lit("-01")), F.lit("yyyy-MM-dd"))
        return F.year(d) * 12 + F.month(d)
    return (ym(later_ym) - ym(earlier_ym)).cast("int")
