"""Fold each contract's ordered modifications into one labelled row.

Two variants of the reference, selected by ``LabelSpec.variant``:

* ``history`` – order by the digit run of the modification number; every
  field is the first/last *non-null* value of its column; cost growth only for
  a positive initial cost; delay from the current completion date of the
  first and last action; NULL labels stay NULL; usable-row filter F4.
* ``baseline_vs_ultimate`` – order by the raw modification *string*; fields
  come from the first/last *row* (NULLs kept); contract-level value floor;
  growth divides by |base|; delay = last ultimate − first current completion;
  NULL labels become 0; rows without growth or delay are dropped.

Both are a single ``groupBy(piid).agg`` of ordered aggregates (``min_by`` /
``max_by``), which combine map-side: a contract holding a third of all rows
is reduced per task before the shuffle, never collected into one group. The
adaptive threshold is one global aggregate joined back as a one-row
broadcast – no value travels through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import casts, scalars
from ledgerfold.session import materialize


@dataclass(frozen=True)
class LabelSpec:
    variant: str = "history"              # "history" | "baseline_vs_ultimate"
    mod_order: str | None = None          # "numeric" | "string" (default by variant)
    threshold: float = 5.0                # over-budget growth threshold, percent
    fallback: float = 1.0                 # used when the positive rate is below min_positive_rate
    min_positive_rate: float = 0.05
    delay_threshold: float = 0.0          # late = delay_days > this
    min_contract_value: float | None = None   # baseline variant floor (reference: 500,000)
    tie_break: tuple[str, ...] = ("current_completion_date", "action_id")

    @property
    def order(self) -> str:
        return self.mod_order or ("numeric" if self.variant == "history" else "string")


# Per-contract fields taken from the first action (history variant).
HISTORY_FIRST = {
    "description": "description",
    "base_all_options": "initial_cost",
    "current_completion_date": "initial_completion_date",
    "effective_date": "effective_date",
    "contract_type": "contract_type",
    "extent_competed": "competition",
    "num_offers": "num_offers",
    "agency_id": "agency",
    "vendor_name": "vendor",
    "state_code": "state",
    "psc": "psc",
    "naics": "naics",
}
# Fields taken from the last action (history variant).
HISTORY_LAST = {
    "base_exercised_options": "final_cost_exercised",
    "base_all_options": "final_cost_fallback",
    "current_completion_date": "final_completion_date",
}
# First-row fields of the baseline variant.
BASELINE_FIRST = ("description", "psc", "naics", "contract_type", "extent_competed",
                  "num_offers", "agency_id", "vendor_name", "state_code")

# A reason containing either marks a default termination.
TERMINATION_PATTERN = "DEFAULT|TERMINAT"


def order_key(spec: LabelSpec, df: DataFrame) -> Column:
    """Total order of actions inside a contract (explicit tie-break columns)."""
    if spec.order == "numeric":
        head = [casts.mod_sort_key("mod_number").alias("m")]
    else:
        # string order, NULL modification numbers last (as a pandas sort does)
        head = [F.col("mod_number").isNull().alias("mnull"),
                F.coalesce(F.col("mod_number"), F.lit("")).alias("m")]
    ties = [F.col(c).alias(f"t{i}") for i, c in enumerate(spec.tie_break) if c in df.columns]
    return F.struct(*head, *ties)


def typed_actions(df: DataFrame) -> DataFrame:
    """C1–C3 on whichever raw columns are strings; typed columns pass through."""
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        t = types[c]
        if c in ("base_all_options", "base_exercised_options", "obligated_amount") and t == "string":
            out.append(casts.money(c).alias(c))
        elif c == "num_offers":
            out.append(casts.number(c).alias(c))
        elif c.endswith("_date") and t == "string":
            out.append(casts.timestamp(c).alias(c))
        elif c in ("base_all_options", "base_exercised_options", "obligated_amount"):
            out.append(casts.nan_to_null(F.col(c).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(out)


def _first_nonnull(c: str, ordc: Column) -> Column:
    """A2: value of ``c`` at the smallest order among rows where ``c`` is not NULL."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ordc))


def _last_nonnull(c: str, ordc: Column) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordc))


def mod_reasons(actions: DataFrame, spec: LabelSpec = LabelSpec()) -> DataFrame:
    """Distinct reasons per contract, ', '-joined in first-seen order.

    Two-level: (piid, reason) → first order (partial-aggregated), then one
    short list per contract whose length is the number of *distinct* reasons.
    """
    ordc = order_key(spec, actions)
    firsts = (actions.filter(F.col("reason_for_mod").isNotNull() & F.col("piid").isNotNull())
              .groupBy("piid", "reason_for_mod").agg(F.min(ordc).alias("o")))
    return (firsts.groupBy("piid")
            .agg(F.array_sort(F.collect_list(F.struct("o", "reason_for_mod"))).alias("rs"))
            .select("piid", F.array_join(F.transform("rs", lambda z: z["reason_for_mod"]), ", ")
                    .alias("all_mod_reasons")))


def fold_history(actions: DataFrame, spec: LabelSpec = LabelSpec()) -> DataFrame:
    """A1–A5 (history): one row per piid of first/last non-null values.

    One pipeline, two aggregation levels: level 1 groups by (piid, reason)
    and keeps, per column, the (order, value) struct of its first/last
    non-null action; level 2 merges those structs per piid, sums the counts
    and lists the distinct reasons by their first order. Both levels combine
    map-side; level 2 reads only one row per (contract, distinct reason).
    """
    df = typed_actions(actions.filter(F.col("piid").isNotNull()))
    o = order_key(spec, df)
    df = df.withColumn("_o", o)
    fields = [f.name for f in df.schema["_o"].dataType.fields]
    o = F.col("_o")
    has_reason = "reason_for_mod" in df.columns
    keys = ["piid", "reason_for_mod"] if has_reason else ["piid"]

    def tagged(c):  # flat (order fields…, value) struct: cheaper to compare than a nested one
        return F.when(F.col(c).isNotNull(), F.struct(*[o[f].alias(f) for f in fields], F.col(c).alias("v")))

    firsts = [(src, dst) for src, dst in HISTORY_FIRST.items() if src in df.columns]
    lasts = [(src, dst) for src, dst in HISTORY_LAST.items() if src in df.columns]
    lvl1 = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(o).alias("_ro"),
        *[F.min(tagged(src)).alias(f"_f_{dst}") for src, dst in firsts],
        *[F.max(tagged(src)).alias(f"_l_{dst}") for src, dst in lasts])
    aggs = [F.sum("_n").alias("num_modifications")]
    aggs += [F.min(f"_f_{dst}")["v"].alias(dst) for _, dst in firsts]
    aggs += [F.max(f"_l_{dst}")["v"].alias(dst) for _, dst in lasts]
    if has_reason:
        r = F.col("reason_for_mod")
        aggs += [F.coalesce(F.max(F.upper(r).rlike(TERMINATION_PATTERN).cast("int")), F.lit(0)).alias("terminated_for_default"),
                 F.array_sort(F.collect_list(F.when(r.isNotNull(), F.struct(F.col("_ro").alias("o"), r.alias("r")))))
                 .alias("_rs")]  # one entry per distinct reason of the contract
    out = lvl1.groupBy("piid").agg(*aggs)
    if has_reason:
        out = out.withColumn("all_mod_reasons", F.when(F.size("_rs") > 0, F.array_join(F.transform("_rs", lambda z: z["r"]), ", "))).drop("_rs")
    out = out.withColumn("num_modifications", F.col("num_modifications").cast("bigint"))
    out = out.withColumn("final_cost", scalars.final_cost("final_cost_exercised", "final_cost_fallback"))
    return out.drop("final_cost_exercised", "final_cost_fallback")


def fold_baseline(actions: DataFrame, spec: LabelSpec) -> DataFrame:
    """A1 (baseline_vs_ultimate): first and last *row* per piid, NULLs kept."""
    df = typed_actions(actions.filter(F.col("piid").isNotNull()))
    o = order_key(spec, df)
    first_cols = [c for c in ("base_all_options", "current_completion_date") + BASELINE_FIRST if c in df.columns]
    last_cols = [c for c in ("base_exercised_options", "ultimate_completion_date") if c in df.columns]
    out = df.groupBy("piid").agg(
        F.count(F.lit(1)).alias("num_modifications"),
        F.min_by(F.struct(*first_cols), o).alias("f"),
        F.max_by(F.struct(*last_cols), o).alias("l"))
    return out.select(
        "piid", "num_modifications",
        F.col("f.base_all_options").alias("base_value"),
        F.col("l.base_exercised_options").alias("final_value"),
        F.col("f.current_completion_date").alias("initial_completion_date"),
        F.col("l.ultimate_completion_date").alias("final_completion_date"),
        *[F.col(f"f.{c}").alias(c) for c in BASELINE_FIRST if c in first_cols])


def with_adaptive_label(df: DataFrame, value_col: str, label_col: str, spec: LabelSpec,
                        keep_null: bool, materialize_input: bool = True) -> DataFrame:
    """A10 + C10/C11: label at the primary threshold; if the positive rate is
    below ``min_positive_rate`` relabel at the fallback.

    History variant: rate over rows with a value (NULL stays NULL). Baseline
    variant: NULL counts as 0 in the rate. The rate is one global aggregate
    used as a scalar subquery (evaluated once, inlined as a value). The
    input (the per-contract fold) is materialised first so the fold runs once
    for both consumers.
    """
    lab = scalars.label_keep_null if keep_null else scalars.label_null_zero
    if materialize_input:
        df = materialize(df)
    rate = df.agg(F.avg(lab(value_col, spec.threshold).cast("double"))).scalar()  # one value, computed once
    thr = (F.when(rate < F.lit(spec.min_positive_rate), F.lit(spec.fallback))
           .otherwise(F.lit(spec.threshold)))
    return (df.withColumn("threshold_used", thr)
              .withColumn(label_col, lab(value_col, F.col("threshold_used"))))


def label_history(actions: DataFrame, spec: LabelSpec = LabelSpec()) -> DataFrame:
    """C6, C8, C10, A5, A10 on the history fold (before the usable-row filter)."""
    f = fold_history(actions, spec)
    f = (f.withColumn("cost_growth_pct", scalars.growth_pct_history("initial_cost", "final_cost"))
          .withColumn("delay_days", scalars.days_between("final_completion_date", "initial_completion_date")))
    f = with_adaptive_label(f, "cost_growth_pct", "over_budget", spec, keep_null=True)
    return (f.withColumn("late", scalars.label_keep_null("delay_days", spec.delay_threshold))
             .withColumn("psc_category", scalars.psc_category("psc")))


def usable_history(labelled: DataFrame) -> DataFrame:
    """drop rows with both labels NULL, initial cost NULL/≤0, blank description."""
    return labelled.filter(
        (F.col("over_budget").isNotNull() | F.col("late").isNotNull())
        & (F.coalesce(F.col("initial_cost"), F.lit(0.0)) > 0)
        & F.col("description").isNotNull()
        & (F.trim(F.col("description")) != ""))


def label_baseline(actions: DataFrame, spec: LabelSpec) -> DataFrame:
    """Baseline-vs-ultimate labelling: F3 floor, C7, C9, C11, A10, F5, derived columns."""
    f = fold_baseline(actions, spec)
    if spec.min_contract_value is not None:
        f = f.filter(F.col("base_value").isNotNull() & (F.col("base_value") >= F.lit(spec.min_contract_value)))
    f = (f.withColumn("cost_growth_pct", scalars.growth_pct_baseline("base_value", "final_value"))
          .withColumn("delay_days", scalars.days_between("final_completion_date", "initial_completion_date")))
    f = with_adaptive_label(f, "cost_growth_pct", "over_budget", spec, keep_null=False)
    f = f.withColumn("late", scalars.label_null_zero("delay_days", spec.delay_threshold))
    f = f.filter(F.col("cost_growth_pct").isNotNull() & F.col("delay_days").isNotNull())
    return (f.withColumn("log_initial_cost", scalars.log1p_filled("base_value"))
             .withColumn("num_offers", F.coalesce(F.col("num_offers"), F.lit(0.0)))
             .withColumn("value_tier", scalars.value_tier("base_value")))


def label(actions: DataFrame, spec: LabelSpec = LabelSpec(), usable: bool = True) -> DataFrame:
    """Dispatch by variant."""
    if spec.variant == "history":
        out = label_history(actions, spec)
        return usable_history(out) if usable else out
    return label_baseline(actions, spec)


def usable_funnel(labelled: DataFrame) -> DataFrame:
    """Counts at each usable-row step in ONE aggregate (no re-scans)."""
    both_null = F.col("over_budget").isNull() & F.col("late").isNull()
    bad_cost = F.coalesce(F.col("initial_cost"), F.lit(0.0)) <= 0
    bad_desc = F.col("description").isNull() | (F.trim(F.col("description")) == "")
    return labelled.agg(
        F.count(F.lit(1)).alias("n_labelled"),
        F.count_if(both_null).alias("drop_both_labels_null"),
        F.count_if(~both_null & bad_cost).alias("drop_initial_cost"),
        F.count_if(~both_null & ~bad_cost & bad_desc).alias("drop_description"),
        F.count_if(~both_null & ~bad_cost & ~bad_desc).alias("n_final"))
