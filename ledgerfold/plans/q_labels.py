"""Catalogue: scan, casts, filters, contract fold and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import casts
from ledgerfold.operators import filters, labels
from ledgerfold.operators.labels import LabelSpec
from ledgerfold.plans.common import TEST_MIN_CONTRACT_VALUE, rounded
from ledgerfold.plans.registry import query
from ledgerfold.plans.sqlbits import (MOD_KEY, PREFIX_RULE, USABLE, WHOLE_RULE, actions_sql,
                                      days, history_labels_sql)
from ledgerfold.sources import bindings

HISTORY_COLS = ["description", "base_all_options", "base_exercised_options", "current_completion_date",
                "effective_date",
                "contract_type", "extent_competed", "num_offers", "agency_id", "vendor_name", "psc",
                "reason_for_mod"]


def history_actions(spark, sf_dir):
    return bindings.actions(spark, sf_dir, HISTORY_COLS).transform(filters.physical_filter, "prefix")


def labelled_history(spark, sf_dir, spec=LabelSpec(), usable=True):
    return labels.label(history_actions(spark, sf_dir), spec, usable=usable)


_A_HIST = f"(SELECT * FROM ({actions_sql(HISTORY_COLS)}) WHERE {PREFIX_RULE})"
_LABELLED_SQL = f"(SELECT * FROM ({history_labels_sql(_A_HIST)}) WHERE {USABLE})"


@query("overrun_rate_by_category", f"""
SELECT psc_category, CAST(count(*) AS BIGINT) AS n,
       round(avg(over_budget), 6) AS over_budget_rate, round(avg(late), 6) AS late_rate
FROM {_LABELLED_SQL} t GROUP BY psc_category""")
def overrun_rate_by_category(spark, sf_dir):
    """Minimum slice: A13 positive rates by 1-char supply category on usable history labels."""
    lab = labelled_history(spark, sf_dir)
    out = (lab.groupBy("psc_category")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.avg("over_budget").alias("over_budget_rate"),
                   F.avg("late").alias("late_rate"))
              .orderBy(F.desc("over_budget_rate"), "psc_category"))
    return rounded(out)


@query("physical_filter_prefix", f"""
SELECT piid, mod_number, action_id, psc FROM ({actions_sql(['psc'])}) a WHERE {PREFIX_RULE}""")
def physical_filter_prefix(spark, sf_dir):
    """F1 on the action view."""
    return bindings.actions(spark, sf_dir, ["psc"]).transform(filters.physical_filter, "prefix")


@query("physical_filter_whole", f"""
SELECT piid, mod_number, action_id, psc FROM ({actions_sql(['psc'])}) a WHERE {WHOLE_RULE}""")
def physical_filter_whole(spark, sf_dir):
    """F2 on the action view."""
    return bindings.actions(spark, sf_dir, ["psc"]).transform(filters.physical_filter, "whole")


# Raw money strings exercising C1: '$1,234.50' style, 'None', '' and plain numbers.
_MONEY_RAW_SQL = ("CASE l_linenumber WHEN 1 THEN '$' || format('{:,.2f}', l_extendedprice) "
                  "WHEN 2 THEN 'None' WHEN 3 THEN '' ELSE printf('%.2f', l_extendedprice) END")


@query("money_cast", f"""
SELECT l_orderkey AS piid, l_partkey AS action_id, l_linenumber AS line, raw,
       round(TRY_CAST(regexp_replace(raw, '[$,]', '', 'g') AS DOUBLE), 6) AS amount
FROM (SELECT *, {_MONEY_RAW_SQL} AS raw FROM lineitem) x""")
def money_cast(spark, sf_dir):
    """C1 over raw money strings derived from the line price."""
    li = bindings.table(spark, sf_dir, "lineitem")
    raw = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
            .when(F.col("l_linenumber") == 2, F.lit("None"))
            .when(F.col("l_linenumber") == 3, F.lit(""))
            .otherwise(F.format_string("%.2f", "l_extendedprice")))
    out = li.select(F.col("l_orderkey").alias("piid"), F.col("l_partkey").alias("action_id"),
                    F.col("l_linenumber").alias("line"), raw.alias("raw"))
    return rounded(out.withColumn("amount", casts.money("raw")))


_MOD_RAW = ("CASE l_returnflag WHEN 'A' THEN 'P' || lpad(CAST(l_linenumber AS VARCHAR), 5, '0') "
            "WHEN 'R' THEN CAST(l_linenumber AS VARCHAR) ELSE 'X' END")


@query("mod_sort_key", f"""
SELECT l_orderkey AS piid, l_partkey AS action_id, l_linenumber AS line, mod_number,
       {MOD_KEY} AS mod_key
FROM (SELECT *, {_MOD_RAW} AS mod_number FROM lineitem) x""")
def mod_sort_key(spark, sf_dir):
    """C4: digit-run sort key over letter ('P00003'), digit and digit-free numbers."""
    li = bindings.table(spark, sf_dir, "lineitem")
    raw = (F.when(F.col("l_returnflag") == "A",
                  F.concat(F.lit("P"), F.lpad(F.col("l_linenumber").cast("string"), 5, "0")))
            .when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("string"))
            .otherwise(F.lit("X")))
    out = li.select(F.col("l_orderkey").alias("piid"), F.col("l_partkey").alias("action_id"),
                    F.col("l_linenumber").alias("line"), raw.alias("mod_number"))
    return out.withColumn("mod_key", casts.mod_sort_key("mod_number"))


# ---- fold variants --------------------------------------------------------

_BASE_COLS = ["base_all_options", "base_exercised_options", "current_completion_date",
              "ultimate_completion_date", "description", "psc", "naics", "contract_type",
              "extent_competed", "num_offers", "agency_id", "vendor_name", "state_code"]
_A_BASE = f"(SELECT * FROM ({actions_sql(_BASE_COLS)}) WHERE {PREFIX_RULE})"
_STR_ORD = ("struct_pack(mnull := mod_number IS NULL, m := COALESCE(mod_number, ''), "
            "t0 := current_completion_date, t1 := action_id)")
_BASE_FOLD_SQL = f"""
SELECT piid, CAST(count(*) AS BIGINT) AS num_modifications,
  arg_min(struct_pack(b := base_all_options, c := current_completion_date, d := description, p := psc,
                      ct := contract_type, ec := extent_competed, no := num_offers, ag := agency_id), ord) AS f,
  arg_max(struct_pack(e := base_exercised_options, u := ultimate_completion_date), ord) AS l
FROM (SELECT *, {_STR_ORD} AS ord FROM {_A_BASE} WHERE piid IS NOT NULL) x GROUP BY piid"""


def baseline_actions(spark, sf_dir):
    return bindings.actions(spark, sf_dir, _BASE_COLS).transform(filters.physical_filter, "prefix")


@query("first_last_rows", f"""
SELECT piid, num_modifications, round(f.b, 6) AS base_value, round(l.e, 6) AS final_value,
  {days('l.u', 'f.c')} AS delay_days, f.d AS description, f.p AS psc, f.ct AS contract_type
FROM ({_BASE_FOLD_SQL}) t""")
def first_last_rows(spark, sf_dir):
    """A1 + W1 (string order): first and last action *row* per contract."""
    from ledgerfold.functions import scalars
    spec = LabelSpec(variant="baseline_vs_ultimate")
    f = labels.fold_baseline(baseline_actions(spark, sf_dir), spec)
    return rounded(f.select("piid", "num_modifications", "base_value", "final_value",
                            scalars.days_between("final_completion_date", "initial_completion_date").alias("delay_days"),
                            "description", "psc", "contract_type"))


def _holey(df):
    """Edge cases of FIXTURES §7: NULL base on the first action, gaps in exercised values."""
    return (df.withColumn("base_all_options", F.when(F.col("mod_number") != "1", F.col("base_all_options")))
              .withColumn("base_exercised_options",
                          F.when(~F.col("mod_number").isin("2", "4", "6"), F.col("base_exercised_options")))
              .withColumn("description", F.when(F.col("mod_number") != "1", F.col("description"))))


_HOLEY_SQL = (f"(SELECT * REPLACE (CASE WHEN mod_number <> '1' THEN base_all_options END AS base_all_options, "
              f"CASE WHEN mod_number NOT IN ('2','4','6') THEN base_exercised_options END AS base_exercised_options, "
              f"CASE WHEN mod_number <> '1' THEN description END AS description) FROM {_A_HIST})")


@query("first_last_nonnull", f"""
SELECT piid, num_modifications, round(initial_cost, 6) AS initial_cost, round(final_cost, 6) AS final_cost,
       description, psc
FROM ({history_labels_sql(_HOLEY_SQL)}) t""")
def first_last_nonnull(spark, sf_dir):
    """A2: first/last non-NULL value per column (history variant) with NULL-holed inputs."""
    f = labels.fold_history(history_actions(spark, sf_dir).transform(_holey))
    return rounded(f.select("piid", "num_modifications", "initial_cost", "final_cost", "description", "psc"))


@query("mod_reasons", f"""
SELECT piid, string_agg(reason_for_mod, ', ' ORDER BY o) AS all_mod_reasons
FROM (SELECT piid, reason_for_mod, min(struct_pack(m := {MOD_KEY}, t0 := current_completion_date, t1 := action_id)) AS o
      FROM {_A_HIST} WHERE reason_for_mod IS NOT NULL AND piid IS NOT NULL GROUP BY piid, reason_for_mod) r
GROUP BY piid""")
def mod_reasons(spark, sf_dir):
    """Distinct modification reasons per contract in first-seen order."""
    return labels.mod_reasons(history_actions(spark, sf_dir))


@query("terminated_flag", f"""
SELECT piid, terminated_for_default FROM ({history_labels_sql(_A_HIST)}) t""")
def terminated_flag(spark, sf_dir):
    """A5: any reason matching DEFAULT|TERMINAT (case-insensitive), NULL → 0."""
    return labels.fold_history(history_actions(spark, sf_dir)).select("piid", "terminated_for_default")


@query("label_history", f"""
SELECT piid, num_modifications, round(initial_cost, 6) AS initial_cost, round(final_cost, 6) AS final_cost,
  round(cost_growth_pct, 6) AS cost_growth_pct, over_budget, delay_days, late, terminated_for_default,
  psc, psc_category, round(threshold_used, 6) AS threshold_used, contract_type, competition, agency, vendor,
  round(num_offers, 6) AS num_offers
FROM {_LABELLED_SQL} t""")
def label_history_q(spark, sf_dir):
    """History variant end to end: F1 → fold → C6/C8 → A10 → F4."""
    lab = labelled_history(spark, sf_dir)
    return rounded(lab.select("piid", "num_modifications", "initial_cost", "final_cost", "cost_growth_pct",
                              "over_budget", "delay_days", "late", "terminated_for_default", "psc",
                              "psc_category", "threshold_used", "contract_type", "competition", "agency",
                              "vendor", "num_offers"))


def _baseline_labels_sql(floor: float, threshold: float = 5.0, fallback: float = 1.0) -> str:
    g = f"""
    SELECT piid, num_modifications, f.b AS base_value, l.e AS final_value, f.d AS description, f.p AS psc,
      f.ct AS contract_type, f.ec AS extent_competed, COALESCE(f.no, 0.0) AS num_offers, f.ag AS agency_id,
      CASE WHEN f.b <> 0 AND l.e IS NOT NULL THEN (l.e - f.b) / abs(f.b) * 100.0 END AS cost_growth_pct,
      {days('l.u', 'f.c')} AS delay_days
    FROM ({_BASE_FOLD_SQL}) t WHERE f.b IS NOT NULL AND f.b >= {floor}"""
    return f"""
    SELECT *, CASE WHEN rate < 0.05 THEN CAST({fallback} AS DOUBLE) ELSE CAST({threshold} AS DOUBLE) END AS threshold_used,
      COALESCE(CAST(cost_growth_pct > CASE WHEN rate < 0.05 THEN {fallback} ELSE {threshold} END AS INTEGER), 0) AS over_budget,
      COALESCE(CAST(delay_days > 0 AS INTEGER), 0) AS late,
      CASE WHEN base_value IS NULL THEN 0.0 ELSE ln(1 + base_value) END AS log_initial_cost,
      CASE WHEN base_value > 0 AND base_value <= 1e6 THEN '<1M' WHEN base_value > 1e6 AND base_value <= 5e6 THEN '1M-5M'
           WHEN base_value > 5e6 AND base_value <= 25e6 THEN '5M-25M' WHEN base_value > 25e6 AND base_value <= 100e6 THEN '25M-100M'
           WHEN base_value > 100e6 THEN '>100M' END AS value_tier
    FROM (SELECT *, avg(COALESCE(CAST(cost_growth_pct > {threshold} AS DOUBLE), 0.0)) OVER () AS rate FROM ({g}) g) h
    WHERE cost_growth_pct IS NOT NULL AND delay_days IS NOT NULL"""


def labelled_baseline(spark, sf_dir, spec=None):
    spec = spec or LabelSpec(variant="baseline_vs_ultimate", min_contract_value=TEST_MIN_CONTRACT_VALUE)
    return labels.label(baseline_actions(spark, sf_dir), spec)


@query("label_baseline_ultimate", f"""
SELECT piid, num_modifications, round(base_value, 6) AS base_value, round(final_value, 6) AS final_value,
  round(cost_growth_pct, 6) AS cost_growth_pct, delay_days, over_budget, late, round(threshold_used, 6) AS threshold_used,
  round(log_initial_cost, 6) AS log_initial_cost, round(num_offers, 6) AS num_offers, value_tier, psc, contract_type
FROM ({_baseline_labels_sql(TEST_MIN_CONTRACT_VALUE)}) t""")
def label_baseline_ultimate(spark, sf_dir):
    """Baseline-vs-ultimate variant end to end (F3 floor 50,000 on the test data)."""
    lab = labelled_baseline(spark, sf_dir)
    return rounded(lab.select("piid", "num_modifications", "base_value", "final_value", "cost_growth_pct",
                              "delay_days", "over_budget", "late", "threshold_used", "log_initial_cost",
                              "num_offers", "value_tier", "psc", "contract_type"))


@query("adaptive_threshold", f"""
SELECT 'history' AS variant, CAST(count(cost_growth_pct) AS BIGINT) AS n_with_growth,
  round(avg(CASE WHEN cost_growth_pct IS NOT NULL THEN CAST(cost_growth_pct > 1000.0 AS DOUBLE) END), 6) AS rate_at_primary,
  round(max(threshold_used), 6) AS threshold_used, CAST(sum(over_budget) AS BIGINT) AS positives
FROM ({history_labels_sql(_A_HIST, threshold=1000.0, fallback=1.0)}) t
UNION ALL
SELECT 'baseline_vs_ultimate', CAST(count(cost_growth_pct) AS BIGINT),
  round(avg(CAST(cost_growth_pct > 1000.0 AS DOUBLE)), 6), round(max(threshold_used), 6), CAST(sum(over_budget) AS BIGINT)
FROM ({_baseline_labels_sql(TEST_MIN_CONTRACT_VALUE, threshold=1000.0)}) t""")
def adaptive_threshold(spark, sf_dir):
    """A10: a primary threshold of 1000 % leaves <5 % positives, so the 1 % fallback applies."""
    def summary(lab, variant):
        return lab.agg(F.lit(variant).alias("variant"), F.count("cost_growth_pct").alias("n_with_growth"),
                       F.avg(F.when(F.col("cost_growth_pct").isNotNull(),
                                    (F.col("cost_growth_pct") > 1000.0).cast("double"))).alias("rate_at_primary"),
                       F.max("threshold_used").alias("threshold_used"),
                       F.sum("over_budget").cast("bigint").alias("positives"))
    h = labels.label(history_actions(spark, sf_dir), LabelSpec(threshold=1000.0, fallback=1.0), usable=False)
    b = labels.label(baseline_actions(spark, sf_dir),
                     LabelSpec(variant="baseline_vs_ultimate", threshold=1000.0, fallback=1.0,
                               min_contract_value=TEST_MIN_CONTRACT_VALUE))
    return rounded(summary(h, "history").unionByName(summary(b, "baseline_vs_ultimate")))


@query("contract_value_floor", f"""
SELECT CAST(count(*) AS BIGINT) AS n_contracts,
  CAST(count(*) FILTER (WHERE f.b IS NOT NULL AND f.b >= {TEST_MIN_CONTRACT_VALUE}) AS BIGINT) AS n_kept,
  CAST(count(*) FILTER (WHERE NOT (f.b IS NOT NULL AND f.b >= {TEST_MIN_CONTRACT_VALUE})) AS BIGINT) AS n_below_floor
FROM ({_BASE_FOLD_SQL}) t""")
def contract_value_floor(spark, sf_dir):
    """contract-level floor on the first action's base value (after the fold)."""
    f = labels.fold_baseline(baseline_actions(spark, sf_dir), LabelSpec(variant="baseline_vs_ultimate"))
    keep = F.col("base_value").isNotNull() & (F.col("base_value") >= TEST_MIN_CONTRACT_VALUE)
    return f.agg(F.count(F.lit(1)).alias("n_contracts"), F.count_if(keep).alias("n_kept"),
                 F.count_if(~keep).alias("n_below_floor"))


@query("usable_rows_funnel", f"""
SELECT CAST(count(*) AS BIGINT) AS n_labelled,
  CAST(count(*) FILTER (WHERE over_budget IS NULL AND late IS NULL) AS BIGINT) AS drop_both_labels_null,
  CAST(count(*) FILTER (WHERE NOT (over_budget IS NULL AND late IS NULL) AND COALESCE(initial_cost, 0) <= 0) AS BIGINT) AS drop_initial_cost,
  CAST(count(*) FILTER (WHERE NOT (over_budget IS NULL AND late IS NULL) AND COALESCE(initial_cost, 0) > 0
        AND (description IS NULL OR trim(description) = '')) AS BIGINT) AS drop_description,
  CAST(count(*) FILTER (WHERE {USABLE}) AS BIGINT) AS n_final
FROM ({history_labels_sql(_HOLEY_SQL)}) t""")
def usable_rows_funnel(spark, sf_dir):
    """Row funnel through the usable-row steps (NULL-holed inputs so each step bites)."""
    lab = labels.label(history_actions(spark, sf_dir).transform(_holey), LabelSpec(), usable=False)
    return labels.usable_funnel(lab)
