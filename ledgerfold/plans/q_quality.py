"""Catalogue: profiles, rates, histograms, correlations, guard rails, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import linkage, filters, labels, quality
from ledgerfold.plans.common import rounded
from ledgerfold.plans.q_labels import (_A_HIST, _HOLEY_SQL, _LABELLED_SQL, _holey, history_actions,
                                       labelled_history)
from ledgerfold.plans.registry import query
from ledgerfold.plans.sqlbits import PREFIX_RULE, actions_sql
from ledgerfold.sources import bindings

L = _LABELLED_SQL


@query("class_balance", f"""
SELECT target, label, n, round(n * 100.0 / sum(n) OVER (PARTITION BY target), 6) AS pct FROM (
  SELECT 'over_budget' AS target, over_budget AS label, CAST(count(*) AS BIGINT) AS n FROM {L} t WHERE over_budget IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'late', late, CAST(count(*) AS BIGINT) FROM {L} t WHERE late IS NOT NULL GROUP BY 2) x""")
def class_balance(spark, sf_dir):
    """Class counts and shares per target (NULL labels excluded)."""
    return rounded(quality.class_balance(labelled_history(spark, sf_dir), ["over_budget", "late"]))


_NP_COLS = ["base_all_options", "base_exercised_options", "current_completion_date", "description",
            "num_offers", "reason_for_mod"]


@query("null_profile", "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, "
     f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS pct_null FROM {_HOLEY_SQL} h" for c in _NP_COLS]
    + [f"SELECT 'all_dollar_and_date', CAST(count(*) FILTER (WHERE base_all_options IS NULL AND base_exercised_options IS NULL "
       f"AND current_completion_date IS NULL) AS BIGINT), round(count(*) FILTER (WHERE base_all_options IS NULL AND "
       f"base_exercised_options IS NULL AND current_completion_date IS NULL) * 100.0 / count(*), 6) FROM {_HOLEY_SQL} h"]) + ") x")
def null_profile(spark, sf_dir):
    """NULL counts/percent of critical columns on typed actions ('None' offers → NULL)."""
    a = labels.typed_actions(history_actions(spark, sf_dir).transform(_holey))
    return rounded(quality.null_profile(a, _NP_COLS, {"all_dollar_and_date": [
        "base_all_options", "base_exercised_options", "current_completion_date"]}))


@query("mods_per_contract", f"""
SELECT CAST(count(*) AS BIGINT) AS n_contracts, round(CAST(median(k) AS DOUBLE), 6) AS median_mods, max(k) AS max_mods
FROM (SELECT piid, CAST(count(*) AS BIGINT) AS k FROM {_A_HIST} a WHERE piid IS NOT NULL GROUP BY piid) x""")
def mods_per_contract(spark, sf_dir):
    """Contracts, median and max modifications per contract."""
    a = filters.drop_null_keys(history_actions(spark, sf_dir))
    return rounded(quality.per_key_counts_profile(a, "piid"))


def _np_sql(c):
    return (f"SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS count, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
            f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"CAST(count(*) FILTER (WHERE {c} = 0) AS BIGINT) AS n_zero FROM {L} t")


@query("numeric_profile", f"SELECT * FROM ({_np_sql('cost_growth_pct')} UNION ALL {_np_sql('delay_days')}) x")
def numeric_profile(spark, sf_dir):
    """describe() of cost growth and delay, plus share at zero."""
    return rounded(quality.numeric_profile(labelled_history(spark, sf_dir), ["cost_growth_pct", "delay_days"]))


@query("overrun_rate_by_agency_top", f"""
SELECT agency, CAST(count(*) AS BIGINT) AS n, round(avg(over_budget), 6) AS over_budget_rate, round(avg(late), 6) AS late_rate
FROM {L} t SEMI JOIN (SELECT agency FROM {L} t2 GROUP BY agency ORDER BY count(*) DESC, agency ASC NULLS FIRST LIMIT 10) top USING (agency)
GROUP BY agency""")
def rate_in_top_agencies(spark, sf_dir):
    """Positive rates within the 10 agencies with most contracts."""
    return rounded(quality.rate_in_top(labelled_history(spark, sf_dir), "agency", ["over_budget", "late"], 10))


@query("overrun_rate_by_type_top", f"""
SELECT contract_type, CAST(count(*) AS BIGINT) AS n, round(avg(over_budget), 6) AS over_budget_rate, round(avg(late), 6) AS late_rate
FROM {L} t SEMI JOIN (SELECT contract_type FROM {L} t2 GROUP BY contract_type ORDER BY count(*) DESC, contract_type ASC NULLS FIRST LIMIT 5) top
USING (contract_type) GROUP BY contract_type""")
def rate_in_top_types(spark, sf_dir):
    """Positive rates within the 5 contract types with most contracts."""
    return rounded(quality.rate_in_top(labelled_history(spark, sf_dir), "contract_type", ["over_budget", "late"], 5))


_RATE_GROUPS = ["psc_category", "agency", "contract_type"]


@query("top_rates", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{g}' AS variable, {g} AS category, CAST(count(*) AS BIGINT) AS n, round(avg(over_budget), 6) AS over_budget_rate
FROM {L} t WHERE {g} IS NOT NULL GROUP BY {g} HAVING avg(over_budget) IS NOT NULL ORDER BY round(avg(over_budget), 6) DESC, {g} LIMIT 10) {g}_top""" for g in _RATE_GROUPS))
def top_rates(spark, sf_dir):
    """The ten categories with the highest over-budget rate, per variable (NULLs excluded, ties by category)."""
    lab = labelled_history(spark, sf_dir)
    parts = [quality.top_k(rounded(quality.rate_by(lab.filter(F.col(g).isNotNull()), g, ["over_budget"])), "over_budget_rate", 10, g)
             .select(F.lit(g).alias("variable"), F.col(g).alias("category"), "n", "over_budget_rate") for g in _RATE_GROUPS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("share_zero_on_time", f"""
SELECT CAST(count(cost_growth_pct) AS BIGINT) AS n_growth, CAST(count(*) FILTER (WHERE cost_growth_pct = 0) AS BIGINT) AS n_zero_growth,
  round(count(*) FILTER (WHERE cost_growth_pct = 0) * 1.0 / nullif(count(cost_growth_pct), 0), 6) AS share_zero_growth,
  CAST(count(delay_days) AS BIGINT) AS n_delay, CAST(count(*) FILTER (WHERE delay_days <= 0) AS BIGINT) AS n_on_time,
  round(count(*) FILTER (WHERE delay_days <= 0) * 1.0 / nullif(count(delay_days), 0), 6) AS share_on_time FROM {L} t""")
def share_zero_on_time(spark, sf_dir):
    """Share of contracts at zero growth, and on time (delay of no day), of those where it is known."""
    return rounded(quality.share_zero_on_time(labelled_history(spark, sf_dir), "cost_growth_pct", "delay_days"))


@query("rate_min_support", f"""
SELECT vendor, agency, CAST(count(*) AS BIGINT) AS n, round(avg(over_budget), 6) AS over_budget_rate, round(avg(late), 6) AS late_rate
FROM {L} t GROUP BY vendor, agency HAVING count(*) >= 10""")
def rate_min_support(spark, sf_dir):
    """Rates by (vendor, agency) keeping groups with at least 10 contracts."""
    return rounded(quality.rate_by(labelled_history(spark, sf_dir), ["vendor", "agency"], ["over_budget", "late"],
                                   min_support=10))


@query("cost_growth_histogram", f"""
SELECT bin, round(-100.0 + (bin - 1) * (200.0 - -100.0) / 50, 6) AS bin_lo, round(-100.0 + bin * (200.0 - -100.0) / 50, 6) AS bin_hi,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT CAST(least(floor((x - -100.0) * 50 / (200.0 - -100.0)) + 1, 50) AS INTEGER) AS bin
      FROM (SELECT greatest(-100.0, least(200.0, cost_growth_pct)) AS x FROM {L} t WHERE cost_growth_pct IS NOT NULL) c) b
GROUP BY bin""")
def cost_growth_histogram(spark, sf_dir):
    """A15 + C18: 50 equal-width bins of cost growth clipped to [-100, 200]."""
    from ledgerfold.functions.scalars import clip
    lab = labelled_history(spark, sf_dir).withColumn("x", clip("cost_growth_pct", -100.0, 200.0))
    return rounded(quality.histogram(lab, "x", 50, -100.0, 200.0).drop("lo", "hi"))


@query("delay_box_stats", f"""
WITH x AS (SELECT CAST(delay_days AS DOUBLE) AS x FROM {L} t WHERE delay_days IS NOT NULL),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM x)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers,
  round(q3 - q1, 6) AS iqr
FROM x, q GROUP BY q1, median, q3""")
def delay_box_stats(spark, sf_dir):
    """Box-plot statistics of the delay in days."""
    return rounded(quality.box_stats(labelled_history(spark, sf_dir), "delay_days"))


_CORR_COLS = ["initial_cost", "final_cost", "cost_growth_pct", "delay_days", "num_modifications", "num_offers"]


@query("correlation_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM {L} t"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]) + ") p")
def correlation_pairs(spark, sf_dir):
    """Pearson correlation matrix (strict lower triangle), pairwise-complete."""
    return rounded(quality.correlation_pairs(labelled_history(spark, sf_dir), _CORR_COLS))


_FEATS = ["initial_cost", "num_modifications", "num_offers", "terminated_for_default", "delay_days"]
_OUTS = ["over_budget", "late"]


@query("correlation_ranked", f"""
SELECT outcome, feature, round(r, 6) AS r,
  CAST(row_number() OVER (PARTITION BY outcome ORDER BY abs(r) DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM (""" + " UNION ALL ".join(
    f"SELECT '{o}' AS outcome, '{f}' AS feature, corr(CAST({f} AS DOUBLE), CAST({o} AS DOUBLE)) AS r FROM {L} t"
    for o in _OUTS for f in _FEATS) + ") p")
def correlation_ranked(spark, sf_dir):
    """Correlations with each outcome ranked by absolute value."""
    return rounded(quality.correlation_ranked(labelled_history(spark, sf_dir), _FEATS, _OUTS))


@query("text_quality", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(text) AS BIGINT) AS n_non_null,
  round(avg(COALESCE(length(text), 0)), 6) AS mean_length, round(CAST(median(COALESCE(length(text), 0)) AS DOUBLE), 6) AS median_length,
  CAST(count(*) FILTER (WHERE COALESCE(length(text), 0) < 50) AS BIGINT) AS n_lt_50,
  CAST(count(*) FILTER (WHERE COALESCE(length(text), 0) < 100) AS BIGINT) AS n_lt_100,
  CAST(count(*) FILTER (WHERE COALESCE(length(text), 0) > 500) AS BIGINT) AS n_gt_500,
  CAST(count(*) FILTER (WHERE COALESCE(length(text), 0) >= 50 AND COALESCE(length(text), 0) < 100) AS BIGINT) AS n_50_99,
  CAST(count(*) FILTER (WHERE COALESCE(length(text), 0) >= 100) AS BIGINT) AS n_ge_100,
  round(count(*) FILTER (WHERE COALESCE(length(text), 0) >= 100) * 100.0 / count(*), 6) AS pct_track_a
FROM documents""")
def text_quality(spark, sf_dir):
    """Description (document text) quality profile and track split."""
    d = bindings.table(spark, sf_dir, "documents").select("text")
    return rounded(quality.text_quality(d, "text").withColumn("median_length", F.col("median_length").cast("double")))


@query("guard_rails", f"""
SELECT * FROM (
SELECT 'minority_over_budget' AS "check", round(least(avg(over_budget), 1 - avg(over_budget)), 6) AS value, CAST(0.1 AS DOUBLE) AS threshold,
       COALESCE(least(avg(over_budget), 1 - avg(over_budget)) < 0.1, false) AS triggered FROM {L} t
UNION ALL SELECT 'minority_late', round(least(avg(late), 1 - avg(late)), 6), 0.1, COALESCE(least(avg(late), 1 - avg(late)) < 0.1, false) FROM {L} t
UNION ALL SELECT 'short_descriptions', round(avg(CAST(COALESCE(length(description), 0) < 50 AS DOUBLE)), 6), 0.5,
       COALESCE(avg(CAST(COALESCE(length(description), 0) < 50 AS DOUBLE)) > 0.5, false) FROM {L} t
UNION ALL SELECT 'few_contracts', CAST(count(*) AS DOUBLE), 1000.0, count(*) < 1000 FROM {L} t
UNION ALL SELECT 'psc_filter_removed', round(avg(CAST(NOT {PREFIX_RULE} AS DOUBLE)), 6), 0.1,
       COALESCE(avg(CAST(NOT {PREFIX_RULE} AS DOUBLE)) > 0.1, false) FROM ({actions_sql(['psc'])}) a) g""")
def guard_rails(spark, sf_dir):
    """decision-point checks as (check, value, threshold, triggered) rows."""
    lab = labelled_history(spark, sf_dir)
    ob, lt = F.avg("over_budget"), F.avg("late")
    checks = [("minority_over_budget", F.least(ob, 1 - ob), 0.1, "<"),
              ("minority_late", F.least(lt, 1 - lt), 0.1, "<"),
              ("short_descriptions", F.avg((F.coalesce(F.length("description"), F.lit(0)) < 50).cast("double")), 0.5, ">"),
              ("few_contracts", F.count(F.lit(1)), 1000.0, "<")]
    a = bindings.actions(spark, sf_dir, ["psc"])
    removed = [("psc_filter_removed", F.avg((~filters.is_physical_prefix("psc")).cast("double")), 0.1, ">")]
    return rounded(quality.guard_rails(checks, lab).unionByName(quality.guard_rails(removed, a)))


@query("top_overruns", f"""
SELECT piid, round(cost_growth_pct, 6) AS cost_growth_pct, round(initial_cost, 6) AS initial_cost, round(final_cost, 6) AS final_cost
FROM {L} t WHERE cost_growth_pct IS NOT NULL ORDER BY cost_growth_pct DESC, piid LIMIT 5""")
def top_overruns(spark, sf_dir):
    """The five largest cost growths (NULLs excluded, ties by piid)."""
    lab = labelled_history(spark, sf_dir)
    return rounded(quality.top_k(lab, "cost_growth_pct", 5, "piid")
                   .select("piid", "cost_growth_pct", "initial_cost", "final_cost"))


@query("top_delays", f"""
SELECT piid, CAST(delay_days AS BIGINT) AS delay_days FROM {L} t WHERE delay_days IS NOT NULL ORDER BY delay_days DESC, piid LIMIT 5""")
def top_delays(spark, sf_dir):
    """The five longest delays (NULLs excluded, ties by piid)."""
    return quality.top_k(labelled_history(spark, sf_dir), "delay_days", 5, "piid").select("piid", F.col("delay_days").cast("bigint").alias("delay_days"))


_SAMPLE_SQL = (f"(SELECT piid FROM (SELECT DISTINCT piid FROM {_A_HIST} a WHERE piid IS NOT NULL) k "
               f"ORDER BY md5('42:' || CAST(piid AS VARCHAR)), piid LIMIT 500)")


@query("sample_contracts", f"SELECT piid FROM {_SAMPLE_SQL} s")
def sample_contracts(spark, sf_dir):
    """500 contracts without replacement, deterministic md5 order with seed 42."""
    return filters.sample_keys(history_actions(spark, sf_dir), 500, "piid", 42)


@query("sampled_actions_semi", f"""
SELECT piid, mod_number, action_id FROM {_A_HIST} a SEMI JOIN {_SAMPLE_SQL} s USING (piid)""")
def sampled_actions_semi(spark, sf_dir):
    """Every action of the sampled contracts (whole histories kept)."""
    a = history_actions(spark, sf_dir)
    return filters.keep_sampled(a, filters.sample_keys(a, 500, "piid", 42)).select("piid", "mod_number", "action_id")


@query("retention_by_group", f"""
SELECT shard, rows_in, rows_kept, round(rows_kept * 100.0 / rows_in, 6) AS pct_kept,
  CAST(sum(rows_in) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_in,
  CAST(sum(rows_kept) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_kept
FROM (SELECT strftime(current_completion_date, '%Y') AS shard, CAST(count(*) AS BIGINT) AS rows_in,
             CAST(count(*) FILTER (WHERE {PREFIX_RULE}) AS BIGINT) AS rows_kept
      FROM ({actions_sql(['psc', 'current_completion_date'])}) a GROUP BY 1) s""")
def retention_by_group(spark, sf_dir):
    """Per-shard (ship year) rows in / kept by the supply-code filter, running totals."""
    a = bindings.actions(spark, sf_dir, ["psc", "current_completion_date"])
    return rounded(quality.retention_by_group(a, F.date_format("current_completion_date", "yyyy"),
                                              filters.is_physical_prefix("psc")))


@query("summary_long", f"""
SELECT * FROM (
  SELECT 'run' AS section, 'n_actions' AS metric, CAST(count(*) AS DOUBLE) AS value FROM ({actions_sql(['psc'])}) a
  UNION ALL SELECT 'run', 'n_after_psc_filter', CAST(count(*) FILTER (WHERE {PREFIX_RULE}) AS DOUBLE) FROM ({actions_sql(['psc'])}) a
  UNION ALL SELECT 'run', 'n_final', CAST(count(*) AS DOUBLE) FROM {L} t
  UNION ALL SELECT 'run', 'threshold_used', max(threshold_used) FROM {L} t
  UNION ALL SELECT 'class_balance', 'over_budget_rate', round(avg(over_budget), 6) FROM {L} t
  UNION ALL SELECT 'class_balance', 'late_rate', round(avg(late), 6) FROM {L} t
  UNION ALL SELECT 'text_quality', 'mean_description_length', round(avg(COALESCE(length(description), 0)), 6) FROM {L} t
  UNION ALL SELECT 'text_quality', 'pct_description_lt_50', round(avg(CAST(COALESCE(length(description), 0) < 50 AS DOUBLE)) * 100, 6) FROM {L} t
) s""")
def summary_long(spark, sf_dir):
    """Run metadata, class balance and text quality as (section, metric, value) rows."""
    a = bindings.actions(spark, sf_dir, ["psc"])
    lab = labelled_history(spark, sf_dir)
    L_ = F.coalesce(F.length("description"), F.lit(0))

    # aggregate expressions inside the array: one pass per source table
    ra = a.agg(F.count(F.lit(1)).alias("n"), F.count_if(filters.is_physical_prefix("psc")).alias("k"))
    ra = ra.select(F.explode(F.array(F.struct(F.lit("run").alias("section"), F.lit("n_actions").alias("metric"),
                                              F.col("n").cast("double").alias("value")),
                                     F.struct(F.lit("run").alias("section"), F.lit("n_after_psc_filter").alias("metric"),
                                              F.col("k").cast("double").alias("value"))))
                   .alias("x")).select("x.*")
    rl = lab.agg(F.count(F.lit(1)).alias("n"), F.max("threshold_used").alias("t"), F.avg("over_budget").alias("ob"),
                 F.avg("late").alias("lt"), F.avg(L_).alias("ml"), (F.avg((L_ < 50).cast("double")) * 100).alias("p50"))
    items = [("run", "n_final", "n"), ("run", "threshold_used", "t"), ("class_balance", "over_budget_rate", "ob"),
             ("class_balance", "late_rate", "lt"), ("text_quality", "mean_description_length", "ml"),
             ("text_quality", "pct_description_lt_50", "p50")]
    rl = rl.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"),
                                                F.col(c).cast("double").alias("value")) for s, m, c in items]))
                   .alias("x")).select("x.*")
    return rounded(ra.unionByName(rl))


@query("example_texts", """
SELECT kind, doc_id, left(text, 80) AS text FROM (
  SELECT * FROM (SELECT 'short' AS kind, doc_id, text FROM documents WHERE length(text) < 100 ORDER BY doc_id LIMIT 5) a
  UNION ALL SELECT * FROM (SELECT 'long' AS kind, doc_id, text FROM documents WHERE length(text) > 500 ORDER BY doc_id LIMIT 5) b) x""")
def example_texts(spark, sf_dir):
    """The first five short and long texts by key, cut to 80 characters (the report's limit)."""
    d = bindings.table(spark, sf_dir, "documents").select("doc_id", "text")
    short = quality.examples(d, "text", "doc_id", 5, 80, short_below=100)
    long = quality.examples(d, "text", "doc_id", 5, 80, long_above=500)
    return short.select(F.lit("short").alias("kind"), "doc_id", "text").unionByName(long.select(F.lit("long").alias("kind"), "doc_id", "text"))


@query("link_guard_rails", f"""
WITH n AS (SELECT count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT 'no_linked_rows' AS "check", n::DOUBLE AS value, 1.0::DOUBLE AS threshold, n < 1 AS triggered FROM n
UNION ALL SELECT 'few_linked_rows', n::DOUBLE, 10.0::DOUBLE, n < 10 FROM n""")
def link_guard_rails(spark, sf_dir):
    """stop (no linked rows) and warning (fewer than ten) of the link validation."""
    links = linkage.link_substring(bindings.programs(spark, sf_dir), "program_id", "program_name",
                                   bindings.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    n = F.count(F.lit(1))
    return rounded(quality.guard_rails([("no_linked_rows", n, 1.0, "<"), ("few_linked_rows", n, 10.0, "<")], links))
