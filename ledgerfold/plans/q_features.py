"""Catalogue: structured features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import scalars
from ledgerfold.operators import features, quality
from ledgerfold.plans.common import rounded
from ledgerfold.plans.q_labels import _LABELLED_SQL, labelled_history
from ledgerfold.plans.registry import query
from ledgerfold.plans.sqlbits import days
from ledgerfold.sources import bindings

L = _LABELLED_SQL

_TIER_SQL = ("CASE WHEN v > 0 AND v <= 1e6 THEN '<1M' WHEN v > 1e6 AND v <= 5e6 THEN '1M-5M' "
             "WHEN v > 5e6 AND v <= 25e6 THEN '5M-25M' WHEN v > 25e6 AND v <= 100e6 THEN '25M-100M' "
             "WHEN v > 100e6 THEN '>100M' END")


@query("value_tier", f"""
SELECT piid, round(v, 6) AS contract_value, {_TIER_SQL} AS value_tier
FROM (SELECT o_orderkey AS piid, o_totalprice * 100 AS v FROM orders) o""")
def value_tier(spark, sf_dir):
    """Right-closed value tiers over order value ×100 (spans every tier edge)."""
    o = bindings.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("piid"),
                                                       (F.col("o_totalprice") * 100).alias("contract_value"))
    return rounded(o.withColumn("value_tier", scalars.value_tier("contract_value")))


@query("psc_category4", f"""
SELECT psc_category4, CAST(count(*) AS BIGINT) AS n, round(avg(over_budget), 6) AS over_budget_rate, round(avg(late), 6) AS late_rate
FROM (SELECT *, CASE upper(substr(COALESCE(psc, 'U'), 1, 1)) WHEN 'Y' THEN 'Y_construction' WHEN 'Z' THEN 'Z_maintenance'
        ELSE CASE WHEN regexp_matches(upper(substr(COALESCE(psc, 'U'), 1, 1)), '^[0-9]$') THEN 'num_supplies' ELSE 'OTHER' END END
        AS psc_category4 FROM {L} t) x GROUP BY psc_category4""")
def psc_category4(spark, sf_dir):
    """C17 + A13: four-way supply category and its rates."""
    lab = labelled_history(spark, sf_dir).withColumn("psc_category4", scalars.psc_category4("psc"))
    return rounded(quality.rate_by(lab, "psc_category4", ["over_budget", "late"]))


@query("calendar_features", f"""
SELECT piid, CAST(year(effective_date) AS INTEGER) AS contract_start_year, CAST(quarter(effective_date) AS INTEGER) AS contract_start_quarter,
  CAST(month(effective_date) AS INTEGER) AS contract_start_month, CAST(month(effective_date) = 9 AS INTEGER) AS is_end_of_fiscal_year,
  CAST(year(effective_date) - 2015 AS INTEGER) AS years_since_2015,
  {days('initial_completion_date', 'effective_date')} AS contract_duration_planned_days
FROM {L} t""")
def calendar_features(spark, sf_dir):
    """C20: calendar features of the award start (effective date) and planned duration."""
    lab = labelled_history(spark, sf_dir)
    return features.temporal_features(lab, "effective_date", "initial_completion_date").select(
        "piid", "contract_start_year", "contract_start_quarter", "contract_start_month", "is_end_of_fiscal_year",
        "years_since_2015", "contract_duration_planned_days")


def _structured(spark, sf_dir):
    lab = labelled_history(spark, sf_dir)
    lab = features.temporal_features(lab, "effective_date", "initial_completion_date")
    return features.structured_features(lab, "initial_cost")


_SF_SQL = f"""(SELECT piid, lb AS log_base_value, offers AS num_offers_imputed,
   lb * ln(1 + mods) AS size_x_mods, offers * lb AS competition_x_size, eofy * lb AS eofy_x_size,
   sign(dur) * ln(1 + abs(dur)) AS log_duration_days
 FROM (SELECT piid, sign(COALESCE(initial_cost, 0)) * ln(1 + abs(COALESCE(initial_cost, 0))) AS lb,
         CAST(COALESCE(num_modifications, 1) AS DOUBLE) AS mods,
         COALESCE(num_offers, median(num_offers) OVER ()) AS offers,
         CAST(COALESCE(CAST(month(effective_date) = 9 AS INTEGER), 0) AS DOUBLE) AS eofy,
         CAST(COALESCE({days('initial_completion_date', 'effective_date')}, 365) AS DOUBLE) AS dur
       FROM {L} t) x)"""


@query("interaction_features", f"""
SELECT piid, round(log_base_value, 6) AS log_base_value, round(num_offers_imputed, 6) AS num_offers_imputed,
  round(size_x_mods, 6) AS size_x_mods, round(competition_x_size, 6) AS competition_x_size, round(eofy_x_size, 6) AS eofy_x_size,
  round(log_duration_days, 6) AS log_duration_days FROM {_SF_SQL} s""")
def interaction_features(spark, sf_dir):
    """Signed-log size, imputed offers, log duration and the three interactions."""
    f = _structured(spark, sf_dir)
    return rounded(f.select("piid", "log_base_value", "num_offers_imputed", "size_x_mods", "competition_x_size",
                            "eofy_x_size", "log_duration_days"))


@query("median_impute", f"""
SELECT piid, round(num_offers, 6) AS num_offers, round(COALESCE(num_offers, median(num_offers) OVER ()), 6) AS num_offers_imputed
FROM {L} t""")
def median_impute(spark, sf_dir):
    """Offers received with NULL → exact median."""
    lab = labelled_history(spark, sf_dir).select("piid", "num_offers")
    return rounded(features.median_impute(lab, "num_offers", "num_offers_imputed"))


def _grouped_sql(col, n):
    return (f"CASE WHEN COALESCE({col}, 'UNKNOWN') IN (SELECT lvl FROM (SELECT COALESCE({col}, 'UNKNOWN') AS lvl, count(*) AS c "
            f"FROM {L} t2 GROUP BY 1 ORDER BY c DESC, lvl LIMIT {n}) z) THEN COALESCE({col}, 'UNKNOWN') ELSE 'OTHER' END")


@query("rare_level_grouping", f"""
SELECT piid, {_grouped_sql('vendor', 10)} AS vendor_grouped, {_grouped_sql('agency', 8)} AS agency_grouped FROM {L} t""")
def rare_level_grouping(spark, sf_dir):
    """M8: vendors outside the top 10 and agencies outside the top 8 become OTHER."""
    lab = labelled_history(spark, sf_dir).select("piid", "vendor", "agency")
    g = features.rare_level_grouping(lab, "vendor", 10, "vendor_grouped")
    g = features.rare_level_grouping(g, "agency", 8, "agency_grouped")
    return g.select("piid", "vendor_grouped", "agency_grouped")


_CT = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_EC = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT piid, " + ", ".join(
    [f"CAST(COALESCE(contract_type, 'UNKNOWN') = '{v}' AS INTEGER) AS \"contract_type_{v}\"" for v in _CT]
    + [f"CAST(COALESCE(competition, 'UNKNOWN') = '{v}' AS INTEGER) AS \"extent_competed_{v}\"" for v in _EC])
    + f" FROM {L} t")
def one_hot(spark, sf_dir):
    """M7 (+M8): one-hot of grouped contract type and competition level, all levels kept."""
    lab = labelled_history(spark, sf_dir).select("piid", "contract_type", "competition")
    g = features.rare_level_grouping(lab, "contract_type", 10, "ct")
    g = features.rare_level_grouping(g, "competition", 8, "ec")
    g = features.one_hot(g, "ct", "contract_type")
    g = features.one_hot(g, "ec", "extent_competed")
    return g.drop("contract_type", "competition", "ct", "ec")


_TEMPORAL_SQL = f"""(SELECT piid, CAST(year(effective_date) AS INTEGER) AS y, CAST(quarter(effective_date) AS INTEGER) AS q, CAST(month(effective_date) AS INTEGER) AS m,
  CAST(month(effective_date) = 9 AS INTEGER) AS e, {days('initial_completion_date', 'effective_date')} AS d FROM {L} t WHERE piid % 7 <> 3)"""
_TEMPORAL = ["contract_start_year", "contract_start_quarter", "contract_start_month", "is_end_of_fiscal_year", "years_since_2015", "contract_duration_planned_days"]


def _temporal_join(spark, sf_dir):
    """The labelled contracts and a temporal table that lacks every seventh of them."""
    lab = labelled_history(spark, sf_dir)
    t = features.temporal_features(lab, "effective_date", "initial_completion_date").filter(F.col("piid") % 7 != 3).select("piid", *_TEMPORAL)
    return features.join_temporal(lab.select("piid"), t, "piid")


@query("temporal_join", f"""
SELECT l.piid, COALESCE(y, CAST(floor(median(y) OVER ()) AS INTEGER)) AS contract_start_year, COALESCE(q, 1) AS contract_start_quarter, COALESCE(m, 1) AS contract_start_month,
  COALESCE(e, 0) AS is_end_of_fiscal_year, COALESCE(y - 2015, CAST(trunc(median(y - 2015) OVER ()) AS INTEGER)) AS years_since_2015,
  CAST(COALESCE(d, 365) AS INTEGER) AS contract_duration_planned_days FROM {L} l LEFT JOIN {_TEMPORAL_SQL} t USING (piid)""")
def temporal_join(spark, sf_dir):
    """Contracts left-joined to temporal features, unmatched ones with the defaults."""
    return _temporal_join(spark, sf_dir)[0].select("piid", *_TEMPORAL)


@query("temporal_match_rate", f"""
SELECT count(*) AS n_rows, count(t.piid) AS n_matched, round(count(t.piid) / count(*)::DOUBLE, 6) AS match_rate FROM {L} l LEFT JOIN {_TEMPORAL_SQL} t USING (piid)""")
def temporal_match_rate(spark, sf_dir):
    """Share of contracts that have temporal features."""
    return rounded(_temporal_join(spark, sf_dir)[1])


@query("inner_alignment", """
SELECT count(DISTINCT l.doc_id) AS n_left, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) >= 100) AS n_right,
  (SELECT count(DISTINCT doc_id) FROM labels JOIN documents USING (doc_id) WHERE length(text) >= 100) AS n_both FROM labels l""")
def inner_alignment(spark, sf_dir):
    """Labelled documents and documents long enough for topics, aligned on the keys that both have."""
    left = bindings.table(spark, sf_dir, "labels").select("doc_id", "quality")
    right = bindings.table(spark, sf_dir, "documents").filter(F.length("text") >= 100).select("doc_id", "n_chars")
    return features.align_inner(left, right, "doc_id")[1]


@query("inf_to_zero", """
SELECT doc_id, round(CASE WHEN quality = 0 OR isinf(n_chars / quality::DOUBLE) OR isnan(n_chars / quality::DOUBLE) THEN 0 ELSE n_chars / quality::DOUBLE END, 6) AS ratio FROM documents JOIN labels USING (doc_id)""")
def inf_to_zero(spark, sf_dir):
    """C14: a ratio whose denominator may be 0 (an infinity there) becomes 0."""
    d = bindings.labelled_documents(spark, sf_dir)
    ratio = F.when(F.col("quality") == 0, F.lit(float("inf"))).otherwise(F.col("n_chars").cast("double") / F.when(F.col("quality") != 0, F.col("quality")))
    return rounded(d.select("doc_id", scalars.inf_to_zero(ratio).alias("ratio")))
