"""DuckDB SQL fragments mirroring ``ledgerfold.sources.bindings`` for the oracle."""

from __future__ import annotations

_ACTION_SQL = {
    "piid": ("lineitem", "l.l_orderkey"),
    "mod_number": ("lineitem", "CAST(l.l_linenumber AS VARCHAR)"),
    "action_id": ("lineitem", "l.l_partkey"),
    "current_completion_date": ("lineitem", "l.l_shipdate"),
    "ultimate_completion_date": ("lineitem", "l.l_shipdate + to_days(CAST(l.l_quantity AS INTEGER))"),
    "base_all_options": ("lineitem", "l.l_extendedprice"),
    "base_exercised_options": ("lineitem", "l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)"),
    "obligated_amount": ("lineitem", "l.l_extendedprice * (1 - l.l_discount)"),
    "num_offers": ("lineitem", "TRY_CAST(CASE WHEN l.l_linenumber = 7 THEN 'None' ELSE CAST(l.l_quantity AS VARCHAR) END AS DOUBLE)"),
    "reason_for_mod": ("lineitem", "CASE l.l_returnflag WHEN 'R' THEN 'TERMINATE FOR DEFAULT' WHEN 'A' THEN 'ADDITIONAL WORK' END"),
    "effective_date": ("orders", "o.o_orderdate"),
    "signed_date": ("orders", "o.o_orderdate"),
    "contract_type": ("orders", "o.o_orderpriority"),
    "extent_competed": ("customer", "c.c_mktsegment"),
    "agency_id": ("customer", "CAST(c.c_nationkey AS VARCHAR)"),
    "vendor_name": ("supplier", "s.s_name"),
    "state_code": ("supplier", "CAST(s.s_nationkey AS VARCHAR)"),
    "psc": ("part", "CASE WHEN p.p_type LIKE 'PROMO%' THEN 'Y1AA' WHEN p.p_type LIKE 'SMALL%' THEN 'z2aa' "
                    "WHEN p.p_type LIKE 'ECONOMY%' THEN 'R425' WHEN p.p_type LIKE 'MEDIUM%' THEN lpad(CAST(p.p_size AS VARCHAR), 2, '0') "
                    "ELSE lpad(CAST(p.p_size AS VARCHAR), 2, '0') || '20' END"),
    "description": ("part", "p.p_name"),
    "naics": ("part", "p.p_brand"),
}


def actions_sql(cols: list[str] | None = None) -> str:
    """SELECT producing the action view (typed: num_offers already numeric)."""
    want = list(dict.fromkeys(["piid", "mod_number", "action_id"] + list(cols or _ACTION_SQL)))
    need = {_ACTION_SQL[c][0] for c in want}
    frm = "lineitem l"
    if need & {"orders", "customer"}:
        frm += " JOIN orders o ON l.l_orderkey = o.o_orderkey"
        if "customer" in need:
            frm += " JOIN customer c ON o.o_custkey = c.c_custkey"
    if "part" in need:
        frm += " JOIN part p ON l.l_partkey = p.p_partkey"
    if "supplier" in need:
        frm += " JOIN supplier s ON l.l_suppkey = s.s_suppkey"
    sel = ", ".join(f"{_ACTION_SQL[c][1]} AS {c}" for c in want)
    return f"SELECT {sel} FROM {frm}"


PREFIX_RULE = "COALESCE(regexp_matches(psc, '^([YyZz]|[1-9][0-9])'), false)"
WHOLE_RULE = ("COALESCE(upper(regexp_replace(psc, '^\\s+|\\s+$', '', 'g')) LIKE 'Y%' "
              "OR upper(regexp_replace(psc, '^\\s+|\\s+$', '', 'g')) LIKE 'Z%' "
              "OR regexp_matches(upper(regexp_replace(psc, '^\\s+|\\s+$', '', 'g')), '^\\+?0*[1-9][0-9]$'), false)")
MOD_KEY = "COALESCE(TRY_CAST(regexp_extract(mod_number, '(\\d+)', 1) AS BIGINT), 0)"


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS BIGINT)"


def history_fold_sql(actions: str) -> str:
    """History fold over a CTE/table name ``actions`` (typed)."""
    return f"""
    SELECT piid, CAST(count(*) AS BIGINT) AS num_modifications,
      arg_min(description, ord) AS description,
      arg_min(base_all_options, ord) AS initial_cost,
      arg_min(current_completion_date, ord) AS initial_completion_date,
      arg_min(effective_date, ord) AS effective_date,
      arg_min(contract_type, ord) AS contract_type,
      arg_min(extent_competed, ord) AS competition,
      arg_min(num_offers, ord) AS num_offers,
      arg_min(agency_id, ord) AS agency,
      arg_min(vendor_name, ord) AS vendor,
      arg_min(psc, ord) AS psc,
      COALESCE(arg_max(base_exercised_options, ord), arg_max(base_all_options, ord)) AS final_cost,
      arg_max(current_completion_date, ord) AS final_completion_date,
      COALESCE(max(CAST(regexp_matches(upper(reason_for_mod), 'DEFAULT|TERMINAT') AS INTEGER)), 0) AS terminated_for_default
    FROM (SELECT *, struct_pack(m := {MOD_KEY}, t0 := current_completion_date, t1 := action_id) AS ord
          FROM {actions} WHERE piid IS NOT NULL) x
    GROUP BY piid"""


def history_labels_sql(actions: str, threshold: float = 5.0, fallback: float = 1.0,
                       min_rate: float = 0.05) -> str:
    """Full history labelling (before the usable filter) as a sub-select."""
    return f"""
    SELECT *, CASE WHEN rate < {min_rate} THEN CAST({fallback} AS DOUBLE) ELSE CAST({threshold} AS DOUBLE) END AS threshold_used,
      CASE WHEN cost_growth_pct IS NOT NULL THEN CAST(cost_growth_pct > CASE WHEN rate < {min_rate} THEN {fallback} ELSE {threshold} END AS INTEGER) END AS over_budget
    FROM (
      SELECT *, avg(CASE WHEN cost_growth_pct IS NOT NULL THEN CAST(cost_growth_pct > {threshold} AS DOUBLE) END) OVER () AS rate
      FROM (
        SELECT *, CASE WHEN initial_cost > 0 AND final_cost IS NOT NULL THEN (final_cost - initial_cost) / initial_cost * 100.0 END AS cost_growth_pct,
          {days('final_completion_date', 'initial_completion_date')} AS delay_days,
          CASE WHEN {days('final_completion_date', 'initial_completion_date')} IS NOT NULL
               THEN CAST({days('final_completion_date', 'initial_completion_date')} > 0 AS INTEGER) END AS late,
          upper(substr(psc, 1, 1)) AS psc_category
        FROM ({history_fold_sql(actions)}) f) g) h"""


USABLE = ("(over_budget IS NOT NULL OR late IS NOT NULL) AND COALESCE(initial_cost, 0) > 0 "
          "AND description IS NOT NULL AND trim(description) <> ''")
