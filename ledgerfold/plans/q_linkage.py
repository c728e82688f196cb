"""Catalogue: program records (S18, G1, G2, G6, U6) and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import linkage
from ledgerfold.plans.common import rounded
from ledgerfold.plans.registry import query
from ledgerfold.sources import bindings, programs as prog
from ledgerfold.sources.tables import spread

_BRANCHES = ["Army", "Navy", "Air Force", "Marine Corps", "Space Force", "Joint", "DoD-wide"]


def program_records(spark, sf_dir):
    """Program records derived from the benchmark table, one per item, plus an overlapping
    copy (NULL current cost) of every item at a chunk boundary (item_id % 10 = 9)."""
    b = bindings.table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    base = F.length("text").cast("double") * 10
    cur = base + (F.pmod(i, F.lit(9)) - 3).cast("double") * 25
    growth = (cur - base) / base * 100 + F.when(F.pmod(i, F.lit(11)) == 4, F.lit(10.0)).otherwise(F.lit(0.0))
    y0 = 2005 + F.pmod(i, F.lit(10))
    m0 = F.pmod(i, F.lit(12))
    shift = F.pmod(i * 7, F.lit(40))
    tot = y0 * 12 + m0 + shift
    rec = b.select(
        i.alias("program_id"), F.col("text").alias("program_name"),
        (2003 + F.pmod(i, F.lit(23))).cast("int").alias("report_year"),
        F.element_at(F.array(*[F.lit(x) for x in _BRANCHES]), (F.pmod(i, F.lit(7)) + 1).cast("int")).alias("service_branch"),
        base.alias("baseline_cost_millions"), cur.alias("current_cost_millions"), growth.alias("cost_growth_percent"),
        F.concat(y0.cast("string"), F.lit("-"), F.lpad((m0 + 1).cast("string"), 2, "0")).alias("original_ioc_date"),
        F.concat(F.floor(tot / 12).cast("string"), F.lit("-"), F.lpad((F.pmod(tot, F.lit(12)) + 1).cast("string"), 2, "0"))
        .alias("current_ioc_date"),
        (shift + F.when(F.pmod(i, F.lit(13)) == 5, F.lit(3)).otherwise(F.lit(0))).cast("int").alias("schedule_delay_months"),
        F.when(F.pmod(i, F.lit(10)) != 0, growth > 15).alias("nunn_mccurdy_breach"),
        F.col("text").alias("primary_challenge"),
        F.floor(i / 10).alias("chunk"))
    copy = (rec.filter(F.pmod(F.col("program_id"), F.lit(10)) == 9)
               .withColumn("current_cost_millions", F.lit(None).cast("double"))
               .withColumn("chunk", F.col("chunk") + 1))
    both = rec.unionByName(copy)
    return both.withColumn("source_file", F.concat(F.lit("gao_"), F.col("report_year").cast("string"), F.lit("_chunk_"),
                                                   F.col("chunk").cast("string"), F.lit(".json"))).drop("chunk")


_REC_COLS = ["program_name", "report_year", "service_branch", "baseline_cost_millions", "current_cost_millions",
             "cost_growth_percent", "original_ioc_date", "current_ioc_date", "schedule_delay_months",
             "nunn_mccurdy_breach", "primary_challenge"]

_PROG_SQL = """(WITH r AS (SELECT item_id AS program_id, text AS program_name, CAST(2003 + item_id % 23 AS INTEGER) AS report_year,
    ['Army', 'Navy', 'Air Force', 'Marine Corps', 'Space Force', 'Joint', 'DoD-wide'][item_id % 7 + 1] AS service_branch,
    CAST(length(text) AS DOUBLE) * 10 AS baseline_cost_millions,
    CAST(length(text) AS DOUBLE) * 10 + CAST(item_id % 9 - 3 AS DOUBLE) * 25 AS current_cost_millions,
    (CAST(length(text) AS DOUBLE) * 10 + CAST(item_id % 9 - 3 AS DOUBLE) * 25 - CAST(length(text) AS DOUBLE) * 10)
      / (CAST(length(text) AS DOUBLE) * 10) * 100 + CASE WHEN item_id % 11 = 4 THEN 10.0 ELSE 0.0 END AS cost_growth_percent,
    CAST(2005 + item_id % 10 AS VARCHAR) || '-' || lpad(CAST(item_id % 12 + 1 AS VARCHAR), 2, '0') AS original_ioc_date,
    CAST(((2005 + item_id % 10) * 12 + item_id % 12 + (item_id * 7) % 40) // 12 AS VARCHAR) || '-' ||
      lpad(CAST(((2005 + item_id % 10) * 12 + item_id % 12 + (item_id * 7) % 40) % 12 + 1 AS VARCHAR), 2, '0') AS current_ioc_date,
    CAST((item_id * 7) % 40 + CASE WHEN item_id % 13 = 5 THEN 3 ELSE 0 END AS INTEGER) AS schedule_delay_months,
    CASE WHEN item_id % 10 <> 0 THEN (CAST(length(text) AS DOUBLE) * 10 + CAST(item_id % 9 - 3 AS DOUBLE) * 25 - CAST(length(text) AS DOUBLE) * 10)
      / (CAST(length(text) AS DOUBLE) * 10) * 100 + CASE WHEN item_id % 11 = 4 THEN 10.0 ELSE 0.0 END > 15 END AS nunn_mccurdy_breach,
    text AS primary_challenge, item_id // 10 AS chunk FROM benchmark)
  SELECT * EXCLUDE (chunk), 'gao_' || CAST(report_year AS VARCHAR) || '_chunk_' || CAST(chunk AS VARCHAR) || '.json' AS source_file FROM (
    SELECT * FROM r UNION ALL
    SELECT * REPLACE (CAST(NULL AS DOUBLE) AS current_cost_millions, chunk + 1 AS chunk) FROM r WHERE program_id % 10 = 9) u)"""


def parsed_programs(spark, sf_dir):
    """Records → one JSON array per source file (≤ 11 records) → from_json → inline."""
    rec = program_records(spark, sf_dir)
    files = rec.groupBy("source_file").agg(F.to_json(F.collect_list(F.struct(*_REC_COLS))).alias("json_text"))
    records, _rejects = prog.parse_program_arrays(files)
    return records


@query("program_json_inline", f"SELECT {', '.join(c if c not in ('baseline_cost_millions', 'current_cost_millions', 'cost_growth_percent') else f'round({c}, 6) AS {c}' for c in _REC_COLS)}, source_file FROM {_PROG_SQL} p")
def program_json_inline(spark, sf_dir):
    """Parse per-file JSON arrays of program records into rows."""
    return rounded(parsed_programs(spark, sf_dir).select(*_REC_COLS, "source_file"))


@query("program_dedupe", f"""
SELECT program_name, report_year,
  {', '.join(f"round(arg_min({c}, source_file), 6) AS {c}" if c in ('baseline_cost_millions', 'current_cost_millions', 'cost_growth_percent')
             else f"arg_min({c}, source_file) AS {c}" for c in _REC_COLS[2:])},
  min(source_file) AS source_file, CAST(count(*) AS BIGINT) AS n_copies
FROM {_PROG_SQL} p GROUP BY program_name, report_year""")
def program_dedupe(spark, sf_dir):
    """Overlapping chunks merged per (name, year), preferring non-NULL fields in file order."""
    return rounded(prog.dedupe_programs(parsed_programs(spark, sf_dir)))


_RULES_SQL = """SELECT program_name, report_year, source_file, rule, ok FROM (
  SELECT program_name, report_year, source_file,
    COALESCE(service_branch IS NULL OR service_branch IN ('Army', 'Navy', 'Air Force', 'Marine Corps', 'Space Force', 'Joint'), false) AS service_branch_allowed,
    COALESCE(report_year IS NOT NULL AND report_year BETWEEN 1000 AND 9999, false) AS report_year_4_digits,
    COALESCE(COALESCE(baseline_cost_millions, 0) >= 0 AND COALESCE(current_cost_millions, 0) >= 0, false) AS costs_non_negative_or_null,
    COALESCE((original_ioc_date IS NULL OR regexp_matches(original_ioc_date, '^[0-9]{4}-(0[1-9]|1[0-2])$'))
      AND (current_ioc_date IS NULL OR regexp_matches(current_ioc_date, '^[0-9]{4}-(0[1-9]|1[0-2])$')), false) AS ioc_dates_yyyy_mm
  FROM PROG p) w UNPIVOT (ok FOR rule IN (service_branch_allowed, report_year_4_digits, costs_non_negative_or_null, ioc_dates_yyyy_mm))"""


@query("program_validate", _RULES_SQL.replace("PROG", _PROG_SQL))
def program_validate(spark, sf_dir):
    """G1: schema/domain checks per extracted record."""
    return prog.validate_programs(parsed_programs(spark, sf_dir), ["program_name", "report_year", "source_file"])


@query("program_recompute", f"""
SELECT program_name, report_year, source_file, round(g, 6) AS growth_recomputed, d AS delay_recomputed,
  COALESCE(abs(g - cost_growth_percent) > 0.5, false) AS growth_disagrees,
  COALESCE(abs(d - schedule_delay_months) > 1, false) AS delay_disagrees
FROM (SELECT *, CASE WHEN baseline_cost_millions <> 0 THEN (current_cost_millions - baseline_cost_millions) / baseline_cost_millions * 100.0 END AS g,
  CAST((CAST(substr(current_ioc_date, 1, 4) AS INTEGER) * 12 + CAST(substr(current_ioc_date, 6, 2) AS INTEGER))
     - (CAST(substr(original_ioc_date, 1, 4) AS INTEGER) * 12 + CAST(substr(original_ioc_date, 6, 2) AS INTEGER)) AS INTEGER) AS d
  FROM {_PROG_SQL} p) x""")
def program_recompute(spark, sf_dir):
    """Recomputed cost growth and IOC delay vs the stated values."""
    r = prog.recompute_programs(parsed_programs(spark, sf_dir))
    return rounded(r.select("program_name", "report_year", "source_file", "growth_recomputed", "delay_recomputed",
                            "growth_disagrees", "delay_disagrees"))


@query("branch_breach_summary", f"""
SELECT service_branch, CAST(count(*) AS BIGINT) AS n_programs, CAST(count(*) FILTER (WHERE nunn_mccurdy_breach) AS BIGINT) AS n_breach,
  CAST(count(nunn_mccurdy_breach) AS BIGINT) AS n_breach_known
FROM (SELECT program_name, report_year, arg_min(service_branch, source_file) AS service_branch,
             arg_min(nunn_mccurdy_breach, source_file) AS nunn_mccurdy_breach FROM {_PROG_SQL} p GROUP BY ALL) d GROUP BY service_branch""")
def branch_breach_summary(spark, sf_dir):
    """Programs and Nunn-McCurdy breaches per service branch (deduplicated records)."""
    d = prog.dedupe_programs(parsed_programs(spark, sf_dir))
    return d.groupBy("service_branch").agg(F.count(F.lit(1)).alias("n_programs"),
                                           F.count_if(F.col("nunn_mccurdy_breach")).alias("n_breach"),
                                           F.count("nunn_mccurdy_breach").alias("n_breach_known"))


def _docs(spark, sf_dir):
    return spread(bindings.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _programs(spark, sf_dir):
    return bindings.programs(spark, sf_dir)


_SUBSTR_SQL = "(SELECT b.item_id AS program_id, d.doc_id, 100 AS match_score, 'substring_match' AS match_type FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("link_substring", f"SELECT program_id, doc_id, match_score, match_type FROM {_SUBSTR_SQL} s")
def link_substring(spark, sf_dir):
    """Exact containment of a program name in a document (rarest-bigram blocking + verify)."""
    return linkage.link_substring(_programs(spark, sf_dir), "program_id", "program_name", _docs(spark, sf_dir), "doc_id", "text")


def _dt_sql(tab, key, text):
    return f"""(SELECT DISTINCT {key} AS k, token FROM (
  SELECT {key}, unnest(list_distinct(list_concat(
     list_transform(regexp_extract_all({text}, '\\(([A-Z0-9 -]+)\\)', 1), lambda t: upper(trim(t))),
     list_transform(list_filter(regexp_split_to_array(COALESCE({text}, ''), '[^A-Za-z0-9-]+'),
        lambda t: regexp_matches(t, '^([A-Za-z]+-?[0-9][A-Za-z0-9-]*|[0-9]+-?[A-Za-z][A-Za-z0-9-]*)$')), lambda t: upper(t))))) AS token
  FROM {tab}) x WHERE length(token) > 0)"""


@query("distinctive_tokens", f"SELECT k AS doc_id, token FROM {_dt_sql('documents', 'doc_id', 'text')} t")
def distinctive_tokens(spark, sf_dir):
    """Acronyms in parentheses and letter+digit tokens of every document."""
    return linkage.distinctive_tokens(_docs(spark, sf_dir), "doc_id", "text").distinct()


_TOKEN_SQL = (f"(SELECT DISTINCT p.k AS program_id, d.k AS doc_id, 100 AS match_score, 'token_match' AS match_type "
              f"FROM {_dt_sql('benchmark', 'item_id', 'text')} p JOIN {_dt_sql('documents', 'doc_id', 'text')} d USING (token))")


@query("link_token", f"SELECT program_id, doc_id, match_score, match_type FROM {_TOKEN_SQL} t")
def link_token(spark, sf_dir):
    """Programs and documents sharing a distinctive token."""
    return linkage.link_token(_programs(spark, sf_dir), "program_id", "program_name", _docs(spark, sf_dir), "doc_id", "text")


@query("link_token_top", f"""
WITH t AS MATERIALIZED (SELECT k, token FROM {_dt_sql('pages', 'page_id', 'html')} x),
w AS (SELECT token, CAST(floor(1000 * ln(1 + (SELECT count(DISTINCT page_id) FROM pages)::DOUBLE / count(*))) AS BIGINT) AS weight FROM t GROUP BY token),
s AS (SELECT a.k AS program_id, b.k AS page_id, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS n_shared FROM t a JOIN t b USING (token) JOIN w USING (token)
      WHERE a.k % 20 = 0 GROUP BY ALL)
SELECT program_id, page_id, weight, n_shared, CAST(row_number() OVER (PARTITION BY program_id ORDER BY weight DESC, page_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def link_token_top(spark, sf_dir):
    """J8 by weight: the 5 pages that share the most distinctive-token weight with each page whose id is a multiple of 20.
    Two of the tokens are in every page."""
    d = bindings.table(spark, sf_dir, "pages").select("page_id", "html")
    p = d.filter(F.col("page_id") % 20 == 0).select(F.col("page_id").alias("program_id"), F.col("html").alias("name"))
    return linkage.link_token_top(p, "program_id", "name", d, "page_id", "html", 5, rare=100)


@query("link_short_names", """
SELECT n.name_id, d.doc_id FROM (SELECT item_id * 4 + j AS name_id, CASE j WHEN 0 THEN ws[2] WHEN 1 THEN ws[2] || ' ' || ws[3] WHEN 2 THEN ws[2] || ' ' || ws[3] || ' ' || ws[4] ELSE substr(ws[3], 2) || ' ' || left(ws[4], 2) END AS name
  FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark) b, range(4) AS t(j)) n JOIN documents d ON contains(d.text, n.name) WHERE n.name <> ''""")
def link_short_names(spark, sf_dir):
    """J9 for names of one to three tokens (and cut tokens), taken from the program names."""
    ws = F.split("program_name", " ")
    names = F.array(ws[1], F.concat_ws(" ", ws[1], ws[2]), F.concat_ws(" ", ws[1], ws[2], ws[3]),
                    F.concat_ws(" ", F.substring(ws[2], 2, 1000), F.substring(ws[3], 1, 2)))
    p = _programs(spark, sf_dir).select("program_id", F.posexplode(names).alias("j", "name")).select(
        (F.col("program_id") * 4 + F.col("j")).alias("name_id"), "name")
    return linkage.link_substring(p, "name_id", "name", _docs(spark, sf_dir), "doc_id", "text").select("name_id", "doc_id")


def _lines(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return (d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
             .withColumn("line_key", F.struct("doc_id", "line_no")))


_TS = "list_distinct(list_filter(regexp_split_to_array(lower(COALESCE({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 0))"
_FUZZY_SQL = f"""(SELECT program_id, doc_id, line_no, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM (
  SELECT b.item_id AS program_id, {_TS.format(x='b.text')} AS a, l.doc_id, l.line_no, {_TS.format(x='l.line')} AS b
  FROM benchmark b, (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no,
                            unnest(string_split(text, chr(10))) AS line FROM documents) l) x
  WHERE len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.85)"""


@query("link_fuzzy", f"SELECT program_id, doc_id, line_no, round(similarity, 6) AS similarity FROM {_FUZZY_SQL} f")
def link_fuzzy(spark, sf_dir):
    """Program names vs document lines with token-set Jaccard ≥ 0.85 (exact prefix-filter join)."""
    lines = _lines(spark, sf_dir)
    f = linkage.link_fuzzy(_programs(spark, sf_dir), "program_id", "program_name", lines, "line_key", "line", 0.85)
    return rounded(f.select("program_id", "line_key.doc_id", "line_key.line_no", "similarity"))


_BEST_SQL = f"""(WITH l AS (SELECT * FROM {_SUBSTR_SQL} s UNION ALL SELECT * FROM {_TOKEN_SQL} t UNION ALL
    SELECT program_id, doc_id, CAST(floor(max(similarity) * 100) AS INTEGER), 'fuzzy_match' FROM {_FUZZY_SQL} f GROUP BY program_id, doc_id),
  b AS (SELECT program_id, doc_id, arg_max(match_score, struct_pack(s := match_score, p := -CASE match_type WHEN 'substring_match' THEN 0 WHEN 'token_match' THEN 1 ELSE 2 END)) AS match_score,
               arg_max(match_type, struct_pack(s := match_score, p := -CASE match_type WHEN 'substring_match' THEN 0 WHEN 'token_match' THEN 1 ELSE 2 END)) AS match_type
        FROM l GROUP BY program_id, doc_id)
  SELECT * FROM b UNION ALL
  SELECT item_id, CAST(NULL AS BIGINT), 0, 'no_match' FROM benchmark WHERE item_id NOT IN (SELECT program_id FROM b))"""


def _best(spark, sf_dir):
    p, d = _programs(spark, sf_dir), _docs(spark, sf_dir)
    lines = _lines(spark, sf_dir)
    fz = (linkage.link_fuzzy(p, "program_id", "program_name", lines, "line_key", "line", 0.85)
          .groupBy("program_id", F.col("line_key.doc_id").alias("doc_id")).agg(F.floor(F.max("similarity") * 100).cast("int").alias("match_score"))
          .withColumn("match_type", F.lit("fuzzy_match")))
    links = (linkage.link_substring(p, "program_id", "program_name", d, "doc_id", "text")
             .unionByName(linkage.link_token(p, "program_id", "program_name", d, "doc_id", "text")).unionByName(fz))
    return linkage.best_links(links, p, "program_id", "doc_id")


@query("link_best", f"SELECT program_id, doc_id, match_score, match_type FROM {_BEST_SQL} b")
def link_best(spark, sf_dir):
    """Exact → token → fuzzy, best per (program, document); unlinked programs as no_match."""
    return _best(spark, sf_dir)


@query("label_join_match_rate", f"""
SELECT CAST(count(*) AS BIGINT) AS n_links, CAST(count(l.doc_id) AS BIGINT) AS n_with_label,
  round(count(l.doc_id) * 1.0 / count(*), 6) AS match_rate
FROM {_BEST_SQL} b LEFT JOIN labels l ON b.doc_id = l.doc_id WHERE b.match_type <> 'no_match'""")
def label_join_match_rate(spark, sf_dir):
    """Linked pairs left-joined to the labels, with the match rate."""
    links = _best(spark, sf_dir).filter(F.col("match_type") != "no_match")
    lab = bindings.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"))
    j = links.join(lab, links.doc_id == lab.l_doc, "left")
    return rounded(j.agg(F.count(F.lit(1)).alias("n_links"), F.count("l_doc").alias("n_with_label"),
                         (F.count("l_doc") * 1.0 / F.count(F.lit(1))).alias("match_rate")))


@query("link_agreement", f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(prog_over = doc_label AS DOUBLE)), 6) AS agreement,
  round(avg(CAST(prog_over AS DOUBLE)), 6) AS prog_over_rate, round(avg(CAST(doc_label AS DOUBLE)), 6) AS doc_label_rate,
  CAST(count(*) FILTER (WHERE prog_over = 0 AND doc_label = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE prog_over = 0 AND doc_label = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE prog_over = 1 AND doc_label = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE prog_over = 1 AND doc_label = 1) AS BIGINT) AS tp
FROM (SELECT COALESCE(CAST(d.cost_growth_percent > 5 AS INTEGER), 0) AS prog_over, l.quality AS doc_label
      FROM {_BEST_SQL} b JOIN (SELECT program_name, arg_min(cost_growth_percent, source_file) AS cost_growth_percent,
                                      min(report_year) AS ry FROM {_PROG_SQL} p GROUP BY program_name) d
        ON d.program_name = (SELECT text FROM benchmark WHERE item_id = b.program_id)
      JOIN labels l ON b.doc_id = l.doc_id WHERE b.match_type <> 'no_match') x WHERE prog_over IS NOT NULL AND doc_label IS NOT NULL""")
def link_agreement(spark, sf_dir):
    """Program over-budget flag (growth > 5, C24) vs the linked document's label."""
    links = _best(spark, sf_dir).filter(F.col("match_type") != "no_match")
    recs = parsed_programs(spark, sf_dir).groupBy("program_name").agg(
        F.min_by("cost_growth_percent", "source_file").alias("cost_growth_percent"))
    names = _programs(spark, sf_dir)
    lab = bindings.table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = (links.join(names, "program_id").join(recs, "program_name").join(lab, "doc_id")
              .select(F.coalesce((F.col("cost_growth_percent") > 5).cast("int"), F.lit(0)).alias("prog_over"),
                      F.col("quality").alias("doc_label")))
    return rounded(linkage.agreement(j, "prog_over", "doc_label"))


@query("link_fuzzy_wide", f"SELECT program_id, doc_id, line_no, round(similarity, 6) AS similarity FROM {_FUZZY_SQL.replace('0.85', '0.6')} f")
def link_fuzzy_wide(spark, sf_dir):
    """J10 at a similarity of 0.6 or more, which the test lines reach."""
    lines = _lines(spark, sf_dir)
    f = linkage.link_fuzzy(_programs(spark, sf_dir), "program_id", "program_name", lines, "line_key", "line", 0.6)
    return rounded(f.select("program_id", "line_key.doc_id", "line_key.line_no", "similarity"))


@query("match_type_summary", f"""
SELECT match_type, CAST(count(*) AS BIGINT) AS n, round(avg(match_score), 6) AS mean_score, round(stddev_samp(match_score), 6) AS std_score,
  CAST(min(match_score) AS INTEGER) AS min_score, CAST(max(match_score) AS INTEGER) AS max_score FROM {_BEST_SQL} b GROUP BY match_type""")
def match_type_summary(spark, sf_dir):
    """Links per match type, with the spread of their scores."""
    return rounded(linkage.match_type_summary(_best(spark, sf_dir)))


@query("link_agreement_schedule", f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(prog_late = doc_label AS DOUBLE)), 6) AS agreement,
  round(avg(CAST(prog_late AS DOUBLE)), 6) AS prog_late_rate, round(avg(CAST(doc_label AS DOUBLE)), 6) AS doc_label_rate,
  CAST(count(*) FILTER (WHERE prog_late = 0 AND doc_label = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE prog_late = 0 AND doc_label = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE prog_late = 1 AND doc_label = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE prog_late = 1 AND doc_label = 1) AS BIGINT) AS tp
FROM (SELECT COALESCE(CAST(d.delay > 0 AS INTEGER), 0) AS prog_late, l.toxic AS doc_label
      FROM {_BEST_SQL} b JOIN (SELECT program_name, arg_min(schedule_delay_months, source_file) AS delay FROM {_PROG_SQL} p GROUP BY program_name) d
        ON d.program_name = (SELECT text FROM benchmark WHERE item_id = b.program_id)
      JOIN labels l ON b.doc_id = l.doc_id WHERE b.match_type <> 'no_match') x WHERE doc_label IS NOT NULL""")
def link_agreement_schedule(spark, sf_dir):
    """Program lateness flag (delay > 0 months, C24; null is 0) vs the linked document's second label."""
    links = _best(spark, sf_dir).filter(F.col("match_type") != "no_match")
    recs = parsed_programs(spark, sf_dir).groupBy("program_name").agg(F.min_by("schedule_delay_months", "source_file").alias("delay"))
    lab = bindings.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = (links.join(_programs(spark, sf_dir), "program_id").join(recs, "program_name").join(lab, "doc_id")
              .select(F.coalesce((F.col("delay") > 0).cast("int"), F.lit(0)).alias("prog_late"), F.col("toxic").alias("doc_label")))
    return rounded(linkage.agreement(j, "prog_late", "doc_label"))
