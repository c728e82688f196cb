"""Program records extracted to JSON arrays.

Each source file holds one JSON array of objects with 11 fixed keys. Spark
reads such files with ``spark.read.text(path, wholetext=True)`` and parses
them with ``from_json`` into ``array<struct>``; ``inline`` makes one row per
record. Malformed arrays parse to NULL and are kept in a rejects table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The record schema of the extraction prompt (keys and types).
PROGRAM_SCHEMA = (
    "program_name STRING, report_year INT, service_branch STRING, baseline_cost_millions DOUBLE, "
    "current_cost_millions DOUBLE, cost_growth_percent DOUBLE, original_ioc_date STRING, "
    "current_ioc_date STRING, schedule_delay_months INT, nunn_mccurdy_breach BOOLEAN, primary_challenge STRING"
)
# Allowed service branches (NULL is allowed too).
SERVICE_BRANCHES = ("Army", "Navy", "Air Force", "Marine Corps", "Space Force", "Joint")


def read_program_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (source_file, json_text)."""
    return (spark.read.option("wholetext", True).text(path)
                 .select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"),
                         F.col("value").alias("json_text")))


def parse_program_arrays(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): records are the inlined array elements plus source_file."""
    parsed = files.withColumn("_arr", F.from_json("json_text", f"ARRAY<STRUCT<{PROGRAM_SCHEMA}>>"))
    rejects = parsed.filter(F.col("_arr").isNull()).select("source_file", "json_text")
    records = parsed.filter(F.col("_arr").isNotNull()).select("source_file", F.inline("_arr"))
    return records, rejects


def validate_programs(records: DataFrame, key: list[str]) -> DataFrame:
    """G1: (key…, rule, ok) per record and rule."""
    ym = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
    rules = {
        "service_branch_allowed": F.col("service_branch").isNull() | F.col("service_branch").isin(*SERVICE_BRANCHES),
        "report_year_4_digits": F.col("report_year").isNotNull() & F.col("report_year").between(1000, 9999),
        "costs_non_negative_or_null": (F.coalesce(F.col("baseline_cost_millions"), F.lit(0.0)) >= 0)
        & (F.coalesce(F.col("current_cost_millions"), F.lit(0.0)) >= 0),
        "ioc_dates_yyyy_mm": (F.col("original_ioc_date").isNull() | F.col("original_ioc_date").rlike(ym))
        & (F.col("current_ioc_date").isNull() | F.col("current_ioc_date").rlike(ym)),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()])
    return records.select(*key, F.explode(arr).alias("r")).select(*key, "r.rule", "r.ok")


def recompute_programs(records: DataFrame, growth_tol: float = 0.5, delay_tol: int = 1) -> DataFrame:
    """Recomputed growth (%) and delay (months) next to the stated ones, with disagreement flags."""
    from ledgerfold.functions.scalars import growth_pct_program, months_between_ym
    g = growth_pct_program("baseline_cost_millions", "current_cost_millions")
    d = months_between_ym("current_ioc_date", "original_ioc_date")
    return (records.withColumn("growth_recomputed", g).withColumn("delay_recomputed", d)
                   .withColumn("growth_disagrees",
                               F.coalesce(F.abs(F.col("growth_recomputed") - F.col("cost_growth_percent")) > growth_tol,
                                          F.lit(False)))
                   .withColumn("delay_disagrees",
                               F.coalesce(F.abs(F.col("delay_recomputed") - F.col("schedule_delay_months")) > delay_tol,
                                          F.lit(False))))


def dedupe_programs(records: DataFrame) -> DataFrame:
    """One row per (program_name, report_year); each field = first non-NULL by source file order."""
    fields = [c for c in records.columns if c not in ("program_name", "report_year", "source_file")]
    return records.groupBy("program_name", "report_year").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("source_file"))).alias(c) for c in fields],
        F.min("source_file").alias("source_file"), F.count(F.lit(1)).alias("n_copies"))
