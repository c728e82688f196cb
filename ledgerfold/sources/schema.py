"""Semantic column mapping over a physical, all-string action table.

Raw action files carry XML-style flat names with dots and ``#`` in them; a
concept→column dictionary picks the ~19 used columns. Everything is read as
STRING and cast explicitly by ``ledgerfold.functions.casts`` (never inferred).
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.session import materialize

# Concept -> physical column of the Parquet action shards.
PARQUET_COLUMN_MAP = {
    "piid": "content.ID.ContractID.PIID",
    "mod_number": "content.ID.ContractID.modNumber",
    "description": "content.contractData.descriptionOfContractRequirement",
    "psc": "content.productOrServiceInformation.productOrServiceCode.#text",
    "naics": "content.productOrServiceInformation.principalNAICSCode.#text",
    "base_all_options": "content.dollarValues.baseAndAllOptionsValue",
    "base_exercised_options": "content.dollarValues.baseAndExercisedOptionsValue",
    "obligated_amount": "content.dollarValues.obligatedAmount",
    "current_completion_date": "content.relevantContractDates.currentCompletionDate",
    "ultimate_completion_date": "content.relevantContractDates.ultimateCompletionDate",
    "effective_date": "content.relevantContractDates.effectiveDate",
    "signed_date": "content.relevantContractDates.signedDate",
    "reason_for_mod": "content.contractData.reasonForModification.#text",
    "contract_type": "content.contractData.typeOfContractPricing.#text",
    "extent_competed": "content.competition.extentCompeted.#text",
    "num_offers": "content.competition.numberOfOffersReceived",
    "agency_id": "content.purchaserInformation.contractingOfficeAgencyID.#text",
    "vendor_name": "content.vendor.vendorHeader.vendorName",
    "state_code": "content.placeOfPerformance.principalPlaceOfPerformance.stateCode.#text",
}

# Concept -> column of the CSV export form (state is optional).
CSV_COLUMN_MAP = {
    "piid": "award_id_piid",
    "mod_number": "modification_number",
    "description": "transaction_description",
    "psc": "product_or_service_code",
    "naics": "naics_code",
    "base_all_options": "potential_total_value_of_award",
    "base_exercised_options": "current_total_value_of_award",
    "obligated_amount": "federal_action_obligation",
    "current_completion_date": "period_of_performance_current_end_date",
    "ultimate_completion_date": "period_of_performance_potential_end_date",
    "effective_date": "period_of_performance_start_date",
    "signed_date": "action_date",
    "contract_type": "type_of_contract_pricing",
    "extent_competed": "extent_competed",
    "num_offers": "number_of_offers_received",
    "agency_id": "awarding_agency_code",
    "vendor_name": "recipient_name",
    "reason_for_mod": "action_type",
}

CRITICAL = ("piid", "description", "base_all_options", "current_completion_date")


def _q(name: str) -> Column:
    """Column by literal name: dots and '#' are part of the name, not nesting."""
    return F.col("`" + name.replace("`", "``") + "`")


def schema_listing(df: DataFrame) -> DataFrame:
    """(pos, name, type) of every column, as a DataFrame (driver-side schema only)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "pos int, name string, type string")


def mapping_check(df: DataFrame, mapping: dict[str, str], strict: bool = False) -> DataFrame:
    """Concept, physical column, OK/MISSING, critical flag.

    With ``strict`` a missing critical column raises ``ValueError``.
    """
    present = set(df.columns)
    rows = [(k, v, "OK" if v in present else "MISSING", k in CRITICAL) for k, v in mapping.items()]
    missing_critical = [k for k, _, s, c in rows if c and s == "MISSING"]
    if strict and missing_critical:
        raise ValueError(f"critical columns missing: {missing_critical}")
    return df.sparkSession.createDataFrame(
        rows, "concept string, column string, status string, critical boolean")


def to_semantic(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select only mapped columns, renamed to concepts; missing → NULL string."""
    present = set(df.columns)
    return df.select([
        (_q(phys) if phys in present else F.lit(None).cast("string")).alias(concept)
        for concept, phys in mapping.items()
    ])


def read_actions_parquet(spark: SparkSession, path: str | list[str],
                         mapping: dict[str, str] = PARQUET_COLUMN_MAP) -> DataFrame:
    """Read every shard of a folder (one scan, column-pruned), semantic names.

    ``shard`` carries the file for per-shard reports (S10). A broken shard fails the read; see
    :func:`read_actions_shards` for folders that may hold some.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.parquet(*paths)
    return to_semantic(raw, mapping).withColumn("shard", F.input_file_name())


def shard_footers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, n_rows, reason) of every parquet file below the paths. Tasks read the footers, one file a row;
    a file whose footer can't be read has n_rows NULL and the reason. Files without a byte, which scans leave out, are named too."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(paths).select("path", "length")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, reasons = [], []
            for uri in batch.column("path").to_pylist():
                try:
                    fs, at = FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                    with fs.open_input_file(at) as f:
                        rows.append(pq.ParquetFile(f).metadata.num_rows)
                    reasons.append(None)
                except (pa.ArrowException, OSError) as e:
                    rows.append(None)
                    reasons.append(f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(rows, pa.int64()), pa.array(reasons, pa.string())],
                                             names=["path", "length", "n_rows", "reason"])

    def plain(uri: str) -> str:
        return unquote(uri).replace("file:///", "file:/")

    held = files.filter("length > 0").mapInArrow(footers, "path string, length long, n_rows long, reason string")
    seen = {plain(r["path"]) for r in files.select("path").filter("length > 0").collect()}  # the list of shards, as in any scan
    empty = [(plain(f), 0, None, "empty file") for f in files.inputFiles() if plain(f) not in seen]
    return held.unionByName(spark.createDataFrame(empty, held.schema))


def read_actions_shards(spark: SparkSession, path: str | list[str], mapping: dict[str, str] = PARQUET_COLUMN_MAP) -> tuple[DataFrame, DataFrame]:
    """(rows, failed): the rows of all shards whose footer can be read, and (path, length, reason) of the others.

    The list of shards is on the driver, as in any scan. Shards may lack mapped columns; all are read as strings.
    """
    checked = materialize(shard_footers(spark, path))
    good = [r["path"] for r in checked.filter("reason IS NULL").orderBy("path").collect()]
    if not good:
        raise ValueError(f"no shard of {path} can be read")
    raw = spark.read.option("mergeSchema", True).parquet(*good)
    rows = to_semantic(raw, mapping).withColumn("shard", F.input_file_name())
    return rows, checked.filter("reason IS NOT NULL").select("path", "length", "reason")


def read_actions_csv(spark: SparkSession, path: str | list[str],
                     mapping: dict[str, str] = CSV_COLUMN_MAP) -> DataFrame:
    """CSV form, header row, every column STRING (no inference), semantic names."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(paths)
    return to_semantic(raw, mapping).withColumn("shard", F.input_file_name())


def sample_inspection(df: DataFrame, n_rows: int = 500, n_samples: int = 5) -> DataFrame:
    """Per column of the first ``n_rows`` rows: type, non-null count, ≤5 non-null samples.

    One aggregate over a bounded head, then ``stack`` to long form.
    """
    head = df.limit(n_rows)
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"nn__{f.name}"),
                 F.slice(F.collect_list(c.cast("string")), 1, n_samples).alias(f"s__{f.name}")]
    wide = head.agg(F.count(F.lit(1)).alias("__total"), *aggs)
    n = len(df.schema.fields)
    stack_args = ", ".join(
        f"'{f.name}', '{f.dataType.simpleString()}', `nn__{f.name}`, `s__{f.name}`" for f in df.schema.fields)
    return wide.selectExpr(
        "__total AS total",
        f"stack({n}, {stack_args}) AS (column, type, non_null, samples)")
