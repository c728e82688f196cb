"""Sources and sinks: dotted physical names, all-string CSV, mapping check, inspection, resume."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import labels
from ledgerfold.sources import programs, schema, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="ledgerfold-test-", dir=os.environ.get("TMPDIR", "/tmp"))


def test_parquet_dotted_names_and_mapping(spark):
    phys = schema.PARQUET_COLUMN_MAP
    row = {phys["piid"]: "A1", phys["mod_number"]: "P00002", phys["base_all_options"]: "$1,000.00",
           phys["psc"]: "Y1AA", phys["description"]: "build", phys["current_completion_date"]: "2024-01-01 00:00:00"}
    cols = list(row)
    df = spark.createDataFrame([tuple(row[c] for c in cols)], ", ".join(f"`{c}` string" for c in cols))
    path = _tmp() + "/shard=202401"
    df.write.parquet(path)
    a = schema.read_actions_parquet(spark, path)
    r = a.first()
    assert r.piid == "A1" and r.mod_number == "P00002" and r.naics is None  # missing column → NULL
    chk = {x.concept: (x.status, x.critical) for x in schema.mapping_check(df, phys).collect()}
    assert chk["piid"] == ("OK", True) and chk["naics"] == ("MISSING", False)
    with pytest.raises(ValueError):
        schema.mapping_check(df.drop(phys["piid"]), phys, strict=True)
    typed = labels.typed_actions(a.drop("shard"))
    assert typed.first().base_all_options == 1000.0


def test_csv_all_strings(spark):
    path = _tmp() + "/actions.csv"
    with open(path, "w") as f:
        f.write("award_id_piid,modification_number,product_or_service_code,potential_total_value_of_award\n")
        f.write("X,0,0015,10.0\n")
    a = schema.read_actions_csv(spark, path)
    r = a.first()
    assert r.psc == "0015" and r.base_all_options == "10.0"  # no inference: leading zeros kept
    assert dict(a.dtypes)["psc"] == "string"


def test_schema_listing_and_sample_inspection(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"v{i}") for i in range(10)], "a int, b string")
    lst = [(r.pos, r.name) for r in schema.schema_listing(df).collect()]
    assert lst == [(0, "a"), (1, "b")]
    ins = {r.column: (r.non_null, len(r.samples), r.total) for r in schema.sample_inspection(df, 6, 5).collect()}
    assert ins["a"][1] == 5 and ins["a"][2] == 6


def test_checkpoint_or_resume(spark):
    path = _tmp() + "/filtered"
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    assert sinks.checkpoint_or_resume(spark, path, build).count() == 5
    assert sinks.checkpoint_or_resume(spark, path, build).count() == 5
    assert len(calls) == 1
    with pytest.raises(FileNotFoundError):
        sinks.require(spark, path + "_missing", "run the filter step first")


def test_program_json_files_with_rejects(spark):
    d = _tmp()
    with open(f"{d}/gao_2024_chunk_1.json", "w") as f:
        f.write('[{"program_name": "F-35 Joint Strike Fighter", "report_year": 2024, "service_branch": "Air Force", '
                '"baseline_cost_millions": 233000, "current_cost_millions": 412000, "cost_growth_percent": 76.8, '
                '"original_ioc_date": "2012-12", "current_ioc_date": "2024-03", "schedule_delay_months": 135, '
                '"nunn_mccurdy_breach": true, "primary_challenge": "software"}]')
    with open(f"{d}/gao_2024_chunk_2.json", "w") as f:
        f.write("not json at all")
    files = programs.read_program_files(spark, d)
    recs, rejects = programs.parse_program_arrays(files)
    r = recs.first()
    assert r.program_name.startswith("F-35") and r.schedule_delay_months == 135 and r.nunn_mccurdy_breach
    assert [x.source_file for x in rejects.collect()] == ["gao_2024_chunk_2.json"]
    chk = programs.recompute_programs(recs).first()
    assert round(chk.growth_recomputed, 1) == 76.8 and chk.delay_recomputed == 135 and not chk.growth_disagrees


def test_psc_prefilter_is_pushed_to_parquet(spark):
    from ledgerfold.operators import filters
    phys = schema.PARQUET_COLUMN_MAP
    cols = [phys["piid"], phys["psc"], phys["description"]]
    df = spark.createDataFrame([("A", "Y1AA", "d"), ("B", "R425", "e")], ", ".join(f"`{c}` string" for c in cols))
    path = _tmp() + "/shard"
    df.write.parquet(path)
    a = schema.read_actions_parquet(spark, path).transform(filters.physical_filter, "prefix").select("piid")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = a._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "StringStartsWith" in pushed.split("]")[0] + pushed.split("]")[1]
    assert [r.piid for r in a.collect()] == ["A"]
