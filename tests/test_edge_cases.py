"""FIXTURES §7 edge cases for casts, predicates and both label variants."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerfold.functions import casts, scalars
from ledgerfold.operators import filters, labels
from ledgerfold.operators.labels import LabelSpec


def test_money_and_numbers(spark):
    df = spark.createDataFrame([("$1,234.50",), ("None",), ("",), ("NaN",), ("12",)], "s string")
    got = [r.v for r in df.select(casts.money("s").alias("v")).collect()]
    assert got == [1234.5, None, None, None, 12.0]
    assert [r.v for r in df.select(casts.number("s").alias("v")).collect()] == [None, None, None, None, 12.0]


def test_mod_sort_key(spark):
    df = spark.createDataFrame([("0",), ("P00001",), ("P00002",), ("10",), ("A",), (None,)], "m string")
    assert [r.k for r in df.select(casts.mod_sort_key("m").alias("k")).collect()] == [0, 1, 2, 10, 0, 0]


def test_psc_rules(spark):
    codes = ["5820", "0015", "y1aa", " Y1AA", "Z2", "09", "99", None, ""]
    df = spark.createDataFrame([(c,) for c in codes], "p string")
    r = df.select(filters.is_physical_prefix("p").alias("a"), filters.is_physical_whole("p").alias("b")).collect()
    prefix = [x.a for x in r]
    whole = [x.b for x in r]
    assert prefix == [True, False, True, False, True, False, True, False, False]
    assert whole == [False, True, True, True, True, False, True, False, False]


def test_intraday_delay_and_strict_thresholds(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 18), dt.datetime(2024, 1, 1, 6), 5.0, None)],
                               "a timestamp, b timestamp, g double, n double")
    r = df.select(scalars.days_between("b", "a").alias("d"), scalars.label_keep_null("g", 5.0).alias("l1"),
                  scalars.label_null_zero("n", 5.0).alias("l2"), scalars.label_keep_null("n", 5.0).alias("l3")).first()
    assert (r.d, r.l1, r.l2, r.l3) == (-2, 0, 0, None)


def test_value_tier_right_closed(spark):
    df = spark.createDataFrame([(1e6,), (1e6 + 1,), (0.0,), (-5.0,), (2e8,)], "v double")
    assert [r.t for r in df.select(scalars.value_tier("v").alias("t")).collect()] == ["<1M", "1M-5M", None, None, ">100M"]


def _actions(spark, rows):
    schema = ("piid string, mod_number string, action_id long, base_all_options string, base_exercised_options string, "
              "current_completion_date string, ultimate_completion_date string, description string, psc string, "
              "reason_for_mod string, num_offers string")
    return spark.createDataFrame(rows, schema)


def test_history_vs_baseline_first_values(spark):
    rows = [("A", "0", 1, None, None, "2024-01-01 00:00:00", "2024-01-05 00:00:00", "x" * 10, "Y1AA", None, "None"),
            ("A", "1", 2, "600000", "700000", "2024-01-03 00:00:00", "2024-02-01 00:00:00", None, "Y1AA", "Terminate for default", "3"),
            (None, "0", 3, "1", "1", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "d", "Y1AA", None, "1")]
    a = _actions(spark, rows)
    h = labels.fold_history(a).collect()
    assert len(h) == 1  # NULL piid dropped
    r = h[0]
    assert r.initial_cost == 600000.0 and r.final_cost == 700000.0 and r.terminated_for_default == 1
    assert r.num_offers == 3.0  # 'None' skipped as NULL before taking the first value
    b = labels.fold_baseline(a, LabelSpec(variant="baseline_vs_ultimate")).collect()[0]
    assert b.base_value is None  # row-first variant keeps the NULL → the floor drops it
    assert labels.label_baseline(a, LabelSpec(variant="baseline_vs_ultimate", min_contract_value=500000.0)).count() == 0


def test_string_vs_numeric_order(spark):
    rows = [("A", "9", 1, "100", "100", "2024-01-01 00:00:00", "2024-01-02 00:00:00", "d", "Y1AA", None, "1"),
            ("A", "10", 2, "100", "300", "2024-01-01 00:00:00", "2024-01-09 00:00:00", "d", "Y1AA", None, "1")]
    a = _actions(spark, rows)
    h = labels.fold_history(a).first()
    assert h.final_cost == 300.0  # numeric order: '10' is last
    b = labels.fold_baseline(a, LabelSpec(variant="baseline_vs_ultimate")).first()
    assert b.final_value == 100.0  # string order: '9' is last


def test_growth_variants_zero_and_negative_base(spark):
    df = spark.createDataFrame([(0.0, 10.0), (-5.0, 5.0)], "b double, f double")
    r = df.select(scalars.growth_pct_history("b", "f").alias("h"), scalars.growth_pct_baseline("b", "f").alias("v")).collect()
    assert r[0].h is None and r[0].v is None
    assert r[1].h is None and r[1].v == 200.0


def test_mod_reasons_first_seen_order(spark):
    rows = [("A", "2", 1, "1", "1", "2024-01-01 00:00:00", None, "d", "Y1AA", "B", "1"),
            ("A", "1", 2, "1", "1", "2024-01-01 00:00:00", None, "d", "Y1AA", "A", "1"),
            ("A", "3", 3, "1", "1", "2024-01-01 00:00:00", None, "d", "Y1AA", "B", "1")]
    got = labels.mod_reasons(_actions(spark, rows)).first()
    assert got.all_mod_reasons == "A, B"


def test_adaptive_threshold_not_triggered_at_exactly_five_percent(spark):
    vals = [6.0] + [0.0] * 19  # 1/20 = 5 % positives: strict '<' keeps the primary threshold
    df = spark.createDataFrame([(float(v),) for v in vals], "g double")
    out = labels.with_adaptive_label(df, "g", "ob", LabelSpec(), keep_null=True)
    assert {r.threshold_used for r in out.collect()} == {5.0}
