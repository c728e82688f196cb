"""Worked examples published with the reference, used as golden values."""

import math

from pyspark.sql import functions as F

from ledgerfold.functions.scalars import growth_pct_program, months_between_ym
from ledgerfold.functions.vectors import cosine
from ledgerfold.operators import labelruns, vectors

Q = [1.0, 2.0, 0.0, 1.0, 0.0]
DOCS = {1: [1.0, 1.0, 0.0, 1.0, 0.0], 2: [0.0, 1.0, 2.0, 0.0, 1.0], 3: [2.0, 0.0, 1.0, 0.0, 2.0], 4: [1.0, 2.0, 1.0, 0.0, 0.0]}


def test_cosine_values(spark):
    df = spark.createDataFrame([(k, Q, v) for k, v in DOCS.items()], "id int, q array<double>, d array<double>")
    got = {r.id: round(r.c, 3) for r in df.select("id", cosine("q", "d").alias("c")).collect()}
    assert got == {1: 0.943, 2: 0.333, 3: 0.272, 4: 0.833}


def test_cosine_top2_and_scale_invariance(spark):
    docs = spark.createDataFrame([(k, v) for k, v in DOCS.items()], "id int, v array<double>")
    q = spark.createDataFrame([(0, Q)], "qid int, v array<double>")
    top = vectors.cosine_topk(q, "qid", "v", docs, "id", "v", k=2).orderBy("rank").collect()
    assert [r.id for r in top] == [1, 4]
    doubled = spark.createDataFrame([(k, [2 * x for x in v] if k == 4 else v) for k, v in DOCS.items()], "id int, v array<double>")
    top2 = {r.id: r.cosine for r in vectors.cosine_topk(q, "qid", "v", doubled, "id", "v", k=2).collect()}
    assert math.isclose(top2[4], 5 / 6, rel_tol=1e-12)


RUNS = {
    "zero": "P N 0 P N 0 N P 0 N".split(),
    "few": "P N 0 P 0 0 N P 0 0".split(),
    "instruction": "P N 0 P N 0 N P 0 0".split(),
}


def _runs(spark):
    rows = [(i + 1, r, lab) for r, labs in RUNS.items() for i, lab in enumerate(labs)]
    return spark.createDataFrame(rows, "item int, run string, label string")


def test_label_runs_changed_items(spark):
    wide = labelruns.pivot_runs(_runs(spark), list(RUNS))
    assert sorted(r.item for r in wide.filter("changed").collect()) == [5, 10]


def test_label_runs_agreement(spark):
    wide = labelruns.pivot_runs(_runs(spark), list(RUNS))
    got = {(r.run_a, r.run_b): r.n_agree for r in labelruns.pairwise_agreement(wide, list(RUNS)).collect()}
    assert got == {("zero", "few"): 8, ("zero", "instruction"): 9, ("few", "instruction"): 9}


def test_label_runs_majority_tie_negative(spark):
    rows = [(1, "a", "P"), (1, "b", "N"), (2, "a", "P"), (2, "b", "0"), (3, "a", "P"), (3, "b", "P"), (3, "c", "N")]
    df = spark.createDataFrame(rows, "item int, run string, label string")
    got = {r.item: r.majority_label for r in labelruns.majority(df).collect()}
    assert got == {1: "N", 2: "0", 3: "P"}


def test_program_record_example(spark):
    df = spark.createDataFrame([(233000.0, 412000.0, "2012-12", "2024-03")], "b double, c double, o string, n string")
    r = df.select(growth_pct_program("b", "c").alias("g"), months_between_ym("n", "o").alias("m")).first()
    assert round(r.g, 1) == 76.8 and r.m == 135
