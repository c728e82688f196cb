"""Inputs that once lost rows or failed."""

from pyspark.sql import functions as F

from ledgerfold.functions import scalars
from ledgerfold.operators import features, linkage, quality, sampling, text, vectors


def test_substring_link_with_empty_documents_and_short_names(spark):
    p = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "ta ga"), (3, "a"), (4, "zz"), (5, None), (6, "")], "pid int, name string")
    d = spark.createDataFrame([(1, "x alpha beta gamma delta y"), (2, ""), (3, None), (4, "beta gamma"), (5, "a")], "did int, text string")
    got = {(r.pid, r.did) for r in linkage.link_substring(p, "pid", "name", d, "did", "text").collect()}
    assert got == {(1, 1), (2, 1), (2, 4), (3, 1), (3, 4), (3, 5)}


def test_fuzzy_link_at_the_threshold(spark):
    words = [f"w{i}" for i in range(100)]
    a = spark.createDataFrame([(1, " ".join(words))], "l int, t string")
    b = spark.createDataFrame([(1, " ".join(words[:55])), (2, " ".join(words[:54]))], "r int, t string")
    assert [(r.l, r.r) for r in linkage.link_fuzzy(a, "l", "t", b, "r", "t", threshold=0.55).collect()] == [(1, 1)]


def test_topk_with_repeated_ids_and_null_vectors(spark):
    q = spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(6)] + [(9, None), (8, [1.0, None])], "q int, v array<double>")
    d = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(7, None), (8, [1.0]), (9, [None, 1.0])], "d int, v array<double>")
    got = vectors.cosine_topk(q, "q", "v", d, "d", "v", k=2, max_query_rows=2).collect()
    assert len(got) == 12 and {r.query_id for r in got} == {0, 1} and {r.d for r in got} <= set(range(5))


def test_calendar_defaults(spark):
    rows = [(2010, 2, 5, 0, -5, 100.0), (2013, 3, 9, 1, -2, 200.0), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "contract_start_year int, contract_start_quarter int, contract_start_month int, is_end_of_fiscal_year int, years_since_2015 int, contract_duration_planned_days double")
    df = df.select("*", F.lit(1.0).alias("initial_cost"), F.lit(1).alias("num_modifications"), F.lit(2.0).alias("num_offers"),
                   F.lit("a").alias("contract_type"), F.lit("b").alias("competition"), F.lit("1234").alias("psc"))
    r = [x for x in features.structured_features(df).collect() if x.contract_duration_planned_days == 365][0]
    assert (r.contract_start_year, r.contract_start_quarter, r.contract_start_month, r.is_end_of_fiscal_year, r.years_since_2015) == (2011, 1, 1, 0, -3)


def test_null_labels_stay(spark):
    df = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(9)], "k int, y int")
    assert sampling.stratified_folds(df, "k", "y").count() == 9
    assert sampling.stratified_split(df, "k", "y").count() == 9
    assert sampling.with_weights(df, "y").count() == 9


def test_profiles_of_unknown_and_empty_values(spark):
    df = spark.createDataFrame([(0.0, -3), (1.0, 0), (None, 5), (0.0, None)], "g double, d int")
    r = quality.share_zero_on_time(df, "g", "d").first()
    assert (r.n_growth, r.n_zero_growth, r.n_delay, r.n_on_time) == (3, 2, 3, 2)
    none = quality.share_zero_on_time(df.limit(0), "g", "d").first()
    assert none.n_growth == 0 and none.share_zero_growth is None and none.share_on_time is None
    t = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "w array<string>")
    r = text.vocabulary_profile(t, "w").first()
    assert (r.n_docs, r.n_empty, r.n_tokens, r.n_vocabulary, r.avg_tokens) == (3, 2, 3, 2, 1.0)


def test_match_types_and_examples(spark):
    links = spark.createDataFrame([("a", 100), ("a", 100), ("b", 86), ("b", 90), ("no_match", 0)], "match_type string, match_score int")
    got = {r.match_type: (r.n, r.mean_score, r.min_score, r.max_score) for r in linkage.match_type_summary(links).collect()}
    assert got == {"a": (2, 100.0, 100, 100), "b": (2, 88.0, 86, 90), "no_match": (1, 0.0, 0, 0)}
    df = spark.createDataFrame([(1, "abcdef"), (2, "ab"), (3, None), (4, "abcdefgh")], "k int, t string")
    assert [(r.k, r.t) for r in quality.examples(df, "t", "k", long_above=3, max_len=4).collect()] == [(1, "abcd"), (4, "abcd")]


def test_infinities_become_zero(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (2.5,)], "x double")
    assert [r.y for r in df.select(scalars.inf_to_zero("x").alias("y")).collect()] == [0.0, 0.0, 2.5]
