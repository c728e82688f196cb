"""What is shuffled and how often a text is read: fuzzy links, vocabularies per fold, tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import text as tx
from ledgerfold.operators import folds as fd
from ledgerfold.operators import linkage, topics
from ledgerfold.operators import text as ot
from ledgerfold.plans.q_text import track_a_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_right_side_moves_its_known_tokens_once(spark):
    left = spark.createDataFrame([(1, "a b c d")], "l long, t string")
    right = spark.createDataFrame([((1, 0), "a b c d e"), ((1, 1), "x y z"), ((2, 0), "d c b a"), ((3, 0), "")], "r struct<d:long, n:int>, t string")
    out = linkage.link_fuzzy(left, "l", "t", right, "r", "t", 0.6)
    p = plan(out)
    assert "hashpartitioning(tok" not in p  # a row a token of the right side would be moved
    got = {(r["l"], r["r"]["d"], r["r"]["n"]): r["similarity"] for r in out.collect()}
    assert got == {(1, 1, 0): pytest.approx(0.8), (1, 2, 0): 1.0}


def test_fuzzy_key_with_two_texts(spark):
    """A key that occurs with two texts has two sets: neither borrows the other's tokens."""
    left = spark.createDataFrame([(1, "a b c d")], "l long, t string")
    right = spark.createDataFrame([(7, "a b x y"), (7, "c d u v"), (8, "a b c d")], "r long, t string")
    assert [(r["l"], r["r"]) for r in linkage.link_fuzzy(left, "l", "t", right, "r", "t", 0.9).collect()] == [(1, 8)]


def test_fuzzy_links_alike_if_the_left_side_is_large(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, 7)))) for i in range(60)]
    left, right = spark.createDataFrame(rows[:20], "l long, t string"), spark.createDataFrame(rows[20:], "r long, t string")

    def links():
        return {(r["l"], r["r"], r["similarity"]) for r in linkage.link_fuzzy(left, "l", "t", right, "r", "t", 0.5).collect()}
    small = links()
    monkeypatch.setattr(linkage, "BROADCAST_ROWS", 0)
    sets = {i: set(t.split()) for i, t in rows}
    brute = {(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(20) for b in range(20, 60)
             if sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert small == links() == brute


@pytest.mark.parametrize("features, min_df, max_df", [(2, 1, 1.0), (3, 2, 0.5), (4, 1, 0.3), (50, 1, 1.0)])
def test_fold_terms_are_those_of_all_counts(spark, features, min_df, max_df):
    """Few candidates give the vocabulary of all terms, also where frequent terms are held out or too common."""
    draw = random.Random(5)
    docs = [(i, [draw.choice("aaaabbbccdefghij") for _ in range(10)] + (["held"] * 30 if i % 3 == 1 and i < 45 else []) + ["all"]) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, terms array<string>")
    f = spark.createDataFrame([(i, i % 3 if i < 45 else None) for i, _ in docs], "doc_id long, fold int")
    sizes = fd.training_sizes(f, "doc_id", f, 3)
    tc, voc = fd.fold_terms(d, "doc_id", F.col("terms"), sizes, f, 3, features, min_df, max_df)
    counts = fd.training_counts(ot.term_counts(d, "doc_id", "terms"), "doc_id", "term", f, 3)
    want = fd.fold_vocabulary(counts, sizes, "term", features, min_df, max_df)
    assert sorted(map(tuple, voc.collect())) == sorted(map(tuple, want.collect()))
    assert voc.select("term").exceptAll(voc.join(tc.select("term").distinct(), "term", "left_semi").select("term")).isEmpty()


def test_fold_terms_counts_documents_for_candidates_alone(spark):
    d = spark.createDataFrame([(i, ["x", "x", "x", "y", f"own{i % 20}"]) for i in range(40)], "doc_id long, terms array<string>")
    f = spark.createDataFrame([(i, i % 2 if i < 4 else None) for i in range(40)], "doc_id long, fold int")
    tc, voc = fd.fold_terms(d, "doc_id", F.col("terms"), fd.training_sizes(f, "doc_id", f, 2), f, 2, 1, 1, 1.0)
    assert {r["term"] for r in tc.select("term").distinct().collect()} == {"x", "y"}
    assert {(r["fold"], r["term"]) for r in voc.collect()} == {(0, "x"), (1, "x")}


ODD = [None, "", " ", "ab", "abc", "ABC def1 2ghi jk", "the cat's shall-perform", "a\tb\nccc\x0bddd eee", "naïve façade İstanbul", "x1y abc1def zzz_yyy", "aaa1", "1aaa", "éaaaé"]


def test_tokens_as_defined(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    for r in d.select("t", F.lower("t").alias("low"), tx.light_tokens("t").alias("a"), tx.topic_tokens("t").alias("b")).collect():
        low = r["low"] or ""
        assert r["a"] == [w for w in re.sub(r"[^a-z\s]", " ", low, flags=re.A).split() if len(w) > 2]
        assert r["b"] == [w for w in re.sub(r"[^a-z0-9\s]", " ", low, flags=re.A).split() if len(w) > 2 and w.isalpha() and w not in tx.TOPIC_STOP_WORDS]


def test_tokens_are_made_once(spark):
    d = spark.range(5).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words of a text "), 9), F.col("id").cast("string")).alias("text"))
    d = d.repartition(2)
    ta = track_a_of(d)
    assert plan(ta).count("regexp_extract_all") == 1
    assert plan(ot.tfidf_corpus(d, "doc_id", "text")).count("regexp_extract_all") == 1
    assert ta.count() == 5


def test_topic_vocabulary_counts_documents_without_keeping_their_tokens(spark):
    """CountVectorizer caches whole partitions of tokens if a bound is a share (it must count rows first)."""
    rows = [(i, ["all", "even" if i % 2 == 0 else "odd", f"w{i % 5}"] + ["most"] * (i % 3 > 0)) for i in range(31)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    model, _ = topics.bow_vectors(docs, "tokens", 5, 0.5)
    assert model.getMaxDF() == 15.5
    assert set(model.vocabulary) == {"odd", *(f"w{i}" for i in range(5))}  # "even" is in 16 of 31
    assert topics.most_documents(0.5, 1) == 0.5 and topics.most_documents(0.5, 0) == 0.5


def test_short_names_do_not_multiply_the_texts_tokens(spark):
    """Names and parts meet a text once each, not once for each of its tokens that holds them."""
    names = [(i, n) for i, n in enumerate(["an", "an", "a", "é", "an ba", "ban ana", "n", "ana x ban", " ", "zz", "\U0001F600"])]
    texts = [(1, "banana anab ana x ban an"), (2, "an ba"), (3, "é\U0001F600 n"), (4, ""), (5, None), (None, "an an"), (2, "caban anax")]
    p, d = spark.createDataFrame(names, "p long, name string"), spark.createDataFrame(texts, "d long, t string")
    out = linkage.link_substring(p, "p", "name", d, "d", "t")
    assert sorted((r["p"], r["d"]) for r in out.distinct().collect()) == sorted(
        {(i, k) for i, n in names for k, t in texts if k is not None and t is not None and n in t})
    short = p.withColumn("_t", linkage._tokens("name")).withColumn("_n", F.size("_t"))
    assert "collect_set(no" in plan(linkage._short_candidates(short, "p", "name", d, "d", "t"))  # one row carries all its parts' numbers


def test_tokens_holding_parts_of_any_length(spark):
    parts = ["a", "bc", "abc", "abcd", "é", "\U0001F600", "zz"]
    tokens = ["", "a", "abcd", "xabcdabcd", "é\U0001F600", "bc", "z"]
    got = linkage.tokens_holding(spark.createDataFrame([(x,) for x in parts], "part string"), spark.createDataFrame([(x,) for x in tokens], "token string"))
    assert sorted((r["part"], r["token"]) for r in got.collect()) == sorted((x, t) for x in parts for t in tokens if x in t)
