"""Distributed operators checked against brute force on small fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerfold.operators import linkage, sampling, vectors
from ledgerfold.operators import evaluate as ev

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau".split()


def _jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_fuzzy_prefix_join_equals_bruteforce(spark):
    rnd = random.Random(7)
    left = [(i, " ".join(rnd.sample(WORDS, rnd.randint(5, 12)))) for i in range(40)]
    right = []
    for j in range(120):
        base = rnd.choice(left)[1].split()
        if rnd.random() < 0.5:  # near copy
            base = base[:] + ([rnd.choice(WORDS)] if rnd.random() < 0.5 else [])
        else:
            base = rnd.sample(WORDS, rnd.randint(5, 12))
        right.append((j, " ".join(base)))
    for t in (0.6, 0.85):
        expect = {(i, j) for i, a in left for j, b in right if _jaccard(a.split(), b.split()) >= t}
        l_df = spark.createDataFrame(left, "lid int, a string")
        r_df = spark.createDataFrame(right, "rid int, b string")
        got = {(r.lid, r.rid) for r in linkage.link_fuzzy(l_df, "lid", "a", r_df, "rid", "b", t).collect()}
        assert got == expect and expect


def test_substring_link_equals_bruteforce(spark):
    rnd = random.Random(3)
    names = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(2, 8)))) for i in range(30)]
    docs = []
    for j in range(60):
        words = rnd.choices(WORDS, k=30)
        if rnd.random() < 0.6:
            pos = rnd.randint(0, 25)
            words = words[:pos] + [rnd.choice(names)[1]] + words[pos:]
        txt = " ".join(words)
        if rnd.random() < 0.3:
            txt = txt.replace(" ", "\n", 3)
        docs.append((j, txt))
    expect = {(i, j) for i, n in names for j, d in docs if n in d}
    p = spark.createDataFrame(names, "program_id int, program_name string")
    d = spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r.program_id, r.doc_id) for r in linkage.link_substring(p, "program_id", "program_name", d, "doc_id", "text").collect()}
    assert got == expect and expect


def test_knn_equals_bruteforce(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(60, 4)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id int, v array<double>")
    got = {}
    for r in vectors.knn(df, "id", "v", 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for i, p in enumerate(pts):
        d = [(float(np.sum((p - q) ** 2)), j) for j, q in enumerate(pts) if j != i]
        want = [j for _, j in sorted(d)[:3]]
        assert [j for _, j in sorted(got[i])] == want


def test_group_rank_is_exact(spark):
    rows = [(i, i % 3 if i % 5 else 0) for i in range(500)]  # skewed groups
    df = spark.createDataFrame(rows, "id int, g int").repartition(7)
    r = sampling.group_rank(df, "g", F.col("id"), n_parts=5).collect()
    for g in {x.g for x in r}:
        ids = sorted(x.id for x in r if x.g == g)
        ranks = {x.id: x.rank for x in r if x.g == g}
        assert [ranks[i] for i in ids] == list(range(1, len(ids) + 1))


def test_folds_and_split_invariants(spark):
    rows = [(i, 1 if i % 9 == 0 else 0) for i in range(403)]
    df = spark.createDataFrame(rows, "id int, y int")
    f = sampling.stratified_folds(df, "id", "y", 5).collect()
    assert len({x.id for x in f}) == 403
    for y in (0, 1):
        sizes = [sum(1 for x in f if x.y == y and x.fold == k) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    s = sampling.stratified_split(df, "id", "y", 0.2).collect()
    for y in (0, 1):
        n = sum(1 for x in s if x.y == y)
        assert sum(1 for x in s if x.y == y and x.is_test) == -(-n * 2 // 10)


def test_curve_metrics_match_bruteforce(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, y int, s double").withColumn("g", F.lit("x"))
    cv = ev.curve(df, ["g"], "y", "s", n_buckets=4)
    auc = ev.roc_auc(cv, ["g"]).first().auc
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12
    ap = ev.average_precision(cv, ["g"]).first().average_precision
    thr = sorted({s for _, _, s in rows}, reverse=True)
    want_ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for _, y, s in rows if s >= t and y == 1)
        fp = sum(1 for _, y, s in rows if s >= t and y == 0)
        r = tp / len(pos)
        want_ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert abs(ap - want_ap) < 1e-12
