"""Selection, neighbour joins, coherence, weighted and short-name links, per-fold features, grids, shards and sinks against brute force."""

import itertools
import math
import os
import random
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.operators import folds as fd
from ledgerfold.operators import grid, linkage, neighbours, oversample, quality, quantiles, topics, vectors
from ledgerfold.sources import schema, sinks

NAN, INF = float("nan"), float("inf")


def folder():
    return tempfile.mkdtemp(prefix="ledgerfold-test-", dir=os.environ.get("TMPDIR", "/tmp"))


# ---- quantiles -----------------------------------------------------------

@pytest.mark.parametrize("values", [
    [3.0, 1.0, 2.0], [5.0] * 7, [1e308, -1e308, 0.0, 1e-300], [0.1 * i for i in range(5000)], [2.0 ** i for i in range(-500, 500)],
    [1.0, math.nextafter(1.0, 2.0)] * 3 + [1.0], [-INF, 1.0, 2.0, INF, INF], [7.0], []])
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (NAN, None)], "x double, y double")
    got = quantiles.quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert got["y"] == [None] * 5
    if not values:
        assert got["x"] == [None] * 5
    elif any(math.isinf(v) for v in values):
        assert got["x"][0] == -INF and got["x"][2] == 2.0 and got["x"][4] == INF
    else:
        with np.errstate(over="ignore", invalid="ignore"):
            want = [np.sort(values)[round(p * (len(values) - 1))] if len(values) < 5 and p in (0.0, 1.0) else float(np.quantile(values, p)) for p in (0.0, 0.25, 0.5, 0.9, 1.0)]
        assert [g for g, w in zip(got["x"], want, strict=True) if math.isfinite(w)] == pytest.approx([w for w in want if math.isfinite(w)], rel=1e-12, abs=1e-300)


def test_quantiles_plan_has_no_percentile(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("v"))
    out = quality.numeric_profile(df, ["v"])
    assert out.first()["p50"] == (499 ** 2 + 500 ** 2) / 2
    assert "percentile" not in out._jdf.queryExecution().toString()


# ---- neighbours ----------------------------------------------------------

def knn_brute(q, c, k, exclude):
    out = {}
    for a, v in {(a, tuple(v)) for a, v in q}:
        near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w, strict=True))), b is None, b or 0) for b, w in {(b, tuple(w)) for b, w in c}
                      if len(w) == len(v) and not (exclude and a is not None and a == b))
        out[a, v] = [(None if none else b, d) for d, none, b in near[:k]]
    return out


@pytest.mark.parametrize("pivots, block", [(1, 5), (8, 7), (64, 2048)])
def test_knn_join_equals_brute_force(spark, pivots, block):
    draw = random.Random(4)
    pts = [(i, [float(draw.randint(0, 6)), draw.random() * 5]) for i in range(150)] + [(i, [1.0, 1.0]) for i in range(200, 240)]
    pts += [(7, [3.0, 3.0]), (7, [3.5, 3.0]), (300, [1.0, 2.0, 3.0]), (301, [1.0, 2.0, 4.0]), (None, [2.0, 2.0])]
    bad = [(400, None), (401, [1.0, None]), (402, [NAN, 1.0]), (403, [INF, 1.0])]
    df = spark.createDataFrame(pts + bad + pts[:3], "id long, v array<double>")
    for exclude in (True, False):
        got = neighbours.knn_join(df, "id", "v", df, "id", "v", 4, exclude, pivots, block).collect()
        want = knn_brute(pts, pts, 4, exclude)
        by = defaultdict(list)
        for r in got:
            by[r["query_id"]].append((r["rank"], r["id"], r["distance"]))
        for a in {a for a, _ in want}:
            mine = sorted((n + 1, b, d) for (x, _), near in want.items() if x == a for n, (b, d) in enumerate(near))
            assert Counter((n, b, round(d, 9)) for n, b, d in by.get(a, [])) == Counter((n, b, round(d, 9)) for n, b, d in mine)
        assert not {400, 401, 402, 403} & set(by)
    assert neighbours.knn_join(df.limit(0), "id", "v", df, "id", "v", 3).count() == 0
    assert neighbours.knn_join(df, "id", "v", df.limit(0), "id", "v", 3).count() == 0


def test_cosine_of_ragged_queries(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [])], "id long, v array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.1, 1.0]), (12, [1.0, 0.0, 0.2])], "q long, v array<double>")
    got = {(r["query_id"], r["id"]) for r in vectors.cosine_topk(q, "q", "v", d, "id", "v", 1).collect()}
    assert got == {(10, 1), (11, 2), (12, 3)}


def test_oversamplers_interpolate_between_minority_points(spark):
    draw = random.Random(9)
    rows = [(i, [draw.gauss(0, 1), draw.gauss(0, 1)], 0) for i in range(120)] + [(200 + i, [draw.gauss(1, 1), draw.gauss(1, 1)], 1) for i in range(15)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    minority = {i: v for i, v, y in rows if y == 1}
    for fn, ratio in ((oversample.smote, 0.3), (oversample.borderline_smote, 0.3), (oversample.adasyn, 1.0)):
        out = [r for r in fn(df, "id", "v", "y", ratio=ratio, seed=5).collect()]
        new = [r for r in out if r["synthetic"]]
        assert len(out) - len(new) == len(rows) and {r["y"] for r in new} == {1}
        if fn is not oversample.adasyn:
            assert len(new) == int(ratio * 120 - 15)
        for r in new:
            a = minority[int(r["id"].split("#")[0])]
            # the point lies between its origin and another minority point
            assert any(all(min(x, y) - 1e-9 <= z <= max(x, y) + 1e-9 for x, y, z in zip(a, b, r["v"], strict=True)) for b in minority.values())
        again = fn(df.repartition(7), "id", "v", "y", ratio=ratio, seed=5).collect()
        assert sorted(map(str, again)) == sorted(map(str, out))


# ---- coherence -----------------------------------------------------------

def cv_brute(topic_words, docs, width):
    windows = [set(d[s:s + width]) for d in docs for s in range(max(len(d) - width, 0) + 1)]
    n, out = len(windows), {}
    for topic, words in topic_words.items():
        p = {w: sum(w in x for x in windows) / n for w in words}
        v = {}
        for a, b in itertools.product(words, words):
            both = sum(a in x and b in x for x in windows) / n
            v[a, b] = math.log((both + 1e-12) / (p[a] * p[b])) / -math.log(both + 1e-12) if p[a] and p[b] else 0.0
        s = [sum(v[a, b] for a in words) for b in words]
        cos = []
        for a in words:
            x = [v[a, b] for b in words]
            norm = math.sqrt(sum(i * i for i in x)) * math.sqrt(sum(i * i for i in s))
            cos.append(sum(i * j for i, j in zip(x, s, strict=True)) / norm if norm else 0.0)
        out[topic] = sum(cos) / len(cos)
    return out


@pytest.mark.parametrize("width", [1, 5, 110])
def test_cv_coherence_equals_brute_force(spark, width):
    draw = random.Random(width)
    words = [f"w{i}" for i in range(12)]
    docs = [[draw.choice(words) for _ in range(draw.choice([1, 4, 9, 30, 260]))] for _ in range(25)]
    tw = {"a": words[:4], "b": words[3:7] + ["never"], "c": ["w0"]}
    t = spark.createDataFrame([(k, n + 1, w) for k, ws in tw.items() for n, w in enumerate(ws)], "topic string, rank int, term string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")
    got = {r["topic"]: r["c_v"] for r in topics.cv(t, d, "doc_id", "tokens", 10, width).collect()}
    assert got == pytest.approx(cv_brute(tw, docs, width), abs=1e-9)


# ---- links ---------------------------------------------------------------

def test_short_names_equal_brute_force(spark):
    draw = random.Random(2)
    syllables = ["ka", "lo", "mi", "ver", "st", "é", "on", "x"]
    vocabulary = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(300)]
    texts = [draw.choice([" ", "  ", "\n", ". "]).join(draw.choices(vocabulary, k=draw.randint(0, 30))) for _ in range(60)] + [None, "", "  \n"]
    names = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(19_000)]
    names += [" ".join(draw.choices(vocabulary, k=2)) for _ in range(500)] + [" ".join(draw.choices(vocabulary, k=3)) for _ in range(500)]
    for t in texts[:40]:  # names that do occur, cut anywhere
        if t:
            at = draw.randrange(len(t))
            names.append(t[at:at + draw.randint(1, 14)])
    names += [" ", "\n", "  ", None, "", "zzz"]
    p = spark.createDataFrame(list(enumerate(names)), "p long, name string")
    d = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    out = linkage.link_substring(p, "p", "name", d, "d", "text")
    got = Counter((r["p"], r["d"]) for r in out.collect())
    assert len(names) >= 20_000
    assert got == Counter((i, j) for i, n in enumerate(names) if n for j, t in enumerate(texts) if t and n in t)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_weighted_token_links_equal_brute_force(spark):
    draw = random.Random(6)
    tokens = [f"T{i}x" for i in range(30)]
    docs = [(i, " ".join(["ALL-1", *(["MOST-2"] if i % 3 else []), *draw.sample(tokens, draw.randint(0, 3))])) for i in range(200)] + [(900, None), (901, "plain words")]
    programs = [(i, " ".join([*draw.sample(tokens, draw.randint(0, 3)), *(["ALL-1"] if i % 2 else []), *(["MOST-2"] if i % 5 == 0 else [])])) for i in range(40)]
    n = len(docs)
    held = {i: set((t or "").upper().split()) - {"PLAIN", "WORDS"} for i, t in docs}
    df = Counter(t for s in held.values() for t in s)
    weight = {t: math.floor(1000 * math.log(1 + n / c)) for t, c in df.items()}
    want = set()
    for p, name in programs:
        mine = set(name.upper().split())
        scored = sorted((-sum(weight[t] for t in mine & s), i, len(mine & s)) for i, s in held.items() if mine & s)
        want |= {(p, i, -w, m, r + 1) for r, (w, i, m) in enumerate(scored[:4])}
    pd_, dd = spark.createDataFrame(programs, "p long, name string"), spark.createDataFrame(docs, "d long, text string")
    for rare in (0, 25, 1000):
        got = {tuple(r) for r in linkage.link_token_top(pd_, "p", "name", dd, "d", "text", 4, rare).collect()}
        assert got == want


# ---- per-fold features and grids -----------------------------------------

def test_fold_vocabulary_sees_training_documents_alone(spark):
    draw = random.Random(1)
    docs = {i: [draw.choice("abcdefgh") for _ in range(12)] for i in range(60)}
    folds = {i: i % 3 if i < 45 else None for i in docs}
    for i in docs:
        if folds[i] == 1:
            docs[i] += ["secret"] * 3  # only ever held out with part 1
    tc = spark.createDataFrame([(i, t, c) for i, ws in docs.items() for t, c in Counter(ws).items()], "doc_id long, term string, tf long")
    f = spark.createDataFrame(list(folds.items()), "doc_id long, fold int")
    counts = {(r["fold"], r["term"]): (r["df"], r["cf"]) for r in fd.training_counts(tc, "doc_id", "term", f, 3).collect()}
    sizes = {r["fold"]: r["n_docs"] for r in fd.training_sizes(f.select("doc_id"), "doc_id", f, 3).collect()}
    for k in range(3):
        train = [docs[i] for i in docs if folds[i] != k]
        assert sizes[k] == len(train)
        for t in set(itertools.chain(*docs.values())):
            have = [ws.count(t) for ws in train if t in ws]
            assert counts.get((k, t)) == ((len(have), sum(have)) if have else None)
    voc = fd.fold_vocabulary(fd.training_counts(tc, "doc_id", "term", f, 3), fd.training_sizes(f, "doc_id", f, 3), "term", 6, 1, 1.0)
    terms = {(r["fold"], r["term"]) for r in voc.collect()}
    assert (1, "secret") not in terms and len([1 for k, _ in terms if k == 1]) == 6
    w = fd.fold_weights(tc, "doc_id", "term", voc)
    norm = w.groupBy("fold", "doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in norm)
    assert not w.filter("fold = 1 AND term = 'secret'").count()
    y = spark.createDataFrame([(i, int("a" in docs[i])) for i in docs if i % 4], "doc_id long, y int")
    chosen = fd.fold_anova(w, "doc_id", "term", y, f, "y", 3)
    per = Counter(r["fold"] for r in chosen.collect())
    assert per == {0: 3, 1: 3, 2: 3}
    arrays = fd.fold_arrays(w, "doc_id", "term", chosen, 3).collect()
    assert {len(r["arr"]) for r in arrays} == {3}


def test_thresholds_come_from_validation_rows_alone(spark):
    rows = [("m", "valid", y, s) for y, s in ((0, 0.1), (0, 0.3), (1, 0.6), (1, 0.9))]
    rows += [("m", "test", y, s) for y, s in ((0, 0.2), (1, 0.55), (1, 0.7), (0, 0.65))]
    df = spark.createDataFrame(rows, "model string, role string, y int, score double")
    r = grid.metrics(df, ["model"]).first()
    assert r["best_threshold"] == 0.6  # a test row at 0.55 would have lowered it
    assert (r["precision"], r["recall"], r["auc"]) == (0.5, 0.5, 0.75)
    assert (r["n_test"], r["n_pos_test"]) == (4, 2)
    one = df.filter("role = 'test' OR y = 0")  # validation rows of one class
    assert grid.metrics(one, ["model"]).first()["best_threshold"] == 0.5


def test_grid_skips_a_failed_cell(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], int(i % 7 > 3)) for i in range(60)], "doc_id long, arr array<double>, y int")
    score = rows.withColumn("role", F.when(F.col("doc_id") % 2 == 0, "valid").otherwise("test"))
    good = grid.Cell({"name": "good"}, rows, score)
    forest = grid.Cell({"name": "forest"}, rows, score, "RandomForest", params={"numTrees": 5, "maxDepth": 3})
    bad = grid.Cell({"name": "bad"}, rows.withColumn("arr", F.lit("no array")), score)
    scored, failed = grid.scores([good, bad, forest])
    assert [k["name"] for k, _ in failed] == ["bad"]
    m = {r["name"]: r for r in grid.metrics(scored, ["name"]).collect()}
    assert set(m) == {"good", "forest"} and m["good"]["auc"] > 0.95 and m["good"]["n_test"] == 30
    assert grid.class_weight(rows, "balanced")[1] == pytest.approx(60 / (2 * sum(i % 7 > 3 for i in range(60))))
    with pytest.raises(RuntimeError):
        grid.scores([bad])


# ---- shards and sinks ----------------------------------------------------

def test_broken_shards_are_named_and_skipped(spark):
    at = folder()
    names = schema.PARQUET_COLUMN_MAP
    for n in range(3):
        spark.createDataFrame([(f"P{n}", "x")], f"`{names['piid']}` string, `{names['description'] if n else names['psc']}` string").coalesce(1).write.parquet(f"{at}/s{n}")
    with open(f"{at}/broken.parquet", "wb") as f:
        f.write(b"PAR1 not a parquet file")
    with open(f"{at}/empty.parquet", "wb"):
        pass
    rows, failed = schema.read_actions_shards(spark, at)
    assert sorted(r["piid"] for r in rows.collect()) == ["P0", "P1", "P2"]
    bad = {os.path.basename(r["path"]): r["reason"] for r in failed.collect()}
    assert set(bad) == {"broken.parquet", "empty.parquet"} and all(bad.values())
    with pytest.raises(ValueError):
        schema.read_actions_shards(spark, [f"{at}/broken.parquet", f"{at}/empty.parquet"])


def test_sinks_round_trip(spark):
    at = folder()
    w = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "b", 1.0)], "doc_id long, term string, weight double")
    sinks.save_tfidf(w, f"{at}/tfidf")
    assert {(r["idx"], r["term"]) for r in spark.read.parquet(f"{at}/tfidf/vocabulary").collect()} == {(0, "a"), (1, "b")}
    assert spark.read.parquet(f"{at}/tfidf/keys").count() == 2
    t = spark.createDataFrame([(1, [0.25, 0.75])], "doc_id long, topics array<double>")
    sinks.save_doc_topics(t, f"{at}/topics", k=2)
    assert spark.read.parquet(f"{at}/topics").first().asDict() == {"topic_0": 0.25, "topic_1": 0.75, "doc_id": 1}
    sinks.save_table(t, f"{at}/table")
    assert spark.read.parquet(f"{at}/table/parquet").count() == 1
    assert spark.read.option("header", True).csv(f"{at}/table/csv").columns == ["doc_id", "topics"]
    sinks.write_summary(w, f"{at}/summary")
    assert spark.read.json(f"{at}/summary").count() == 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.floats(0, 1))
def test_rank_positions(values, p):
    lo, hi, at = quantiles._ranks(len(values), p)
    assert 0 <= lo <= at <= hi <= len(values) - 1
