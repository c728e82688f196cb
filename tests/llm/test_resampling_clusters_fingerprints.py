"""Operators 11 to 13 against brute force, and over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.llm import centroids, fingerprint, importance, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 397}x{i % 11}" for i in range(24_000))
ROWS = [(1, "Alpha beta, gamma-delta EPSILON " * 6), (2, None), (3, ""), (4, " \t\n"), (None, "alpha beta " * 15), (5, LONG), (6, LONG + " tail"),
        (7, "émile ÉMILE x \U0001F600 9b " * 8), (8, "one two"), (9, "one two"), (9, "one two"), (10, "beta alpha " * 12), (10, "gamma " * 30), (None, None)]
CLASH = ["tie", "n_words", "score", "rank", "weight", "at", "range", "__i", "__t", "k", "to", "need", "sketch", "packed", "number", "block", "ids", "x", "cluster", "id"]


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("taken"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id long, text string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


# ---- 11 importance resampling -------------------------------------------

def found(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def importance_brute(data, target):
    raw, want = Counter(b for _, t in data for b in found(t)[1]), Counter(b for t in target for b in found(t)[1])
    s, t = sum(raw.values()), sum(want.values())
    out = []
    for i, text in data:
        n, buckets = found(text)
        gain = [math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in buckets]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        out.append([i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:25 * len(able) // 100]
    return sorted(((i, k, w, sc, next((n + 1 for n, d in enumerate(drawn) if d is r), None)) for r in out for i, _, k, w, sc in [r]), key=str)


def as_rows(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows(df)), key=str)


def test_importance_against_brute_force(spark):
    data = [(r["doc_id"], r["text"]) for r in table("documents")]
    assert as_rows(queries.op11_importance(spark, SF)) == importance_brute(data, [r["text"] for r in table("benchmark")])


def test_importance_edges(spark, docs, none):
    target = spark.createDataFrame([("alpha beta gamma",), (None,), ("",)], "text string")
    got = importance.resample(docs, target, percent=50)
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = importance_brute(plain, ["alpha beta gamma", None, ""])
    assert sorted(str(r[:4]) for r in as_rows(got)) == sorted(str(r[:4]) for r in want)
    able = sum(found(t)[0] >= 20 for _, t in plain)
    ranks = sorted(r["rank"] for r in rows(got) if r["rank"] is not None)
    assert ranks == list(range(1, able // 2 + 1))
    taken = importance.drawn(docs, got)
    assert taken.columns == docs.columns and taken.count() == len(ranks)
    assert rows(importance.resample(none, target)) == []
    assert {r["rank"] for r in rows(importance.resample(docs, none, percent=0))} == {None}  # no target texts, nothing to draw
    assert len(rows(importance.resample(docs, none, percent=100))) == len(ROWS)


def test_importance_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, 0, 30, 0, 0, 5 if i % 2 else 9) for i in range(40)] + [(None, 0, 30, 0, 0, 9)],
                                   "doc_id long, tie long, n_words long, n_features long, weight long, score long")
    got = {r["rank"]: r["doc_id"] for r in rows(importance.ranked(scored, 60)) if r["rank"]}
    assert [got[k] for k in sorted(got)] == [*range(0, 40, 2), None, 1, 3, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ab", "é", "7", "\U0001F600", "Zz"]), max_size=60), st.integers(1, 4), st.integers(1, 12))
def test_features_in_pieces(words, longest, most):
    text = " ".join(words).encode()
    whole = Counter(b for g in range(1, longest + 1) for i in range(len(words) - g + 1)
                    for b in [zlib.crc32(" ".join(words[i:i + g]).replace("Zz", "zz").encode()) % 10000])
    before, importance.PIECE = importance.PIECE, most
    try:
        got = list(importance.features(text, longest))
    finally:
        importance.PIECE = before
    assert sum(n for n, _ in got) == len(words)
    assert Counter(int(b) for _, f in got for b in f) == whole


# ---- 12 centroid clustering ----------------------------------------------

def clusters_brute(data, clusters=40, rounds=5, width=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in data if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], dtype=object)
    c = x[:clusters].copy()
    for r in range(rounds + 1):
        d = [[int(((v - m) ** 2).sum()) for m in c] for v in x]
        own = [q.index(min(q)) for q in d]
        if r < rounds:
            for k in range(len(c)):
                mine = [v for v, o in zip(x, own, strict=True) if o == k]
                if mine:
                    c[k] = [int(s) // len(mine) for s in sum(mine)]
    return sorted(((i, o, q[o]) for (i, _), o, q in zip(kept, own, d, strict=True)), key=str), c.tolist()


def clustered(df, **how):
    got, c = centroids.cluster(df, **how)
    return sorted(((r["id"], r["cluster"], r["distance"]) for r in rows(got)), key=str), c.tolist()


def test_clusters_against_brute_force(spark):
    data = [(r["vec_id"], r["embedding"]) for r in table("embeddings")]
    want, c = clusters_brute(data)
    got = rows(queries.op12_centroids(spark, SF))
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    per = Counter()
    for _, k, d in want:
        per[k] += d
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (per[r["cluster"]], sum(per.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_clusters_edges(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, 2.0]), (3, [1.0, None, 2.0]), (4, [1.0, nan, 2.0]), (5, [1.0, -inf, 2.0]), (6, []), (7, [1.0, 2.0, 3.0, 4.0])]
    good = [(i, [float(i % 5), -0.3 * i, 1e-9 * i]) for i in range(60)] + [(8, [1.0, 1.0, 1.0])] * 20 + [(None, [0.5, 0.5, 0.5])] * 2 + [(8, [2.0, 0.0, 0.0])]
    df = clashing(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>"))
    want, c = clusters_brute(good, 6, 5, 3)
    assert clustered(df, width=3, clusters=6) == (want, c)
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<double>")
    assert clustered(few, width=3, clusters=6) == clusters_brute(good[:3], 6, 5, 3)  # fewer vectors than centroids
    assert clustered(few, width=3, clusters=1) == clusters_brute(good[:3], 1, 5, 3)
    empty, none = centroids.cluster(df.limit(0), width=3)
    assert rows(empty) == [] and len(none) == 0 and rows(centroids.summary(empty, none)) == []
    assert rows(centroids.cluster(spark.createDataFrame(bad, "vec_id long, embedding array<double>"), width=3)[0]) == []


def test_clusters_of_large_components(spark):
    far = [(i, [(-1.0) ** i * 300_000.0 + i, 400_000.0 - i, 0.0]) for i in range(30)]
    assert clustered(spark.createDataFrame(far, "vec_id long, embedding array<double>"), width=3, clusters=4) == clusters_brute(far, 4, 5, 3)
    huge = [(1, [1e300, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])]
    got = rows(centroids.cluster(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), width=3, clusters=1)[0])
    assert {r["id"]: r["distance"] > 0 for r in got} == {1: True, 2: True, 3: False}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2 ** 32 - 1), st.integers(1, 6), st.integers(1, 3))
def test_heaps_pop_all_that_can_change(seed, k, spread):
    draw = np.random.default_rng(seed)
    x = draw.integers(-4 * spread, 4 * spread, (50, 2))
    moves = centroids._Moves(x[:k].astype(np.int64).copy())
    heaps, cluster, rescans = [[] for _ in range(k)], None, []
    for _ in range(8):
        cluster, popped = centroids.assign(x, moves.c, moves.drift, cluster, heaps)
        rescans.append(len(popped))
        assert cluster.tolist() == centroids.distances(x, moves.c).argmin(axis=1).tolist()
        assert sum(map(len, heaps)) == len(x)
        moves.n = [int((cluster == j).sum()) for j in range(k)]
        moves.sums = [x[cluster == j].sum(axis=0).tolist() for j in range(k)]
        moves.step()
    assert rescans[0] == len(x)


def test_heaps_spare_rescans():
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.integers(0, 60, (200, 8)) + 1000 * g for g in range(5)])
    moves, heaps, cluster, rescans = centroids._Moves(x[::200].astype(np.int64).copy()), [[] for _ in range(5)], None, 0
    for r in range(6):
        cluster, popped = centroids.assign(x, moves.c, moves.drift, cluster, heaps)
        rescans += len(popped) if r else 0
        moves.n, moves.sums = [int((cluster == j).sum()) for j in range(5)], [x[cluster == j].sum(axis=0).tolist() for j in range(5)]
        moves.step()
    assert rescans == 0  # well apart: no bound ever expires


# ---- 13 fingerprints -----------------------------------------------------

def set_brute(text, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    runs = [words] if 0 < len(words) < width else [words[i:i + width] for i in range(len(words) - width + 1)]
    return {hashlib.md5(" ".join(r).encode()).hexdigest()[:16] for r in runs}


def near_brute(a, b, k=fingerprint.K):
    union = sorted(set(sorted(a)[:k]) | set(sorted(b)[:k]))[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def fingerprints_brute(data):
    order = sorted({(i, t or "") for i, t in data}, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = set_brute(t), set_brute(edited), set_brute(after)
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(sorted(a)[:fingerprint.K]), ",".join(sorted(b)[:fingerprint.K]), near_brute(a, b), near_brute(a, c))
    return out


def test_op13_against_brute_force(spark):
    data = [(r["doc_id"], r["text"]) for r in table("documents")]
    want = {i: v for (i, _), v in fingerprints_brute(data).items()}
    got = rows(queries.op13_fingerprints(spark, SF))
    assert len(got) == len(data)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == pytest.approx(want[r["doc_id"]])


def test_fingerprint_edges(spark, docs, none):
    got = rows(fingerprint.edited_halves(docs))
    assert len(got) == len(ROWS)
    alone = [r for r in ROWS if r[0] not in (None, 9, 10)]  # ids without a second text
    after = {i: sorted(j for j, _ in ROWS if j is not None and j > i)[0] for i, _ in alone if i != 9}
    texts = {i: t or "" for i, t in ROWS if i not in (None, 10)}
    for i, t in alone:
        t, r = t or "", next(r for r in got if r["doc_id"] == i)
        half = len(t) // 2
        assert r["n_chars"] == len(t) and r["sketch"] == sorted(set_brute(t))[:fingerprint.K]
        if after[i] in texts:
            n = texts[after[i]]
            assert r["edited"] == t[:len(t) - half] + n[:half] and r["next_sketch"] == sorted(set_brute(n))[:fingerprint.K]
            assert r["edited_sketch"] == sorted(set_brute(r["edited"]))[:fingerprint.K]
    assert [r["next_sketch"] for r in got if r["doc_id"] == 9] == [next(r for r in got if r["doc_id"] == 9)["next_sketch"]] * 2  # repeated rows agree
    assert rows(fingerprint.edited_halves(none)) == []
    one = rows(fingerprint.edited_halves(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")))  # follows itself
    assert one[0]["edited"] == "a b a b"[:7][:4] + "a b" and one[0]["next_sketch"] == one[0]["sketch"]
    kept = fingerprint.fingerprints(docs)
    assert {(r["doc_id"], r["text"]): r["shingles"] for r in rows(kept)}[8, "one two"] == 1.0
    assert {r["shingles"] for r in rows(kept) if not r["text"].strip()} == {0.0}


def test_sketches_merge_and_estimate(spark):
    k = 64
    sets = {"a": range(0, 3000), "b": range(1000, 4000), "c": range(0, 40), "d": range(0, 0)}
    parts = []
    for name, numbers in sets.items():
        for at in range(7):  # parts of each set, and their sketches
            mine = [n for n in numbers if n % 7 == at]
            parts.append((name, sorted(hashlib.md5(str(n).encode()).hexdigest()[:16] for n in mine)[:k]))
    df = clashing(spark.createDataFrame(parts, "set string, own array<string>"))
    got = {r["set"]: r["own"] for r in rows(fingerprint.merge(df, ["set"], "own", k))}
    for name, numbers in sets.items():
        assert got[name] == sorted(hashlib.md5(str(n).encode()).hexdigest()[:16] for n in numbers)[:k]
    one = spark.createDataFrame([tuple(got[n] for n in "abcd")], "a array<string>, b array<string>, c array<string>, d array<string>")
    a, b, c, d = (F.col(n) for n in "abcd")
    r = rows(one.select(
        fingerprint.resemblance(a, b, k).alias("ab"), fingerprint.containment(c, a, k).alias("ca"), fingerprint.containment(a, b, k).alias("cab"),
        fingerprint.n_distinct(a, k).alias("na"), fingerprint.n_distinct(c, k).alias("nc"), fingerprint.resemblance(d, d, k).alias("dd"),
        fingerprint.resemblance(a, d, k).alias("ad"), fingerprint.containment(d, a, k).alias("da"),
        (fingerprint.merged(a, b, k) == fingerprint.merged(b, a, k)).alias("same"), fingerprint.from_text(fingerprint.text_form(a)).alias("round"),
        fingerprint.unpacked(fingerprint.packed(a)).alias("packed"), fingerprint.unpacked(fingerprint.packed(d)).alias("nothing")))[0]
    assert abs(r["ab"] - 0.5) < 0.2 and abs(r["na"] - 3000) < 900 and r["nc"] == 40.0
    assert abs(r["cab"] - 2 / 3) < 0.3 and r["ca"] > 0.5
    assert (r["dd"], r["ad"], r["da"]) == (1.0, 0.0, 0.0) and r["same"]
    assert r["round"] == got["a"] and r["packed"] == got["a"] and r["nothing"] == []


def test_fingerprint_plan_has_no_python(spark):
    plan = queries.op13_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
