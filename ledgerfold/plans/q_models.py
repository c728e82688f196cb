"""Catalogue: feature configs, classifiers, oversampling, CV, tuning, topics
plus the exact SQL forms of ANOVA-F selection (M11), U_mass coherence (M3) and the summary (S13).

Modelling table: labelled documents (targets ``quality`` and ``toxic``).
Config A = structured (length, lines, language, source), B = TF-IDF (the 100 of
500 terms with the highest ANOVA F; vocabulary, IDF and choice from the training
part alone, zeros for documents outside the TF-IDF corpus), C = LDA topic shares
(K = 12, fitted on unlabelled documents, zeros outside Track A), D = A + B + C, and
A + C on the documents that have both.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.feature import (IDF, CountVectorizer, NGram, SQLTransformer, StopWordsRemover,
                                UnivariateFeatureSelector)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerfold.functions import text as tx
from ledgerfold.operators import evaluate as ev
from ledgerfold.operators import folds as fd
from ledgerfold.operators import features, grid, oversample, sampling, topics
from ledgerfold.operators import text as ot
from ledgerfold.plans.common import rounded
from ledgerfold.plans.q_text import EN, LT, TT, _TFIDF_SQL, track_a, track_a_of
from ledgerfold.plans.registry import query
from ledgerfold.session import materialize
from ledgerfold.sources import bindings
from ledgerfold.sources.tables import spread

TARGETS = ["quality", "toxic"]
CONFIGS = {"structured": ["A"], "tfidf": ["B"], "topics": ["C"], "combined": ["A", "B", "C"], "structured_topics": ["A", "C"]}
K_TOPICS = 12


def _lda(spark, sf_dir, k=K_TOPICS):
    """Vocabulary, term vectors and the topic model fitted on them."""
    ta = materialize(track_a(spark, sf_dir).select("doc_id", "tokens"))  # read by the three passes of the vocabulary and by the vectors
    cvm, vecs = topics.bow_vectors(ta, "tokens", 15, 0.5)
    vecs = materialize(vecs.select("doc_id", "bow"))
    return cvm, vecs, topics.fit_lda(vecs, cvm.vocabulary, k)


def structured_rows(spark, sf_dir):
    """(doc_id, quality, toxic, A): the structured features of each labelled document; A's names are its comment."""
    d = bindings.labelled_documents(spark, sf_dir)
    d = features.rare_level_grouping(d, "source", 10, "source_g")
    d = features.one_hot(d, "lang", "lang")
    d = features.one_hot(d, "source_g", "src")
    onehots = [c for c in d.columns if c.startswith("lang_") or c.startswith("src_")]
    names = ["log_length", "log_lines", *onehots]
    return d.select("doc_id", "quality", "toxic", F.array(
        F.log1p(F.col("n_chars").cast("double")),
        F.log1p(F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("double")),
        *[F.col(c).cast("double") for c in onehots]).alias("A", metadata={"names": names}))


def parts(spark, sf_dir, target, n_folds=None):
    """(doc_id, y, fold, valid): held-out part of each labelled document and whether it helps to choose thresholds.
    Without ``n_folds``: the test fifth is part 0, the others have none."""
    lab = bindings.labelled_documents(spark, sf_dir).select("doc_id", F.col(target).alias("y"))
    if n_folds:
        p = sampling.stratified_folds(lab, "doc_id", "y", n_folds, 42)
    else:
        p = sampling.stratified_split(lab, "doc_id", "y", 0.2, 42).select("doc_id", "y", F.when(F.col("is_test"), 0).cast("int").alias("fold"))
    v = sampling.stratified_folds(lab, "doc_id", "y", 5, 43).select("doc_id", (F.col("fold") == 0).alias("valid"))
    return materialize(p.join(v, "doc_id"))


def shared_features(spark, sf_dir):
    """What all targets and parts share: structured features, terms, topic shares. Topics are fitted on the
    documents without labels, none of which is ever held out."""
    with ThreadPoolExecutor(2) as pool:  # neither needs the other
        c = pool.submit(_topic_shares, spark, sf_dir)
        words, keys = word_table(spark, sf_dir)
        terms = fd.Terms(words, "doc_id", tx.uni_bigrams("u"))
        return materialize(structured_rows(spark, sf_dir).select("doc_id", "A")), terms, keys, c.result()


def _topic_shares(spark, sf_dir):
    """(doc_id, C): topic shares of the labelled documents."""
    ta = track_a(spark, sf_dir).join(bindings.table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("_l")), "doc_id", "left")
    ta = materialize(ta.select("doc_id", "tokens", F.col("_l").isNull().alias("free")))
    cvm, _ = topics.bow_vectors(ta.filter("free"), "tokens", 15, 0.5)
    vecs = materialize(cvm.transform(ta).select("doc_id", "free", "bow"))
    c = topics.doc_topics(topics.fit_lda(vecs.filter("free"), cvm.vocabulary, K_TOPICS), vecs.filter(~F.col("free")), "doc_id")
    return materialize(c.withColumnRenamed("topics", "C"))


def part_rows(shared, p, n_folds):
    """(fold, doc_id, y, role, A, B, C, has_topics): every labelled document once for each held-out part, with the
    vocabulary, IDF and F-selection (B) of that part's training documents; and the chosen terms (fold, term, rank)."""
    a, terms, keys, c = shared
    k = n_folds or 1
    labels = p.select("doc_id", "y")
    tc, voc = fd.terms_per_fold(terms, fd.training_sizes(keys, "doc_id", p, k), p, k)
    w = materialize(fd.fold_weights(tc.join(labels.select("doc_id"), "doc_id", "left_semi"), "doc_id", "term", voc))
    chosen = materialize(fd.fold_anova(w, "doc_id", "term", labels, p, "y"))
    b = fd.fold_arrays(w, "doc_id", "term", chosen, 100).withColumnRenamed("arr", "B")
    rows = p.withColumnRenamed("fold", "own").select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    role = F.when(F.col("own").eqNullSafe(F.col("fold")), "test").when(F.col("valid"), "valid").otherwise("train")
    rows = rows.select("fold", "doc_id", "y", role.alias("role")).join(a, "doc_id").join(b, ["fold", "doc_id"], "left").join(c, "doc_id", "left")
    rows = rows.select("fold", "doc_id", "y", "role", "A", F.coalesce("B", F.array_repeat(F.lit(0.0), 100)).alias("B"),
                       F.coalesce("C", F.array_repeat(F.lit(0.0), K_TOPICS)).alias("C"), F.col("C").isNotNull().alias("has_topics"))
    return materialize(rows), chosen


def config_rows(rows, config):
    """One config's features; structured_topics aligns both sets on the documents that have both."""
    if config == "structured_topics":
        rows = rows.filter("has_topics")
    cols = CONFIGS[config]
    return rows.select("fold", "doc_id", "y", "role", (F.concat(*cols) if len(cols) > 1 else F.col(cols[0])).alias("arr"))


def training_rows(rows, oversampler=oversample.smote):
    """The rows to fit on; below the trigger share the minority is oversampled (train part alone)."""
    train = rows.filter("role = 'train'").select("doc_id", "arr", "y")
    _, n_min, n_maj = oversample.class_counts(train, "y")
    if n_min and n_min / (n_min + n_maj) < grid.SMOTE_TRIGGER:
        return materialize(oversampler(train, "doc_id", "arr", "y", grid.SMOTE_RATIO, seed=42).select("doc_id", "arr", "y")), True
    return train.withColumn("doc_id", F.col("doc_id").cast("string")), False


def _cells(shared, spark, sf_dir, targets, configs, algorithms, n_folds=None):
    """The cells of a grid, and whether each one's training rows were oversampled."""
    parts_ = []
    with ThreadPoolExecutor(len(targets)) as pool:
        tables = list(pool.map(lambda t: part_rows(shared, parts(spark, sf_dir, t, n_folds), n_folds)[0], targets))
    for target, rows in zip(targets, tables, strict=True):
        parts_ += [(target, config, k, config_rows(rows.filter(F.col("fold") == k), config)) for config in configs for k in range(n_folds or 1)]
    with ThreadPoolExecutor(grid.THREADS) as pool:
        trains = list(pool.map(lambda p: training_rows(p[3]), parts_))
    cells, smoted = [], []
    for (target, config, k, r), (train, s) in zip(parts_, trains, strict=True):
        score = r.filter("role <> 'train'").select("doc_id", "arr", "y", "role")
        for algorithm in algorithms:
            cells.append(grid.Cell({"target": target, "config": config, "algorithm": algorithm, "fold": k}, train, score, algorithm, "B" not in CONFIGS[config]))
            smoted.append(s)
    return cells, smoted


KEYS = ["target", "config", "algorithm", "fold"]
ALGORITHMS = ["LogisticRegression", "RandomForest"]


def _run_grid(spark, sf_dir, algorithms, configs=tuple(CONFIGS), targets=TARGETS):
    """One row per target, config and algorithm on the stratified 80/20 split."""
    cells, smoted = _cells(shared_features(spark, sf_dir), spark, sf_dir, targets, configs, algorithms)
    scored = grid.all_scores(cells)
    about = spark.createDataFrame([(*[c.keys[k] for k in KEYS], *n, s) for c, n, s in zip(cells, grid.sizes(cells), smoted, strict=True)],
                                  "target string, config string, algorithm string, fold int, n_train bigint, n_pos_train bigint, smote_applied boolean")
    m = grid.metrics(scored, KEYS).join(about, KEYS).drop("fold")
    return materialize(rounded(m.select("target", "config", "algorithm", "precision", "recall", "f1", "auc", "avg_precision", "best_threshold",
                                        "f1_default_threshold", "precision_default", "recall_default", "n_train", "n_test", "n_pos_train", "n_pos_test", "smote_applied")))


@query("lr_grid")
def lr_grid(spark, sf_dir):
    """Logistic regression for 2 targets × 5 configs on a stratified 80/20 split."""
    return _run_grid(spark, sf_dir, ["LogisticRegression"])


@query("rf_grid")
def rf_grid(spark, sf_dir):
    """Random forest (200 trees, depth 20) for 2 targets × 5 configs."""
    return _run_grid(spark, sf_dir, ["RandomForest"])


@query("cv_oversampled")
def cv_oversampled(spark, sf_dir):
    """5-fold CV of 4 configs × 2 algorithms a target, features and oversampling fitted per training part."""
    cells, _ = _cells(shared_features(spark, sf_dir), spark, sf_dir, TARGETS, ["structured", "tfidf", "topics", "combined"], ALGORITHMS, 5)
    scored = grid.all_scores(cells)
    per = grid.metrics(scored, KEYS)
    s = ev.cv_summary(per, KEYS[:3]).join(per.groupBy(*KEYS[:3]).agg(F.avg("best_threshold").alias("threshold_mean")), KEYS[:3])
    return materialize(rounded(s))


def structured_train(spark, sf_dir):
    """(doc_id, arr, toxic): the training part of the structured config, target toxic."""
    rows = structured_rows(spark, sf_dir).select("doc_id", F.col("A").alias("arr"), "toxic")
    return materialize(sampling.stratified_split(rows, "doc_id", "toxic", 0.2, 42).filter(~F.col("is_test")).drop("is_test"))


def _oversampled(spark, sf_dir, fn):
    out = fn(structured_train(spark, sf_dir), "doc_id", "arr", "toxic")
    return rounded(out.select("doc_id", "toxic", "synthetic", F.size("arr").alias("n_features"),
                              F.col("arr")[0].alias("log_length")))


def _oversample_sql(ratio: str, k: int, m: int, origins: str) -> str:
    """The training part, its neighbours by full comparison, and the synthetic rows; ``origins`` gives (doc_id, g).
    The square of a distance between one-hot blocks is 2 where the levels differ."""
    def drawn(salt):
        return f"CAST('0x' || left(md5('42:{salt}:' || o.doc_id || ':' || j), 8) AS BIGINT)"

    return f"""
WITH src AS (SELECT COALESCE(source, 'UNKNOWN') AS lvl, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY n DESC, lvl LIMIT 10),
f AS (SELECT doc_id, toxic, ln(1 + n_chars::DOUBLE) AS l, ln(1 + len(string_split(COALESCE(text, ''), chr(10)))::DOUBLE) AS r, lang,
        CASE WHEN COALESCE(source, 'UNKNOWN') IN (SELECT lvl FROM src) THEN COALESCE(source, 'UNKNOWN') ELSE 'OTHER' END AS g
      FROM documents JOIN labels USING (doc_id)),
nf AS (SELECT CAST(2 + count(DISTINCT lang) + count(DISTINCT g) AS INTEGER) AS n_features FROM f),
t AS MATERIALIZED (SELECT * EXCLUDE (rn, n) FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS rn,
        count(*) OVER (PARTITION BY toxic) AS n FROM f) z WHERE rn > ceil(n * 0.2)),
c AS (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS q FROM t),
x AS (SELECT CASE WHEN p <= q THEN 1 ELSE 0 END AS y, CAST(trunc({ratio}::DOUBLE * greatest(p, q) - least(p, q)) AS BIGINT) AS total FROM c),
mi AS (SELECT t.* FROM t, x WHERE toxic = y),
dist AS (SELECT a.doc_id AS q, b.doc_id AS nb, b.toxic, sqrt(power(a.l - b.l, 2) + power(a.r - b.r, 2) + CASE WHEN a.lang <> b.lang THEN 2 ELSE 0 END + CASE WHEN a.g <> b.g THEN 2 ELSE 0 END) AS d
         FROM mi a JOIN t b ON a.doc_id <> b.doc_id),
nn AS MATERIALIZED (SELECT q, nb, row_number() OVER (PARTITION BY q ORDER BY d, nb) AS rk, count(*) OVER (PARTITION BY q) AS n FROM dist, x WHERE toxic = y QUALIFY rk <= {k}),
maj AS MATERIALIZED (SELECT q AS doc_id, count(*) FILTER (toxic <> y) AS m FROM (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, nb) <= {m}) e, x GROUP BY 1),
{origins},
s AS (SELECT o.doc_id, j, {drawn('pick')} % least(n, {k}) + 1 AS pick, {drawn('u')} / 4294967296.0::DOUBLE AS u
      FROM (SELECT doc_id, unnest(range(1, CAST(g AS BIGINT) + 1)) AS j FROM o WHERE g > 0) o JOIN (SELECT DISTINCT q, n FROM nn) z ON z.q = o.doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, toxic, false AS synthetic, n_features, round(l, 6) AS log_length FROM t, nf
UNION ALL SELECT s.doc_id || '#' || j, CAST(x.y AS INTEGER), true, n_features, round(a.l + u * (b.l - a.l), 6)
FROM s JOIN nn ON nn.q = s.doc_id AND nn.rk = s.pick JOIN t a ON a.doc_id = s.doc_id JOIN t b ON b.doc_id = nn.nb, nf, x"""


def _spread_sql(points: str) -> str:
    return f"""o AS (SELECT doc_id, total // n + CASE WHEN rn <= total % n THEN 1 ELSE 0 END AS g FROM (
  SELECT doc_id, greatest(total, 0) AS total, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR)) AS rn FROM {points}, x) z)"""


@query("smote", _oversample_sql("0.3", 5, 10, _spread_sql("mi")))
def smote_q(spark, sf_dir):
    """SMOTE (ratio 0.3, k 5) on the training part of the structured config, target toxic."""
    return _oversampled(spark, sf_dir, lambda d, k, v, l: oversample.smote(d, k, v, l, 0.3, 5, 42))


@query("borderline_smote", _oversample_sql("1.0", 5, 10, _spread_sql("(SELECT doc_id FROM maj WHERE m * 2 >= 10 AND m < 10)")))
def borderline_smote_q(spark, sf_dir):
    """Borderline-SMOTE (m 10, k 5) to parity."""
    return _oversampled(spark, sf_dir, lambda d, k, v, l: oversample.borderline_smote(d, k, v, l, 1.0, 5, 10, 42))


@query("adasyn", _oversample_sql("1.0", 5, 5, """o AS (SELECT doc_id, CASE WHEN m > 0 THEN round_even(m * greatest(total, 0) / (sum(m) OVER ())::DOUBLE, 0) ELSE 0 END AS g FROM maj, x)"""))
def adasyn_q(spark, sf_dir):
    """ADASYN (k 5) to parity."""
    return _oversampled(spark, sf_dir, lambda d, k, v, l: oversample.adasyn(d, k, v, l, 1.0, 5, 42))


# The reference's grids and its weights of the two classes for logistic regression.
LR_POINTS = [{"C": c, "elasticNetParam": e} for c in (0.1, 1.0, 10.0) for e in (1.0, 0.0)]
LR_WEIGHTS = {0: 1.0, 1: 3.0}
RF_POINTS = [{"maxDepth": d, "minInstancesPerNode": m} for d in (10, 20, 30) for m in (1, 5)]
OVERSAMPLERS = {"SMOTE": oversample.smote, "BorderlineSMOTE": oversample.borderline_smote, "ADASYN": oversample.adasyn}


def _point(algorithm, params):
    return ", ".join(f"{k}={v:g}" for k, v in sorted(params.items()))


def _search(spark, sf_dir, target):
    """(algorithm, params, f1): 3-fold CV of every grid point on the structured config's training part, F1 at 0.5."""
    rows = structured_rows(spark, sf_dir).select("doc_id", F.col("A").alias("arr"), F.col(target).alias("y"))
    train = sampling.stratified_split(rows, "doc_id", "y", 0.2, 42).filter(~F.col("is_test")).drop("is_test")
    train = materialize(sampling.stratified_folds(train, "doc_id", "y", 3, 44))
    cells = []
    for k in range(3):
        fit_on = train.filter(F.col("fold") != k)
        judged = train.filter(F.col("fold") == k).withColumn("role", F.lit("test"))
        for algorithm, points, weights in (("LogisticRegression", LR_POINTS, LR_WEIGHTS), ("RandomForest", RF_POINTS, "balanced")):
            cells += [grid.Cell({"algorithm": algorithm, "params": _point(algorithm, p), "fold": k}, fit_on, judged, algorithm, True, weights, p) for p in points]
    scored = grid.all_scores(cells)
    per = ev.confusion(scored, ["algorithm", "params", "fold"], "y", "score", 0.5)
    return materialize(per.groupBy("algorithm", "params").agg(F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n_folds")))


@query("grid_search")
def grid_search(spark, sf_dir):
    """LR grid (C × penalty, weights {0: 1, 1: 3}) and RF grid (200 trees, depth × min leaf, balanced), 3-fold CV by F1."""
    w = Window.partitionBy("algorithm").orderBy(F.desc("f1"), "params")  # a row per grid point
    return rounded(_search(spark, sf_dir, "quality").withColumn("rank", F.row_number().over(w)))


def _compare_oversamplers(spark, sf_dir, target):
    rows = structured_rows(spark, sf_dir).select("doc_id", "A", F.lit(0).alias("fold"))
    r = materialize(rows.join(parts(spark, sf_dir, target).withColumnRenamed("fold", "own"), "doc_id").select(
        "doc_id", F.col("A").alias("arr"), "y", F.when(F.col("own") == 0, "test").when(F.col("valid"), "valid").otherwise("train").alias("role")))
    train = r.filter("role = 'train'").select("doc_id", "arr", "y")
    cells = []
    for name, fn in OVERSAMPLERS.items():
        more = materialize(fn(train, "doc_id", "arr", "y", grid.SMOTE_RATIO, seed=42).select("doc_id", "arr", "y"))
        cells.append(grid.Cell({"variant": name}, more, r.filter("role <> 'train'"), "RandomForest"))
    scored = grid.all_scores(cells)
    about = spark.createDataFrame([(c.keys["variant"], *n) for c, n in zip(cells, grid.sizes(cells), strict=True)], "variant string, n_train bigint, n_pos_train bigint")
    m = grid.metrics(scored, ["variant"]).join(about, "variant")
    return materialize(m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), F.desc("auc"), "variant"))))  # three rows


@query("oversampler_comparison")
def oversampler_comparison(spark, sf_dir):
    """The three oversamplers at ratio 0.3 under one forest (structured config, target toxic), best first."""
    return rounded(_compare_oversamplers(spark, sf_dir, "toxic").select(
        "variant", "rank", "f1", "auc", "best_threshold", "n_train", "n_pos_train", "n_test", "n_pos_test"))


@query("tuned_refit")
def tuned_refit(spark, sf_dir):
    """The combined config with default and with the searched parameters and the best oversampler, target toxic."""
    target = "toxic"
    variant = _compare_oversamplers(spark, sf_dir, target).filter("rank = 1").first()["variant"]
    found = _search(spark, sf_dir, target).orderBy(F.desc("f1"), "params").collect()  # a row per grid point
    rows, _ = part_rows(shared_features(spark, sf_dir), parts(spark, sf_dir, target), None)
    r = config_rows(rows, "combined")
    train, _ = training_rows(r, OVERSAMPLERS[variant])
    cells = []
    for algorithm, points, weights in (("LogisticRegression", LR_POINTS, LR_WEIGHTS), ("RandomForest", RF_POINTS, "balanced")):
        named = {_point(algorithm, p): p for p in points}
        best = next(f["params"] for f in found if f["algorithm"] == algorithm)
        for phase, params, w in (("before", {}, "balanced"), ("after", named[best], weights)):
            cells.append(grid.Cell({"phase": phase, "algorithm": algorithm, "params": _point(algorithm, params) or "default"}, train,
                                   r.filter("role <> 'train'").select("doc_id", "arr", "y", "role"), algorithm, False, w, params))
    scored = grid.all_scores(cells)
    m = grid.metrics(scored, ["phase", "algorithm", "params"])
    return rounded(m.select("phase", "algorithm", "params", F.lit("combined").alias("config"), F.lit(variant).alias("smote_variant"), "best_threshold", "f1", "auc"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Top-20 random-forest importances on the combined config (target quality), by feature name."""
    shared = shared_features(spark, sf_dir)
    rows, chosen = part_rows(shared, parts(spark, sf_dir, "quality"), None)
    r = config_rows(rows, "combined")
    train, _ = training_rows(r)
    model, _ = grid.fit(grid.Cell({}, train, r, "RandomForest", False))
    terms = {c["rank"]: c["term"] for c in chosen.collect()}  # 100 rows
    names = structured_rows(spark, sf_dir).schema["A"].metadata["names"] + [terms.get(i, f"unused_{i}") for i in range(1, 101)] + [f"topic_{i}" for i in range(K_TOPICS)]
    imp = model.featureImportances.toArray().tolist()  # one value per feature: bounded by the config's width
    res = spark.createDataFrame(list(zip(range(len(imp)), names, imp, strict=True)), "feature int, name string, importance double")
    return rounded(res.orderBy(F.desc("importance"), "feature").limit(20))


@query("ml_tfidf_select")
def ml_tfidf_select(spark, sf_dir):
    """M11 (ML path): CountVectorizer/IDF pipeline + ANOVA-F UnivariateFeatureSelector, top 100 terms."""
    d = bindings.labelled_documents(spark, sf_dir).select("doc_id", "text", F.col("quality").cast("double").alias("y"))
    most = topics.most_documents(0.5, d.count())
    d = d.withColumn("tokens", tx.light_tokens("text"))
    pipe = Pipeline(stages=[
        StopWordsRemover(inputCol="tokens", outputCol="u", stopWords=list(tx.ENGLISH_STOP_WORDS)),
        NGram(n=2, inputCol="u", outputCol="bi"),
        SQLTransformer(statement="SELECT *, concat(u, bi) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=500, minDF=10.0, maxDF=most),
        IDF(inputCol="tf", outputCol="tfidf"),
        UnivariateFeatureSelector(featuresCol="tfidf", labelCol="y", outputCol="sel", selectionMode="numTopFeatures")
        .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(100),
    ])
    m = pipe.fit(d)
    vocab = m.stages[3].vocabulary
    sel = m.stages[5].selectedFeatures
    return spark.createDataFrame([(i, vocab[i]) for i in sel], "idx int, term string")  # ≤ 100 rows


@query("lda_topics")
def lda_topics(spark, sf_dir):
    """M1/M5: K=12 online LDA on Track A; top-10 words per topic with the 3-word label."""
    cvm, _, lda = _lda(spark, sf_dir)
    terms = topics.topic_terms(lda, cvm.vocabulary, spark, 10)
    return rounded(terms.join(topics.topic_labels(terms), "topic"))


@query("doc_topics")
def doc_topics(spark, sf_dir):
    """M4: topic distribution per Track A document (rows sum to ≈ 1)."""
    _, vecs, lda = _lda(spark, sf_dir)
    dt = topics.doc_topics(lda, vecs, "doc_id")
    return rounded(dt.select("doc_id", F.aggregate("topics", F.lit(0.0), lambda a, x: a + x).alias("total"),
                             F.array_max("topics").alias("max_share"),
                             F.array_position("topics", F.array_max("topics")).alias("top_topic")))


@query("topic_outcome")
def topic_outcome(spark, sf_dir):
    """M6: topic share by quality class, difference ranked."""
    _, vecs, lda = _lda(spark, sf_dir)
    dt = topics.doc_topics(lda, vecs, "doc_id")
    lab = bindings.table(spark, sf_dir, "labels")
    return rounded(topics.topic_outcome(dt, lab, "doc_id", "quality").orderBy(F.desc("diff")))


@query("topic_sweep")
def topic_sweep(spark, sf_dir):
    """K ∈ {10,12,15,18,20,25,30}; mean C_v and U_mass coherence per K; best K by C_v (first on ties)."""
    ta = materialize(track_a(spark, sf_dir).select("doc_id", "tokens"))
    cvm, vecs = topics.bow_vectors(ta, "tokens", 15, 0.5)
    vecs = materialize(vecs.select("doc_id", "bow"))
    words, ks = None, [10, 12, 15, 18, 20, 25, 30]
    for k, model in zip(ks, topics.fit_ldas(vecs, cvm.vocabulary, ks), strict=True):
        tw = topics.topic_terms(model, cvm.vocabulary, spark, 10)
        tw = tw.select((F.lit(1000 * k) + F.col("topic")).alias("topic"), "rank", "term")
        words = tw if words is None else words.unionByName(tw)
    words = materialize(words)  # 10 words of each topic of each K: one pass over the corpus counts them all
    c = topics.cv(words, ta, "doc_id", "tokens").join(topics.umass(words, ta, "doc_id", "tokens"), "topic")
    out = materialize(c.groupBy((F.col("topic") / 1000).cast("int").alias("k")).agg(F.avg("c_v").alias("c_v"), F.avg("u_mass").alias("u_mass")))
    best = out.agg(F.max_by("k", F.struct("c_v", -F.col("k")))).scalar()
    return rounded(out.withColumn("best_k", best))


@query("model_lift")
def model_lift(spark, sf_dir):
    """Lift of the combined over the structured config per target and algorithm (LR)."""
    r = _run_grid(spark, sf_dir, ["LogisticRegression"], ["structured", "combined"])
    a = r.filter(F.col("config") == "structured").select("target", "algorithm", F.col("f1").alias("f1_a"),
                                                          F.col("auc").alias("auc_a"))
    d = r.filter(F.col("config") == "combined").select("target", "algorithm", F.col("f1").alias("f1_d"),
                                                        F.col("auc").alias("auc_d"))
    j = a.join(d, ["target", "algorithm"])
    return rounded(j.withColumn("f1_lift_pct", F.when(F.col("f1_a") != 0, (F.col("f1_d") - F.col("f1_a")) / F.col("f1_a") * 100))
                    .withColumn("auc_lift_pct", F.when(F.col("auc_a") != 0, (F.col("auc_d") - F.col("auc_a")) / F.col("auc_a") * 100)))


@query("score_linked")
def score_linked(spark, sf_dir):
    """Fit the structured LR on the documents that no program is linked to, persist it (model + metadata) in the
    checkpoint folder, reload it and score the linked documents, none of which it has seen (A25/A26)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    from ledgerfold.operators import linkage
    from ledgerfold.plans.q_linkage import _best
    from ledgerfold.session import checkpoint_dir
    from ledgerfold.sources import sinks
    rows = structured_rows(spark, sf_dir).select("doc_id", array_to_vector("A").alias("features"), F.col("quality").cast("double").alias("quality"))
    linked = materialize(_best(spark, sf_dir).filter(F.col("match_type") != "no_match").select("doc_id").distinct())
    pipe = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                            LogisticRegression(featuresCol="scaled", labelCol="quality", maxIter=1000, tol=1e-4)])
    path = f"{checkpoint_dir(spark)}/models/structured_quality_{spark.sparkContext.applicationId}"
    sinks.save_model(pipe.fit(rows.join(linked, "doc_id", "left_anti")), path, {"config": "structured", "target": "quality"})
    model = PipelineModel.load(f"{path}/model")
    scored = model.transform(rows.join(linked, "doc_id", "left_semi"))
    pred = scored.select(F.col("quality").cast("int").alias("label"),
                         (vector_to_array("probability")[1] >= 0.5).cast("int").alias("predicted"))
    return rounded(linkage.agreement(pred, "label", "predicted"))


# ---- exact SQL forms ------------------------------------------------------

@query("anova_f_terms", _TFIDF_SQL + """,
nw AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w),
lab AS (SELECT c.doc_id, l.quality AS y FROM c JOIN labels l ON c.doc_id = l.doc_id),
cls AS (SELECT y, count(*) AS n_c FROM lab GROUP BY y),
tot AS (SELECT sum(n_c) AS n FROM cls),
s AS (SELECT term, y, sum(weight) AS sx, sum(weight * weight) AS sxx FROM nw JOIN lab USING (doc_id) GROUP BY term, y),
terms AS (SELECT DISTINCT term FROM nw),
ga AS (SELECT t.term, cls.y, cls.n_c, COALESCE(s.sx, 0) AS sx, COALESCE(s.sxx, 0) AS sxx FROM terms t CROSS JOIN cls LEFT JOIN s ON s.term = t.term AND s.y = cls.y),
gt AS (SELECT term, sum(sx) AS sx_all FROM ga GROUP BY term),
f AS (SELECT term, sum(n_c * power(sx / n_c - sx_all / tot.n, 2)) AS ssb, sum(sxx - sx * sx / n_c) AS ssw,
        max(tot.n) AS n, count(*) AS k FROM ga JOIN gt USING (term), tot GROUP BY term)
SELECT term, round(CASE WHEN ssw > 0 THEN (ssb / (k - 1)) / (ssw / (n - k)) END, 6) AS f_stat,
  CAST(row_number() OVER (ORDER BY CASE WHEN ssw > 0 THEN (ssb / (k - 1)) / (ssw / (n - k)) END DESC NULLS LAST, term) AS INTEGER) AS rank
FROM f QUALIFY rank <= 100""")
def anova_f_terms(spark, sf_dir):
    """M11 (SQL form): one-way ANOVA F of each TF-IDF term against quality (absent = 0), top 100."""
    dd = bindings.table(spark, sf_dir, "documents")
    corpus = ot.tfidf_corpus(dd, "doc_id", "text")
    w = ot.tfidf(corpus, "doc_id", "tokens", 500, 10, 0.5, n_docs=ot.corpus_size(dd, "text"))
    lab = corpus.select("doc_id").join(bindings.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    n0 = lab.agg(F.count_if(F.col("y") == 0)).scalar()
    n1 = lab.agg(F.count_if(F.col("y") == 1)).scalar()
    j = w.join(lab, "doc_id")
    s = j.groupBy("term").agg(
        F.sum(F.when(F.col("y") == 0, F.col("weight"))).alias("sx0"), F.sum(F.when(F.col("y") == 0, F.col("weight") ** 2)).alias("sxx0"),
        F.sum(F.when(F.col("y") == 1, F.col("weight"))).alias("sx1"), F.sum(F.when(F.col("y") == 1, F.col("weight") ** 2)).alias("sxx1"))
    f = (w.select("term").distinct().join(s, "term", "left").na.fill(0.0, ["sx0", "sxx0", "sx1", "sxx1"])
          .withColumn("n", n0 + n1).withColumn("k", F.lit(2)))
    m = (F.col("sx0") + F.col("sx1")) / F.col("n")
    f = (f.withColumn("ssb", n0 * F.pow(F.col("sx0") / n0 - m, 2) + n1 * F.pow(F.col("sx1") / n1 - m, 2))
          .withColumn("ssw", (F.col("sxx0") - F.col("sx0") * F.col("sx0") / n0) + (F.col("sxx1") - F.col("sx1") * F.col("sx1") / n1)))
    fs = F.when(F.col("ssw") > 0, (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))
    top = f.select("term", fs.alias("f_stat")).orderBy(F.desc_nulls_last("f_stat"), "term").limit(100)
    w_ = Window.orderBy(F.desc_nulls_last("f_stat"), "term")
    return rounded(top.withColumn("rank", F.row_number().over(w_)))  # 100 rows


_TA_SQL = f"""(SELECT d.doc_id, d.lang, tokens FROM (SELECT doc_id, {TT('text')} AS tokens FROM documents WHERE length(text) >= 100) x
  JOIN documents d USING (doc_id) WHERE len(tokens) > 0)"""


def corpus_by_lang(spark, sf_dir):
    """(doc_id, lang, tokens) of Track A, stored: the topic table and the counts read it."""
    d = spread(bindings.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return materialize(track_a_of(d, "lang").select("doc_id", "lang", "tokens"))


def fixed_topics(ta):
    """A fixed topic-word table from the data: the 10 most frequent Track A tokens per language."""
    c = ta.select("lang", F.explode("tokens").alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    # one partition per language over its distinct-token counts
    return c.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select(F.col("lang").alias("topic"), "rank", "term")


@query("u_mass_coherence", f"""
WITH ta AS {_TA_SQL},
tw AS (SELECT lang AS topic, term, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) AS rank
       FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(tokens) AS term FROM ta) e GROUP BY lang, term) c QUALIFY rank <= 10),
dw AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(tokens) AS term FROM ta) e WHERE term IN (SELECT term FROM tw)),
d1 AS (SELECT term, count(*) AS d FROM dw GROUP BY term),
pairs AS (SELECT a.topic, a.term AS wi, b.term AS wj FROM tw a JOIN tw b ON a.topic = b.topic AND a.rank > b.rank),
co AS (SELECT p.topic, p.wi, p.wj, count(*) AS dij FROM pairs p JOIN dw x ON x.term = p.wi JOIN dw y ON y.term = p.wj AND y.doc_id = x.doc_id GROUP BY ALL)
SELECT p.topic, round(sum(ln((COALESCE(co.dij, 0) + 1) / d1.d)), 6) AS u_mass
FROM pairs p LEFT JOIN co USING (topic, wi, wj) LEFT JOIN d1 ON d1.term = p.wj GROUP BY p.topic""")
def u_mass_coherence(spark, sf_dir):
    """M3 (U_mass, exact): coherence of a fixed topic table (top-10 tokens per language) over Track A."""
    ta = corpus_by_lang(spark, sf_dir)
    return rounded(topics.umass(materialize(fixed_topics(ta)), ta, "doc_id", "tokens"))


@query("cv_coherence", f"""
WITH ta AS {_TA_SQL},
tw AS (SELECT lang AS topic, term FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(tokens) AS term FROM ta) e GROUP BY lang, term) c
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 10),
pos AS (SELECT * FROM (SELECT doc_id, len(tokens) AS len, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS p FROM ta) e WHERE term IN (SELECT term FROM tw)),
win AS MATERIALIZED (SELECT DISTINCT doc_id, term, s FROM (SELECT doc_id, term, unnest(range(greatest(p - 109, 0), least(p, greatest(len - 110, 0)) + 1)) AS s FROM pos) e),
tot AS (SELECT sum(greatest(len(tokens) - 109, 1))::DOUBLE AS n FROM ta),
one AS (SELECT term, count(*) AS c FROM win GROUP BY term),
two AS (SELECT a.term AS wi, b.term AS wj, count(*) AS c FROM win a JOIN win b USING (doc_id, s) GROUP BY ALL),
v AS (SELECT i.topic, i.term AS wi, j.term AS wj, CASE WHEN x.c > 0 AND y.c > 0 THEN
        ln((COALESCE(two.c, 0) / tot.n + 1e-12) / ((x.c / tot.n) * (y.c / tot.n))) / -ln(COALESCE(two.c, 0) / tot.n + 1e-12) ELSE 0 END AS v
      FROM tw i JOIN tw j ON i.topic = j.topic CROSS JOIN tot LEFT JOIN one x ON x.term = i.term LEFT JOIN one y ON y.term = j.term
      LEFT JOIN two ON two.wi = i.term AND two.wj = j.term),
s AS (SELECT topic, wj, sum(v) AS s FROM v GROUP BY ALL),
c AS (SELECT v.topic, wi, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS cosine FROM v JOIN s USING (topic, wj) GROUP BY ALL)
SELECT topic, round(avg(cosine), 6) AS c_v FROM c GROUP BY topic""")
def cv_coherence(spark, sf_dir):
    """M3 (C_v, exact): coherence of the fixed topic table over Track A from boolean windows of 110 tokens."""
    ta = corpus_by_lang(spark, sf_dir)
    return rounded(topics.cv(materialize(fixed_topics(ta)), ta, "doc_id", "tokens"))


# ---- features per training part -------------------------------------------

def word_table(spark, sf_dir):
    """(doc_id, u), the words of the Track B corpus without stop words, stored once for all folds, and its keys."""
    corpus = ot.tfidf_corpus(spread(bindings.table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    words = materialize(corpus.select("doc_id", tx.once("u", tx.remove_stops("tokens"))))
    return words, bindings.table(spark, sf_dir, "documents").filter(tx.has_light_token("text")).select("doc_id")


def quality_folds(spark, sf_dir):
    lab = bindings.labelled_documents(spark, sf_dir).select("doc_id", "quality")
    return materialize(sampling.stratified_folds(lab, "doc_id", "quality", 5, 42).select("doc_id", "quality", "fold"))


def _fold_vocabulary(spark, sf_dir):
    words, keys = word_table(spark, sf_dir)
    folds = quality_folds(spark, sf_dir)
    tc, voc = fd.fold_terms(words, "doc_id", tx.uni_bigrams("u"), fd.training_sizes(keys, "doc_id", folds, 5), folds, 5)
    return tc, folds, voc


_FOLD_SQL = f"""
WITH c AS (SELECT doc_id, tk FROM (SELECT doc_id, {LT('text')} AS tk FROM documents) x WHERE len(tk) > 0),
u AS (SELECT doc_id, list_filter(tk, lambda t: NOT list_contains({EN}, t)) AS u FROM c),
e AS (SELECT doc_id, unnest([w, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i)]) AS term FROM (SELECT doc_id, unnest(u) AS w, generate_subscripts(u, 1) AS i FROM u) z),
tc AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM e WHERE term IS NOT NULL GROUP BY ALL),
lab AS MATERIALIZED (SELECT doc_id, quality AS y, (row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS own FROM documents JOIN labels USING (doc_id)),
k AS (SELECT unnest(range(5)) AS fold),
n AS (SELECT fold, count(*) AS n_docs FROM k, c LEFT JOIN lab USING (doc_id) WHERE own IS DISTINCT FROM fold GROUP BY fold),
v AS MATERIALIZED (SELECT fold, term, df, ln((1 + n_docs) / (1 + df)::DOUBLE) + 1 AS idf FROM (
  SELECT fold, term, count(*) AS df, sum(tf) AS cf FROM k, tc LEFT JOIN lab USING (doc_id) WHERE own IS DISTINCT FROM fold GROUP BY ALL) d JOIN n USING (fold)
  WHERE df >= 10 AND df <= n_docs * 0.5 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY cf DESC, term) <= 500)"""


@query("fold_vocabulary", _FOLD_SQL + " SELECT CAST(fold AS INTEGER) AS fold, term, df, round(idf, 6) AS idf FROM v")
def fold_vocabulary(spark, sf_dir):
    """The TF-IDF vocabulary and IDF of each fold's training part, all from one pass over the corpus."""
    return rounded(_fold_vocabulary(spark, sf_dir)[2])


@query("fold_anova_terms", _FOLD_SQL + """,
w AS (SELECT fold, doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY fold, doc_id)) AS weight FROM tc JOIN v USING (term)),
cl AS (SELECT fold, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM k, lab WHERE own <> fold GROUP BY fold),
s AS (SELECT fold, term, sum(weight) FILTER (y = 0) AS s0, sum(weight) FILTER (y = 1) AS s1, sum(weight * weight) AS q FROM w JOIN lab USING (doc_id) WHERE own <> fold GROUP BY ALL),
t AS (SELECT v.fold, v.term, COALESCE(s0, 0) AS s0, COALESCE(s1, 0) AS s1, COALESCE(q, 0) AS q, n0, n1, n0 + n1 AS n FROM v JOIN cl USING (fold) LEFT JOIN s ON s.fold = v.fold AND s.term = v.term),
f AS (SELECT fold, term, n, n0 * power(s0 / n0 - (s0 + s1) / n, 2) + n1 * power(s1 / n1 - (s0 + s1) / n, 2) AS b, q - s0 * s0 / n0 - s1 * s1 / n1 AS w FROM t)
SELECT CAST(fold AS INTEGER) AS fold, term, round(CASE WHEN w > 0 THEN b / (w / (n - 2)) END, 6) AS f_stat,
  CAST(row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN w > 0 THEN b / (w / (n - 2)) END DESC NULLS LAST, term) AS INTEGER) AS rank FROM f QUALIFY rank <= 100""")
def fold_anova_terms(spark, sf_dir):
    """M11 per fold: the 100 terms of highest ANOVA F against quality over each fold's training documents."""
    tc, folds, voc = _fold_vocabulary(spark, sf_dir)
    w = materialize(fd.fold_weights(tc, "doc_id", "term", voc))
    return rounded(fd.fold_anova(w, "doc_id", "term", folds, folds, "quality").select("fold", "term", "f_stat", "rank"))
