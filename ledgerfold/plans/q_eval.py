"""Catalogue: splits, folds, weights and evaluation from a score column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import evaluate as ev
from ledgerfold.operators import sampling
from ledgerfold.plans.common import rounded
from ledgerfold.plans.registry import query
from ledgerfold.sources import bindings

TARGETS = ["quality", "toxic"]


def length_score():
    """Deterministic score of a labelled document: floor(100·n/(n+2000))/100 (ties on purpose)."""
    return F.floor(F.col("n_chars").cast("double") * 100 / (F.col("n_chars") + 2000)) / 100


def scored(spark, sf_dir):
    """(doc_id, target, y, score, alt_score) for both targets of every labelled document."""
    d = bindings.labelled_documents(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in TARGETS])
    s = d.select("doc_id", "n_chars", F.explode(arr).alias("x")).select("doc_id", "n_chars", "x.target", "x.y")
    return s.withColumn("score", length_score()).withColumn("alt_score", 1 - F.col("score"))


S = """(SELECT d.doc_id, t.target, CASE t.target WHEN 'quality' THEN l.quality ELSE l.toxic END AS y,
  floor(CAST(d.n_chars AS DOUBLE) * 100 / (d.n_chars + 2000)) / 100 AS score,
  1 - floor(CAST(d.n_chars AS DOUBLE) * 100 / (d.n_chars + 2000)) / 100 AS alt_score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (VALUES ('quality'), ('toxic')) t(target))"""


def _curve_sql(score="score", extra_group=""):
    g = "target" + extra_group
    return f"""(SELECT *, sum(pos) OVER (PARTITION BY {g} ORDER BY score DESC) AS tp,
      sum(neg) OVER (PARTITION BY {g} ORDER BY score DESC) AS fp,
      sum(pos) OVER (PARTITION BY {g}) AS P, sum(neg) OVER (PARTITION BY {g}) AS N
    FROM (SELECT {g}, {score} AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
          FROM SRC GROUP BY ALL) c)"""


def _prf_sql(c):
    return f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                    CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall FROM {c} c2) c3)"""


@query("stratified_split", f"""
SELECT doc_id, y AS quality, rn <= ceil(n * 0.2) AS is_test FROM (
  SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
         count(*) OVER (PARTITION BY y) AS n FROM {S} s WHERE target = 'quality') r""")
def stratified_split(spark, sf_dir):
    """Stratified 80/20 split on the quality label, deterministic order (seed 42)."""
    d = scored(spark, sf_dir).filter(F.col("target") == "quality").select("doc_id", F.col("y").alias("quality"))
    return sampling.stratified_split(d, "doc_id", "quality", 0.2, 42)


@query("stratified_folds", f"""
SELECT doc_id, target, y, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM (
  SELECT doc_id, target, y, row_number() OVER (PARTITION BY target, y ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
  FROM {S} s) r""")
def stratified_folds(spark, sf_dir):
    """Stratified 5-fold assignment per target."""
    d = scored(spark, sf_dir).withColumn("_g", F.concat_ws(":", "target", F.col("y").cast("string")))
    return sampling.stratified_folds(d, "doc_id", "_g", 5, 42).select("doc_id", "target", "y", "fold")


@query("class_weights", f"""
SELECT target, y AS label, n, round(t * 1.0 / (k * n), 6) AS weight FROM (
  SELECT target, y, CAST(count(*) AS BIGINT) AS n, sum(count(*)) OVER (PARTITION BY target) AS t,
         count(*) OVER (PARTITION BY target) AS k FROM {S} s GROUP BY target, y) c""")
def class_weights(spark, sf_dir):
    """Balanced class weights n/(2·n_c) per target."""
    d = scored(spark, sf_dir)
    parts = [sampling.class_weights(d.filter(F.col("target") == t), "y").select(
        F.lit(t).alias("target"), F.col("y").alias("label"), "n", "weight") for t in TARGETS]
    return rounded(parts[0].unionByName(parts[1]))


def _curve(spark, sf_dir, score="score"):
    return ev.curve(scored(spark, sf_dir).withColumn("s", F.col(score)), ["target"], "y", "s")


@query("f1_threshold", f"""
SELECT target, round(arg_max(score, struct_pack(f := f1, s := -score)), 6) AS best_threshold, round(max(f1), 6) AS best_f1,
  round(arg_max(precision, struct_pack(f := f1, s := -score)), 6) AS precision, round(arg_max(recall, struct_pack(f := f1, s := -score)), 6) AS recall
FROM {_prf_sql(_curve_sql().replace('SRC', S))} f GROUP BY target""")
def f1_threshold(spark, sf_dir):
    """F1-optimal threshold over the PR curve (lowest threshold on ties)."""
    return rounded(ev.f1_threshold(_curve(spark, sf_dir), ["target"]))


@query("roc_points", f"""
SELECT target, score AS threshold, round(CASE WHEN N > 0 THEN fp / N END, 6) AS fpr, round(CASE WHEN P > 0 THEN tp / P END, 6) AS tpr
FROM {_curve_sql().replace('SRC', S)} c""")
def roc_points(spark, sf_dir):
    """ROC points at every distinct score."""
    return rounded(ev.roc_points(_curve(spark, sf_dir), ["target"]))


@query("roc_auc_rank", f"""
SELECT target, round(CASE WHEN max(P) * max(N) > 0 THEN sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) END, 6) AS auc
FROM {_curve_sql().replace('SRC', S)} c GROUP BY target""")
def roc_auc_rank(spark, sf_dir):
    """ROC AUC with ties counted half."""
    return rounded(ev.roc_auc(_curve(spark, sf_dir), ["target"]))


@query("average_precision", f"""
SELECT target, round(sum(CASE WHEN P > 0 THEN pos / P * (tp / (tp + fp)) END), 6) AS average_precision
FROM {_curve_sql().replace('SRC', S)} c GROUP BY target""")
def average_precision(spark, sf_dir):
    """Average precision (step rule)."""
    return rounded(ev.average_precision(_curve(spark, sf_dir), ["target"]))


_CONF_SQL = """SELECT {g}, CAST(count(*) FILTER (WHERE y <> 1 AND NOT score >= 0.5) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE y <> 1 AND score >= 0.5) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE y = 1 AND NOT score >= 0.5) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS BIGINT) AS tp FROM {src} s GROUP BY {g}"""


def _conf_metrics_sql(inner):
    return f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM
      (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM ({inner}) a) b)"""


@query("confusion_metrics", f"""
SELECT target, tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM {_conf_metrics_sql(_CONF_SQL.format(g='target', src=S))} m""")
def confusion_metrics(spark, sf_dir):
    """Confusion matrix and precision/recall/F1 at threshold 0.5."""
    return rounded(ev.confusion(scored(spark, sf_dir), ["target"], "y", "score", 0.5))


_FOLDED = f"""(SELECT *, CAST((row_number() OVER (PARTITION BY target, y ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold
  FROM {S} s0)"""


@query("cv_summary", f"""
WITH m AS (SELECT * FROM {_conf_metrics_sql(_CONF_SQL.format(g='target, fold', src=_FOLDED))} x),
a AS (SELECT target, fold, CASE WHEN max(P) * max(N) > 0 THEN sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) END AS auc
      FROM {_curve_sql(extra_group=', fold').replace('SRC', _FOLDED)} c GROUP BY target, fold)
SELECT target, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg(auc), 6) AS auc_mean,
  round(stddev_pop(auc), 6) AS auc_std, round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean,
  CAST(count(*) AS BIGINT) AS n_folds
FROM m JOIN a USING (target, fold) GROUP BY target""")
def cv_summary(spark, sf_dir):
    """A23 over M14 folds: per-fold F1 (0.5) and AUC of the score, mean ± population std."""
    d = scored(spark, sf_dir).withColumn("_g", F.concat_ws(":", "target", F.col("y").cast("string")))
    f = sampling.stratified_folds(d, "doc_id", "_g", 5, 42)
    conf = ev.confusion(f, ["target", "fold"], "y", "score", 0.5)
    auc = ev.roc_auc(ev.curve(f, ["target", "fold"], "y", "score"), ["target", "fold"])
    return rounded(ev.cv_summary(conf.join(auc, ["target", "fold"]), ["target"]))


@query("best_model_per_target", f"""
WITH r AS (
  SELECT target, 'length' AS algorithm, max(f1) AS f1 FROM {_prf_sql(_curve_sql('score').replace('SRC', S))} a GROUP BY target
  UNION ALL
  SELECT target, 'short' AS algorithm, max(f1) AS f1 FROM {_prf_sql(_curve_sql('alt_score').replace('SRC', S))} b GROUP BY target)
SELECT target, algorithm, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY f1 DESC NULLS LAST, algorithm) AS rn FROM r) x WHERE rn = 1""")
def best_model_per_target(spark, sf_dir):
    """Best scorer per target by tuned F1 (two deterministic scorers compete)."""
    res = None
    for alg, col in (("length", "score"), ("short", "alt_score")):
        r = ev.f1_threshold(_curve(spark, sf_dir, col), ["target"]).select(
            "target", F.lit(alg).alias("algorithm"), F.col("best_f1").alias("f1"))
        res = r if res is None else res.unionByName(r)
    return rounded(ev.best_per_group(res, ["target"], "f1", "algorithm"))
