"""Catalogue: cosine ranking (T15/T16) and label-run comparison (L1–L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import labelruns, vectors
from ledgerfold.plans.common import rounded
from ledgerfold.plans.registry import query
from ledgerfold.sources import bindings


@query("cosine_topk", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) z GROUP BY label, i),
c AS (SELECT label AS query_id, list(m ORDER BY i) AS c FROM u GROUP BY label),
s AS (SELECT query_id, vec_id AS id,
             list_dot_product(c, v) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(v, v))) AS cos
      FROM c CROSS JOIN e WHERE sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(v, v)) > 0)
SELECT query_id, id, round(cos, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM s) r WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    """The 5 vectors most similar to each class centroid (ties → smaller id)."""
    v = bindings.vectors(spark, sf_dir)
    q = vectors.centroids(v, "label", "vector")
    out = vectors.cosine_topk(q, "label", "centroid", v, "id", "vector", k=5)
    return rounded(out.select("query_id", "id", "cosine", F.col("rank").cast("int").alias("rank")))


@query("knn", """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query_id, id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.id AS query_id, e.id, list_distance(q.v, e.v) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, e.v), e.id) AS rank
  FROM e q JOIN e ON q.id <> e.id WHERE q.id % 20 = 0) r WHERE rank <= 5""")
def knn(spark, sf_dir):
    """The 5 nearest vectors, among all, of each vector whose id is a multiple of 20."""
    v = bindings.vectors(spark, sf_dir)
    return rounded(vectors.knn(v.filter(F.col("id") % 20 == 0), "id", "vector", 5, v))


RUNS = ["quality", "toxic", "length", "lang"]


def label_runs(spark, sf_dir):
    """Four labelling runs of the labelled documents (item = doc_id), labels P/N/0."""
    d = bindings.labelled_documents(spark, sf_dir)
    runs = {
        "quality": F.when(F.col("quality") == 1, "P").otherwise("N"),
        "toxic": F.when(F.col("toxic") == 1, "N").otherwise("P"),
        "length": F.when(F.col("n_chars") >= 2000, "P").when(F.col("n_chars") < 500, "N").otherwise("0"),
        "lang": F.when(F.col("lang") == "en", "P").when(F.col("lang") == "de", "N").otherwise("0"),
    }
    arr = F.array(*[F.struct(F.lit(r).alias("run"), e.alias("label")) for r, e in runs.items()])
    return d.select(F.col("doc_id").alias("item"), F.explode(arr).alias("x")).select("item", "x.run", "x.label")


_RUNS_SQL = """(SELECT item, run, label FROM (
  SELECT d.doc_id AS item,
    CASE WHEN quality = 1 THEN 'P' ELSE 'N' END AS quality,
    CASE WHEN toxic = 1 THEN 'N' ELSE 'P' END AS toxic,
    CASE WHEN n_chars >= 2000 THEN 'P' WHEN n_chars < 500 THEN 'N' ELSE '0' END AS length,
    CASE WHEN lang = 'en' THEN 'P' WHEN lang = 'de' THEN 'N' ELSE '0' END AS lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id) w
  UNPIVOT (label FOR run IN (quality, toxic, length, lang)))"""


@query("label_runs_pivot", f"""
SELECT item, max(label) FILTER (WHERE run = 'quality') AS quality, max(label) FILTER (WHERE run = 'toxic') AS toxic,
  max(label) FILTER (WHERE run = 'length') AS length, max(label) FILTER (WHERE run = 'lang') AS lang,
  count(DISTINCT label) > 1 AS changed
FROM {_RUNS_SQL} r GROUP BY item""")
def label_runs_pivot(spark, sf_dir):
    """L1: runs side by side per item, with a changed flag."""
    return labelruns.pivot_runs(label_runs(spark, sf_dir), RUNS)


@query("label_runs_agreement", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS run_a, '{b}' AS run_b, CAST(count(*) AS BIGINT) AS n_items, "
    f"CAST(count(*) FILTER (WHERE a.label = b.label) AS BIGINT) AS n_agree, "
    f"round(count(*) FILTER (WHERE a.label = b.label) * 1.0 / count(*), 6) AS agreement "
    f"FROM {_RUNS_SQL} a JOIN {_RUNS_SQL} b ON a.item = b.item AND a.run = '{a}' AND b.run = '{b}'"
    for i, a in enumerate(RUNS) for b in RUNS[i + 1:]) + ") x")
def label_runs_agreement(spark, sf_dir):
    """L2: pairwise agreement between runs."""
    wide = labelruns.pivot_runs(label_runs(spark, sf_dir), RUNS)
    return rounded(labelruns.pairwise_agreement(wide, RUNS))


@query("label_runs_counts", f"SELECT run, label, CAST(count(*) AS BIGINT) AS n FROM {_RUNS_SQL} r GROUP BY run, label")
def label_runs_counts(spark, sf_dir):
    """L2: label counts per run."""
    return labelruns.label_counts(label_runs(spark, sf_dir))


@query("label_runs_majority", f"""
SELECT item, arg_max(label, struct_pack(n := n, p := -CASE label WHEN 'N' THEN 0 WHEN '0' THEN 1 WHEN 'P' THEN 2 ELSE 9 END)) AS majority_label,
       max(n) AS votes
FROM (SELECT item, label, CAST(count(*) AS BIGINT) AS n FROM {_RUNS_SQL} r WHERE label IS NOT NULL GROUP BY item, label) c
GROUP BY item""")
def label_runs_majority(spark, sf_dir):
    """L3: majority label per item with the Negative-first tie-break."""
    return labelruns.majority(label_runs(spark, sf_dir))
