"""Sinks and checkpoints.

Paths are folders on the shared file system the cluster uses (the same
place ``spark.checkpoint.dir`` points to), never a machine-local temp dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def checkpoint_or_resume(spark: SparkSession, path: str, build, resume: bool = True) -> DataFrame:
    """Read ``path`` when it exists (resume / fast path), else build, write and read back."""
    if resume and _exists(spark, path):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def require(spark: SparkSession, path: str, hint: str) -> DataFrame:
    """Fast path that fails with a hint when the processed table is missing."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} not found – {hint}")
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, csv: bool = True) -> None:
    """Parquet (and a CSV twin with header) of a result table."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if csv:
        flat = df.select([F.col(c).cast("string") if t.startswith(("array", "struct", "map")) else F.col(c)
                          for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def save_tfidf(weights: DataFrame, path: str, key: str = "doc_id") -> None:
    """TF-IDF rows (long form, partitioned by nothing) + vocabulary (idx, term) + row keys. The vocabulary is
    ``max_features`` terms."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    terms = weights.groupBy("term").agg(F.lit(1).alias("one")).agg(F.array_sort(F.collect_list("term")).alias("t"))
    terms.select(F.posexplode("t").alias("idx", "term")).write.mode("overwrite").parquet(f"{path}/vocabulary")
    weights.select(key).distinct().write.mode("overwrite").parquet(f"{path}/keys")


def save_doc_topics(shares: DataFrame, path: str, key: str = "doc_id", topics: str = "topics", k: int = 12) -> None:
    """One column per topic (topic_0 ..) and the key, as Parquet."""
    shares.select(*[F.col(topics)[i].alias(f"topic_{i}") for i in range(k)], key).write.mode("overwrite").parquet(path)


def save_model(model, path: str, meta: dict) -> None:
    """Spark ML persistence plus a one-row metadata table (config, target, feature names)."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([{k: str(v) for k, v in meta.items()}]).write.mode("overwrite").json(f"{path}/meta")


def write_summary(summary: DataFrame, path: str) -> None:
    """The (section, metric, value) report as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(path)
