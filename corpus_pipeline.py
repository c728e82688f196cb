"""From raw documents to encoded training text, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``. It works on all rows that
the stage before it kept and its decisions take effect: the classifier's
rejects, the copies, all but one document of each near-duplicate group, and the
documents that hold benchmark items go. All but the last return the columns of
documents. ``run`` writes each stage's rows and reads them again.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from ledgerfold.llm import bpe, decontaminate, exact_dedup, near_dup, quality_crf  # noqa: E402
from ledgerfold.llm.common import docs_view, written  # noqa: E402
from ledgerfold.llm.queries import RANKS  # noqa: E402
from ledgerfold.sources.tables import table  # noqa: E402

#: A document with a score of at least this stays.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model, out_col="__score").filter(F.col("__score") >= LEAST_QUALITY).select(docs.columns)


def row_key(doc_id: str, *rest: F.Column) -> F.Column:
    """A row's identity as one join key; a null id is an id like others."""
    return F.struct(F.coalesce(doc_id, F.lit(0)), F.col(doc_id).isNull(), *rest)


def only(docs: DataFrame, own: F.Column, keep: DataFrame, theirs: F.Column) -> DataFrame:
    """The rows of ``docs`` whose key ``own`` is a key ``theirs`` of ``keep``."""
    return docs.withColumn("__key", own).join(keep.select(theirs.alias("__key")), "__key", "left_semi").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts; the documents with an odd hash are the snapshot."""
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    out = exact_dedup.dedup(docs.filter(~odd), docs.filter(odd))
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(exact_dedup.normalised(text).cast("binary"), 256)
    return only(docs, row_key("doc_id", sha, F.length(text).cast("long")), out.filter("kept"), row_key("doc_id", F.col("text_sha256"), F.col("n_cp")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    out = near_dup.near_duplicates(docs).filter("kept")
    return only(docs, row_key("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))), out, row_key("doc_id", F.col("tie")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    out = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), out_col="__matches")
    return out.filter(F.size("__matches") == 0).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of the ids and of the bytes that they decode to."""
    d = bpe.encode(docs_view(docs), RANKS, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(d, RANKS).select("doc_id", "ids", *bpe.digest_columns())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dup", near), ("decontaminate", decontaminated), ("bpe", encoded)]

#: A fitted classifier isn't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
