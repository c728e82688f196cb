"""Splits, folds and class weights (M13, M14, M18) plus exact ranks within groups.

A class can hold most of the rows, so ranks inside a class are never taken
with a window partitioned by the class (that puts the whole class in one
task). Instead rows are range-partitioned by (group, order) and sorted; each
row's rank is its offset inside its partition plus the row count of the
group in earlier partitions – a (groups × partitions)-row table that is
broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import materialize


def hash_order(key, seed: int = 42) -> Column:
    """Deterministic pseudo-random order of keys (md5 of 'seed:key')."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def group_rank(df: DataFrame, group: str, order: Column, n_parts: int | None = None) -> DataFrame:
    """Add ``rank`` = exact 1-based row number inside ``group`` by ``order`` (unique order assumed)."""
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.withColumn("_o", order).repartitionByRange(n, group, "_o").sortWithinPartitions(group, "_o")
           .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s)  # ids must be identical for both consumers below
    stats = s.groupBy(group, "_pid").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    # ≤ groups × partitions rows; a NULL group is a group
    stats = stats.select(F.col(group).alias("__group"), F.col("_pid").alias("__part"), "_m0", "_off")
    out = s.join(F.broadcast(stats), s[group].eqNullSafe(F.col("__group")) & (s["_pid"] == F.col("__part"))).drop("__group", "__part")
    return out.withColumn("rank", F.col("_off") + F.col("_mid") - F.col("_m0") + 1).drop("_o", "_pid", "_mid", "_m0", "_off")


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Per class, the first ceil(fraction·n_class) keys in hash order are test rows."""
    r = group_rank(df, label, F.struct(hash_order(key, seed), F.col(key)))
    sizes = df.groupBy(F.col(label).alias("__group")).agg(F.count(F.lit(1)).alias("_n"))  # one row per class, NULL among them
    return (r.join(F.broadcast(sizes), r[label].eqNullSafe(F.col("__group"))).drop("__group")
             .withColumn("is_test", F.col("rank") <= F.ceil(F.col("_n") * test_fraction))
             .drop("_n", "rank"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = (rank within class − 1) mod k over a shuffled order; class sizes per fold differ ≤ 1."""
    r = group_rank(df, label, F.struct(hash_order(key, seed), F.col(key)))
    return r.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (n_classes · n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    n_classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (n_classes * F.col("n")))


def with_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced class weight to every row (class table broadcast: one row per class)."""
    w = class_weights(df, label).select(F.col(label).alias("__group"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), df[label].eqNullSafe(F.col("__group"))).drop("__group")
