"""Comparison of several labelling runs of the same items (L1–L3).

Input: long table (item, run, label). Runs are a small, known set (the
pivot values), so the pivot yields one row per item and all pairwise
agreement rates come out of ONE aggregate over that row set – no self-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tie-break priority of the majority rule (Negative first, then Neutral).
LABEL_PRIORITY = {"N": 0, "0": 1, "P": 2}


def pivot_runs(runs: DataFrame, run_names: list[str], item: str = "item") -> DataFrame:
    """L1: item, one label column per run, and ``changed`` when the runs disagree."""
    wide = runs.groupBy(item).pivot("run", run_names).agg(F.max("label"))
    labels = F.array(*[F.col(f"`{r}`") for r in run_names])
    return wide.withColumn("changed", F.size(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))) > 1)


def pairwise_agreement(wide: DataFrame, run_names: list[str]) -> DataFrame:
    """L2: for each run pair: items labelled by both, agreements and rate."""
    pairs = [(a, b) for i, a in enumerate(run_names) for b in run_names[i + 1:]]
    aggs = []
    for a, b in pairs:
        both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        aggs += [F.count_if(both).alias(f"n__{a}__{b}"),
                 F.count_if(both & (F.col(f"`{a}`") == F.col(f"`{b}`"))).alias(f"a__{a}__{b}")]
    one = wide.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), F.col(f"n__{a}__{b}").alias("n_items"),
                     F.col(f"a__{a}__{b}").alias("n_agree")) for a, b in pairs]
    return (one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
               .withColumn("agreement", F.col("n_agree") / F.col("n_items")))


def label_counts(runs: DataFrame) -> DataFrame:
    """L2: label counts per run."""
    return runs.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))


def majority(runs: DataFrame, item: str = "item") -> DataFrame:
    """L3: most frequent label per item; ties → Negative, then Neutral, then Positive."""
    prio = F.create_map(*[x for kv in LABEL_PRIORITY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    counts = runs.filter(F.col("label").isNotNull()).groupBy(item, "label").agg(F.count(F.lit(1)).alias("n"))
    score = F.struct(F.col("n"), (-F.coalesce(prio[F.col("label")], F.lit(9))).alias("p"))
    return counts.groupBy(item).agg(F.max_by("label", score).alias("majority_label"),
                                    F.max("n").alias("votes"))
