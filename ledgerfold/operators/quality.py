"""Profiles and quality aggregates.

Each is a single aggregate pass (or two where a statistic feeds a second
pass, joined as a one-row broadcast). Results are small: one row per
metric, bin or category – never per input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.operators.filters import top_n_values
from ledgerfold.operators.quantiles import median, quantiles
from ledgerfold.session import materialize


def _stack(pairs: list[tuple[str, Column]], key: str, value: str) -> Column:
    """Unpivot helper: array of (key, value) structs to explode."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias(key), v.alias(value)) for k, v in pairs]))


def class_balance(df: DataFrame, targets: list[str]) -> DataFrame:
    """Per target and class: n and percent of the non-null rows."""
    long = df.select(_stack([(t, F.col(t).cast("int")) for t in targets], "target", "label").alias("x")) \
             .select("x.target", "x.label").filter(F.col("label").isNotNull())
    counts = long.groupBy("target", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("target")  # over ≤ 2 classes per target: tiny
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(w))


def null_profile(df: DataFrame, columns: list[str], all_null_groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Per column NULL count and percent; plus rows where a whole group is NULL."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"n__{c}") for c in columns]
    for g, cols in (all_null_groups or {}).items():
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).isNull()
        aggs.append(F.count_if(cond).alias(f"n__{g}"))
    names = list(columns) + list(all_null_groups or {})
    wide = df.agg(*aggs)
    return (wide.select("__n", _stack([(c, F.col(f"n__{c}")) for c in names], "column", "n_null").alias("x"))
                .select("x.column", "x.n_null", (F.col("x.n_null") * 100.0 / F.col("__n")).alias("pct_null")))


def per_key_counts_profile(df: DataFrame, key: str = "piid") -> DataFrame:
    """Number of keys, median and max rows per key (two-level aggregate)."""
    per = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("k")))
    return per.agg(F.count(F.lit(1)).alias("n_contracts"),
                   F.lit(median(per, "k", True)).cast("double").alias("median_mods"),
                   F.max("k").alias("max_mods"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count,min,p25,median,p75,max,mean,std (sample), zero count per column.

    One aggregate pass for all columns, unpivoted after; exact quartiles by distributed selection.
    """
    df = materialize(df.select(*columns))
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75], True)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.min(x).alias(f"mn{i}"),
                 F.lit(quartiles[c]).cast("array<double>").alias(f"q{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.count_if(x == 0).alias(f"z{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"c{i}").alias("count"), F.col(f"mn{i}").alias("min"),
                     F.col(f"q{i}")[0].alias("p25"), F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"),
                     F.col(f"mx{i}").alias("max"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                     F.col(f"z{i}").alias("n_zero"))
            for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rate_by(df: DataFrame, group: str | list[str], targets: list[str], min_support: int | None = None) -> DataFrame:
    """Positive rate per category (mean of 0/1 labels) with support n."""
    g = [group] if isinstance(group, str) else list(group)
    out = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(f"{t}_rate") for t in targets])
    if min_support is not None:
        out = out.filter(F.col("n") >= min_support)
    return out


def share_zero_on_time(df: DataFrame, growth: str, delay: str) -> DataFrame:
    """Counts and shares at zero growth and without delay, of the rows where each is known (NULL share if none is)."""
    out = df.agg(F.count(growth).alias("n_growth"), F.count_if(F.col(growth) == 0).alias("n_zero_growth"),
                 F.count(delay).alias("n_delay"), F.count_if(F.col(delay) <= 0).alias("n_on_time"))
    return out.withColumns({"share_zero_growth": F.try_divide("n_zero_growth", "n_growth"), "share_on_time": F.try_divide("n_on_time", "n_delay")})


def rate_in_top(df: DataFrame, group: str, targets: list[str], n_top: int) -> DataFrame:
    """Rates within the top-N categories by volume (N-row broadcast semi join)."""
    top = F.broadcast(top_n_values(df, group, n_top).select(group))
    return rate_by(df.join(top, group, "left_semi"), group, targets)


def histogram(df: DataFrame, col: str, n_bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width bins; upper edge belongs to the last bin; edges from data when not given.

    bin = least(floor((x-lo)*n/(hi-lo)) + 1, n); values outside [lo, hi] are skipped.
    """
    x = F.col(col).cast("double")
    base = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    lo_c = base.agg(F.min("x")).scalar() if lo is None else F.lit(float(lo))
    hi_c = base.agg(F.max("x")).scalar() if hi is None else F.lit(float(hi))
    j = base.withColumn("lo", lo_c).withColumn("hi", hi_c).filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) * n_bins / width) + 1, F.lit(n_bins)))
    return (j.withColumn("bin", b.cast("int"))
             .groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
             .select("bin", (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / n_bins).alias("bin_lo"),
                     (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / n_bins).alias("bin_hi"), "n"))


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme data inside the fences), outlier count."""
    x = F.col(col).cast("double")
    base = materialize(df.select(x.alias("x")).filter(F.col("x").isNotNull()))
    q = [F.lit(v).cast("double") for v in quantiles(base, ["x"], [0.25, 0.5, 0.75], True)["x"]]
    j = base.withColumn("q1", q[0]).withColumn("median", q[1]).withColumn("q3", q[2])
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy("q1", "median", "q3").agg(
        F.min(F.when(F.col("x") >= lo_f, F.col("x"))).alias("whisker_low"),
        F.max(F.when(F.col("x") <= hi_f, F.col("x"))).alias("whisker_high"),
        F.count_if((F.col("x") < lo_f) | (F.col("x") > hi_f)).alias("n_outliers")
    ).withColumn("iqr", F.col("q3") - F.col("q1"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r for every pair (strict lower triangle), pairwise-complete rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    st = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("r"))
                             for a, b in pairs]))
    return wide.select(st.alias("p")).select("p.x", "p.y", "p.r")


def correlation_ranked(df: DataFrame, features: list[str], outcomes: list[str]) -> DataFrame:
    """Correlation of each feature with each outcome, ranked by |r| (ties by name)."""
    wide = df.agg(*[F.corr(F.col(f).cast("double"), F.col(o).cast("double")).alias(f"{o}__{f}")
                    for o in outcomes for f in features])
    st = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(f).alias("feature"),
                                      F.col(f"{o}__{f}").alias("r")) for o in outcomes for f in features]))
    long = wide.select(st.alias("p")).select("p.outcome", "p.feature", "p.r")
    w = Window.partitionBy("outcome").orderBy(F.desc_nulls_last(F.abs("r")), "feature")
    return long.withColumn("rank", F.row_number().over(w))


def text_quality(df: DataFrame, col: str) -> DataFrame:
    """Non-null count, mean/median length, short/long counts and buckets."""
    n = F.length(F.col(col))
    L = F.coalesce(n, F.lit(0))
    half = median(df.select(L.alias("length")), "length")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.col(col)).alias("n_non_null"),
        F.avg(L).alias("mean_length"), F.lit(half).cast("double").alias("median_length"),
        F.count_if(L < 50).alias("n_lt_50"), F.count_if(L < 100).alias("n_lt_100"),
        F.count_if(L > 500).alias("n_gt_500"),
        F.count_if((L >= 50) & (L < 100)).alias("n_50_99"), F.count_if(L >= 100).alias("n_ge_100"),
        (F.count_if(L >= 100) * 100.0 / F.count(F.lit(1))).alias("pct_track_a"))


def top_k(df: DataFrame, col: str, k: int, key: str) -> DataFrame:
    """K rows with the largest non-null ``col`` (ties by ``key``): TakeOrderedAndProject."""
    return df.filter(F.col(col).isNotNull()).orderBy(F.desc(col), F.asc(key)).limit(k)


def examples(df: DataFrame, col: str, key: str, k: int = 5, max_len: int | None = None,
             short_below: int | None = None, long_above: int | None = None) -> DataFrame:
    """First k short/long example texts (by key), optionally cut to max_len chars."""
    L = F.length(F.col(col))
    cond = F.lit(True)
    if short_below is not None:
        cond = cond & (L < short_below)
    if long_above is not None:
        cond = cond & (L > long_above)
    out = df.filter(cond).orderBy(key).limit(k)
    if max_len is not None:
        out = out.withColumn(col, F.substring(F.col(col), 1, max_len))
    return out


def retention_by_group(df: DataFrame, group: Column | str, keep: Column) -> DataFrame:
    """Rows in / kept per shard (or any group), percent and running totals.

    The running window runs over the per-shard summary (one row per shard).
    """
    g = F.col(group) if isinstance(group, str) else group
    per = df.groupBy(g.alias("shard")).agg(F.count(F.lit(1)).alias("rows_in"),
                                           F.count_if(keep).alias("rows_kept"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return (per.withColumn("pct_kept", F.col("rows_kept") * 100.0 / F.col("rows_in"))
               .withColumn("cum_in", F.sum("rows_in").over(w))
               .withColumn("cum_kept", F.sum("rows_kept").over(w)))


def guard_rails(checks: list[tuple[str, Column, float, str]], df: DataFrame) -> DataFrame:
    """evaluate (name, value expr, threshold, op) checks in one aggregate pass.

    ``op`` is '<' or '>'; triggered = value op threshold.
    """
    wide = df.agg(*[v.alias(f"v__{name}") for name, v, _, _ in checks])
    rows = []
    for name, _, thr, op in checks:
        v = F.col(f"v__{name}").cast("double")
        trig = (v < F.lit(thr)) if op == "<" else (v > F.lit(thr))
        rows.append(F.struct(F.lit(name).alias("check"), v.alias("value"), F.lit(float(thr)).alias("threshold"),
                             F.coalesce(trig, F.lit(False)).alias("triggered")))
    return wide.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
