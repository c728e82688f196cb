"""Exact quantiles by distributed selection.

The value of a given rank is found by counting, not sorting: all values between
a lowest and a highest one are counted in BUCKETS buckets of equal width (a
monotone function of the value, so order is kept), the bucket that holds the
rank is taken, and its least and greatest value bound the next round, until
both are one value. Every round is one partial-aggregated pass over a narrow
stored table; the driver sees BUCKETS rows a wanted rank, never values of a
row set that grows, and no task holds all distinct values. Evenly spread
values need two or three rounds, one more for each further factor of
BUCKETS between the spread of the data and that round the wanted value.

NULL and NaN count as missing; infinities are counted apart. A quantile between
two ranks is interpolated linearly. No values give None.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import materialize

BUCKETS = 4096
INF = float("inf")


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    at = p * (n - 1)
    return math.floor(at), math.ceil(at), at


def select_ranks(df: DataFrame, wanted: dict[str, list[int]], bounds: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The values of the 0-based ranks ``wanted`` of each column among its finite values; ``bounds`` are their least and greatest."""
    columns = sorted(wanted)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").alias("x")) for i, c in enumerate(columns)]))
    long = df.select(cells.alias("v")).select("v.c", "v.x").filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < INF))
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, r): (*bounds[c], 0) for c in columns for r in wanted[c]}  # least, greatest value, rows before them
    while True:
        for at in [k for k, (lo, hi, _) in open_.items() if lo == hi]:
            found[at] = open_.pop(at)[0]
        if not open_:
            return found
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        of = df.sparkSession.createDataFrame([(i, columns.index(c), lo, hi) for i, (c, lo, hi) in enumerate(spans)], "s int, c int, lo double, hi double")
        inside = long.join(F.broadcast(of), "c").filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        part = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the width of all doubles overflows
        part = F.when(F.isnan(part), 0.0).otherwise(part)
        bucket = F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        counts = inside.groupBy("s", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: r["b"]):
            by.setdefault(r["s"], []).append(r)
        for (c, rank), (lo, hi, before) in list(open_.items()):
            for r in by[spans.index((c, lo, hi))]:
                if rank < before + r["n"]:
                    # a span too narrow to be cut any more holds two neighbouring doubles
                    if (r["lo"], r["hi"]) == (lo, hi) and math.nextafter(lo, INF) == hi:
                        low = df.filter(F.col(f"`{c}`") == lo).count()
                        open_[c, rank] = (lo, lo, before) if rank < before + low else (hi, hi, before + low)
                    else:
                        open_[c, rank] = (r["lo"], r["hi"], before)
                    break
                before += r["n"]


def quantiles(df: DataFrame, columns: list[str], probs: list[float], stored: bool = False) -> dict[str, list[float | None]]:
    """Exact ``probs`` quantiles of the numeric ``columns``: a few numbers per column, on the driver. ``stored`` says that
    ``df`` is a stored table already, which the rounds can read."""
    narrow = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    narrow = narrow if stored else materialize(narrow)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)
        aggs += [F.count_if(fine).alias(f"n{i}"), F.min(F.when(fine, x)).alias(f"lo{i}"), F.max(F.when(fine, x)).alias(f"hi{i}"),
                 F.count_if(x == -INF).alias(f"below{i}"), F.count_if(x == INF).alias(f"above{i}")]
    r = narrow.agg(*aggs).first()
    wanted, bounds = {}, {}
    for i, c in enumerate(columns):
        n, below, above = r[f"n{i}"], r[f"below{i}"], r[f"above{i}"]
        if n:
            ranks = {k for p in probs for k in _ranks(n + below + above, p)[:2]}
            inside = sorted(k - below for k in ranks if below <= k < below + n)
            if inside:
                wanted[c], bounds[c] = inside, (r[f"lo{i}"], r[f"hi{i}"])
    values = select_ranks(narrow, wanted, bounds) if wanted else {}
    out = {}
    for i, c in enumerate(columns):
        n, below, above = r[f"n{i}"], r[f"below{i}"], r[f"above{i}"]

        def value(k, c=c, n=n, below=below):
            return -INF if k < below else INF if k >= below + n else values[c, k - below]

        out[c] = []
        for p in probs:
            total = n + below + above
            if not total:
                out[c].append(None)
                continue
            lo, hi, at = _ranks(total, p)
            a, b = value(lo), value(hi)
            out[c].append(a if a == b else (hi - at) * a + (at - lo) * b)
    return out


def median(df: DataFrame, column: str, stored: bool = False) -> float | None:
    return quantiles(df, [column], [0.5], stored)[column][0]
