"""Importance resampling of documents towards the texts of a target set.

Words come from bytes: one 256-byte table lower-cases A-Z and blanks every
ASCII byte that is no letter or digit, ``bytes.split`` yields the words, and the
crc32 of a word is the seed that the next word's bytes extend to the crc32 of
the pair, so no joined string is ever made. A feature's bucket is its crc32
modulo BUCKETS. A task reduces its documents to one Counter, so at most BUCKETS
rows a task are shuffled. The gains (one integer a bucket) go back to the tasks;
a second pass over the texts takes the floored mean of the gains of a
document's features and adds its Gumbel draw, which a hash of the id fixes.

The draw is exact and needs no sort of all rows: a histogram of the scores
gives the lowest score that is drawn, and only rows from there on are dealt by
range, sorted, and numbered by position plus the rows of earlier ranges. The
histogram has a row for each integer between the lowest and highest score; both
lie within about 1000 * ln(2 ** 64) of 0 for any input.

Defined results: a null text has no words; no features give the weight 0; only
documents of LEAST_WORDS words or more are counted and drawn; ties go to the
smaller doc_id, a null id last (its hash is that of an empty id), and rows that
repeat an id are documents of their own, in the order of their texts' hashes.
Without target texts every gain follows from the smoothing alone. An empty
table gives an empty one. Other columns are ignored. A very long text is taken
in pieces that are cut at blanks, with the words that a feature spans carried over.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import docs_view, map_rows, slices, written

BUCKETS, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 2, 7, 25, 20
PIECE = 1 << 20
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(data: bytes, most: int | None = None) -> Iterator[bytes]:
    """``data`` in parts of about ``most`` bytes that end before a blank."""
    most, at = most or PIECE, 0
    while len(data) - at > most:
        cut = data.find(b" ", at + most)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def features(text: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them) for each piece of the text."""
    before: list[bytes] = []
    for piece in pieces(text.translate(TABLE)):
        new = piece.split()
        words, old = before + new, len(before)
        seeds, found = list(map(crc32, words)), []
        for n in range(1, longest + 1):
            if n > 1:  # the feature of n - 1 words, a blank and the next word
                seeds = list(map(crc32, words[n - 1:], map(crc32, repeat(b" "), seeds)))
            known = max(0, old - n + 1)  # those that end in a word of the piece before
            found.append(np.fromiter(seeds, dtype=np.uint32, count=len(seeds))[known:])
        before = words[max(0, len(words) - longest + 1):] if longest > 1 else []
        yield len(new), np.concatenate(found) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all ``texts`` fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    for _, found in features(text, longest, buckets):
                        counts.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])

    t = texts.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").cast("binary").alias("text"))
    return t.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain: floor(1000 ln) of its smoothed share in the target over that in the raw texts."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log(float(target.get(b, 0) + 1) * s / (float(raw.get(b, 0) + 1) * t))) for b in range(buckets)], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, of: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight, score) for each row of ``docs`` (doc_id, text); ``of`` are the gains."""

    def make():
        def step(cols: dict) -> dict:
            out = {"doc_id": cols["doc_id"], "tie": cols["tie"], "n_words": [], "n_features": [], "weight": [], "score": []}
            for i, text in zip(cols["doc_id"], cols["text"], strict=True):
                words = n = total = 0
                for new, found in features(text, longest, len(of)):
                    words, n, total = words + new, n + len(found), total + int(of[found].sum())
                weight = total // n if n else 0
                for name, value in (("n_words", words), ("n_features", n), ("weight", weight), ("score", weight + gumbel(i, seed))):
                    out[name].append(value)
            return out
        return step

    d = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    return map_rows(d, make, "doc_id long, tie long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (a written table) with the column rank: 1, 2, ... of the drawn rows, null of the others."""
    able = F.col("n_words") >= least_words
    histogram = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()  # as wide as the scores' range
    draw = percent * sum(r["n"] for r in histogram) // 100
    cut, seen = None, 0
    for r in histogram:
        if seen >= draw:
            break
        cut, seen = r["score"], seen + r["n"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    high = able & (F.col("score") >= cut)
    dealt = scored.filter(high).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "ranked")  # range number << 33 | position
    sizes = dealt.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # a row per range
    starts, total = [], 0
    for r in sizes:
        starts.append((r["range"], total))
        total += r["n"]
    start = scored.sparkSession.createDataFrame(starts, "range long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    top = dealt.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(start), "range").select(
        *scored.columns, F.when(rank <= draw, rank).alias("rank"))
    return top.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, tie (xxhash64 of the text), n_words, n_features, weight, score, rank."""
    d = docs_view(docs, id_col, text_col)
    raw = {r["bucket"]: r["n"] for r in bucket_counts(d, "text", longest, buckets).collect()}  # BUCKETS rows at most
    want = {r["bucket"]: r["n"] for r in bucket_counts(target, target_col, longest, buckets).collect()}
    return ranked(written(weigh(d, gains(raw, want, buckets), longest, seed), "scored"), percent, least_words)


def drawn(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``result`` (of :func:`resample`) drew, with all their columns."""
    t = result.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__i"), F.col("tie").alias("__t")).distinct()
    own = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(t, docs[id_col].cast("long").eqNullSafe(t["__i"]) & (own == t["__t"]), "left_semi")
