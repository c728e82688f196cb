"""Exact dedup with static filters per immutable snapshot.

A snapshot is a sealed set of distinct text digests, dealt into buckets by the
digest's leading bits; every bucket has one static binary-fuse filter (8-bit
fingerprints, three probes, about 9 bits a key). ``seal`` writes it once, from
its own rows alone. A new batch is grouped by digest on its own first, its
distinct digests are screened bucket by bucket against each snapshot's filters,
and only the positives join the snapshot's exact buckets, where the normalised
bytes of both sides' texts are compared (no other text is read again). Negatives
never meet the snapshot: their batch group is final. Equal digests with
unequal bytes stay apart by side.

Defined results: a null text is empty, and empty (or blank) texts are equal to
one another; a null doc_id counts as the largest id; rows that repeat the
doc_id and text of the row that stays are that same document and are all kept;
an empty table or snapshot gives an empty result or no positives; other columns
are ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import MASK64, U64, docs_view, mix, written

BLANKS = " \t\n\x0b\x0c\r"
KEYS_PER_FILTER = 100_000
SLICE = 100_000
MOST_SHIPPED = 500_000  # digests that go to every task at once, about 50 MB


# ---- binary-fuse filter ------------------------------------------------

def _positions(keys: np.ndarray, seed: int, segment: int, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots (one in each of three consecutive segments) and the fingerprint of every key."""
    h = mix(keys ^ U64(seed))
    first = ((h >> U64(32)) * U64(n_segments * segment)) >> U64(32)
    mask = U64(segment - 1)
    second = (first + U64(segment)) ^ ((h >> U64(18)) & mask)
    third = (first + U64(2 * segment)) ^ (h & mask)
    finger = ((h ^ (h >> U64(32))) & U64(0xFF)).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), finger


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of distinct 64-bit keys, by peeling slots that hold one key."""
    n = len(keys)
    segment = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    n_segments = max(1, math.ceil(n * factor / segment))
    for attempt in range(100):
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & MASK64
        slots, finger = _positions(keys, seed, segment, n_segments)
        size = (n_segments + 2) * segment
        degree = np.zeros(size, dtype=np.int32)
        held = np.zeros(size, dtype=np.int64)  # xor of the keys' numbers in a slot
        for row in slots:
            np.add.at(degree, row, 1)
            np.bitwise_xor.at(held, row, np.arange(n))
        order, own = [], []
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            key, where = held[ready], ready
            key, at = np.unique(key, return_index=True)
            where = where[at]
            order.append(key)
            own.append(where)
            for row in slots[:, key]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(held, row, key)
            touched = np.unique(slots[:, key])
            ready = touched[degree[touched] == 1]
        if sum(map(len, order)) == n:
            table = np.zeros(size, dtype=np.uint8)
            for key, where in zip(reversed(order), reversed(own), strict=True):
                a, b, c = slots[:, key]
                table[where] = finger[key] ^ table[a] ^ table[b] ^ table[c] ^ table[where]
            return seed, segment, n_segments, table.tobytes()
        n_segments += max(1, n_segments // 16)
    raise RuntimeError("no seed peels this bucket; its keys are not distinct")


def in_fuse(keys: np.ndarray, seed: int, segment: int, n_segments: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others."""
    t = np.frombuffer(table, dtype=np.uint8)
    (a, b, c), finger = _positions(keys, seed, segment, n_segments)
    return finger == t[a] ^ t[b] ^ t[c]


# ---- snapshots and batches ---------------------------------------------

def normalised(text: F.Column) -> F.Column:
    return F.translate(text, BLANKS, "")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_cp (code points of the whole text), text_sha256 of the normalised text, and its leading 64 bits."""
    d = docs_view(df, id_col, text_col)
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return d.select("doc_id", F.length("text").cast("long").alias("n_cp"), sha.alias("text_sha256")).withColumn(
        "key", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"))


def best_row() -> F.Column:
    """Most code points first, then the smallest doc_id, null last."""
    return F.min(F.struct((-F.col("n_cp")).alias("minus_cp"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")))


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: text_sha256, key, best row, rows. Sums and minima, so copies shrink before the shuffle."""
    return rows.groupBy("text_sha256", "key").agg(best_row().alias("best"), F.count(F.lit(1)).alias("rows"))


@dataclass
class Snapshot:
    """A sealed set of documents: ``rows`` (their digests), ``groups`` (the exact buckets, one row a digest), ``filters``
    (one row for each of ``buckets``) and ``texts`` (doc_id, text), read only for the byte checks of positives."""

    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int
    texts: DataFrame


def bucket_of(buckets: int) -> F.Column:
    return F.pmod(F.col("key"), F.lit(buckets)).cast("int")


def seal(history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Write the digests, exact buckets and filters of ``history``, once. Digests are uniform, so a bucket holds about
    KEYS_PER_FILTER keys at any size. Rows of the source must not change afterwards."""
    rows = written(digests(history, id_col, text_col), "history")
    groups = written(grouped(rows), "snapshot")
    buckets = max(1, math.ceil(groups.count() / KEYS_PER_FILTER))

    def build(table: pa.Table) -> pa.Table:
        keys = np.unique(table["key"].to_numpy()).astype(U64)
        seed, segment, n, data = build_fuse(keys)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "seed": pa.array([seed - (1 << 63)], pa.int64()),
                         "segment": pa.array([segment], pa.int32()), "segments": pa.array([n], pa.int32()), "data": pa.array([data], pa.binary())})

    filters = groups.select(bucket_of(buckets).alias("bucket"), "key").groupBy("bucket").applyInArrow(
        build, "bucket int, seed long, segment int, segments int, data binary")
    return Snapshot(rows, groups, written(filters, "filters"), buckets, docs_view(history, id_col, text_col))


def screened(batch_groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """text_sha256 of the batch's distinct digests that the filters let through (all that the snapshot holds are among them).

    A bucket's filter goes to each of the bucket's slices of the batch, SLICE digests or so, one row at a time: a large
    batch against a small snapshot is no large group.
    """

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                f = batch.slice(n, 1).to_pylist()[0]
                hit = in_fuse(np.array(f["keys"], dtype=np.int64).astype(U64), f["seed"] + (1 << 63), f["segment"], f["segments"], f["data"])
                yield pa.RecordBatch.from_arrays([pa.array(f["shas"], pa.string()).filter(pa.array(hit))], names=["text_sha256"])

    slices = max(1, math.ceil(batch_groups.count() / (SLICE * snapshot.buckets)))
    mine = batch_groups.select(bucket_of(snapshot.buckets).alias("bucket"), F.expr(f"cast(pmod(key div {snapshot.buckets}, {slices}) as int)").alias("slice"), "key", "text_sha256")
    mine = mine.groupBy("bucket", "slice").agg(F.collect_list("key").alias("keys"), F.collect_list("text_sha256").alias("shas"))  # SLICE on average
    return mine.join(snapshot.filters, "bucket").drop("bucket", "slice").mapInArrow(screen, "text_sha256 string")


def confirmed(texts: DataFrame, matched: DataFrame) -> DataFrame:
    """(text_sha256, body): the distinct normalised texts whose digests are ``matched``. A set of MOST_SHIPPED digests at most
    goes to the scans, so that no other text is moved; a larger one meets the texts in a shuffle join."""
    d = texts.select(normalised(F.col("text")).alias("body")).withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
    wanted = matched.select("text_sha256")
    return d.join(F.broadcast(wanted) if matched.count() <= MOST_SHIPPED else wanted, "text_sha256", "left_semi").distinct()


def dedup_against(batch: DataFrame, snapshots: list[Snapshot], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dedup ``batch`` within itself and against sealed snapshots.

    One row for each row of the batch and of the snapshots: doc_id, n_cp, text_sha256, keep_id, group_size, kept. Only
    digests that a filter lets through meet the snapshot's exact buckets; all others keep the batch's own group. A
    digest that two snapshots share and the batch lacks stays one group in each.
    """
    new = written(digests(batch, id_col, text_col), "batch")
    new_groups = written(grouped(new), "batch-groups")
    hits = []
    for n, snapshot in enumerate(snapshots):
        positive = screened(new_groups, snapshot)
        hits.append(snapshot.groups.join(positive, "text_sha256", "left_semi").select("text_sha256", F.lit(n).alias("snapshot"), "best", "rows"))
    if not hits:
        return _rows(new, new_groups)
    matched = written(reduce(DataFrame.unionByName, hits), "matched")
    digest = written(matched.select("text_sha256").distinct(), "digests")
    bodies = reduce(DataFrame.unionByName, [confirmed(t, digest) for t in [docs_view(batch, id_col, text_col), *[s.texts for s in snapshots]]])
    apart = bodies.distinct().groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_sha256")  # digests collide, bytes differ
    equal = matched.join(written(apart, "collisions"), "text_sha256", "left_anti")
    of_batch = new_groups.select("text_sha256", "best", "rows").join(digest, "text_sha256", "left_semi")
    whole = equal.select("text_sha256", "best", "rows").unionByName(of_batch.join(equal.select("text_sha256").distinct(), "text_sha256", "left_semi"))
    whole = written(whole.groupBy("text_sha256").agg(F.min("best").alias("all_best"), F.sum("rows").alias("all_rows")), "merged")

    def final(groups: DataFrame) -> DataFrame:
        return groups.join(whole, "text_sha256", "left").select("text_sha256", F.coalesce("all_best", "best").alias("best"), F.coalesce("all_rows", "rows").alias("rows"))

    parts = [_rows(new, final(new_groups))] + [_rows(s.rows, final(s.groups)) for s in snapshots]
    return reduce(DataFrame.unionByName, parts)


def _rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("rows").alias("group_size"), (-F.col("best.minus_cp")).alias("best_cp"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("best_cp"))
    return rows.join(g, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_cp")


def dedup(batch: DataFrame, history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`dedup_against` with ``history`` sealed as the one snapshot."""
    return dedup_against(batch, [seal(history, id_col, text_col)], id_col, text_col)
