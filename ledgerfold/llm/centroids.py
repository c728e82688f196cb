"""K-means over integer vectors with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid less that to its
own. When centroids move, the gap of every vector of cluster c shrinks by at
most the drift of c plus the largest drift of the others, one number for the
whole cluster. So each cluster keeps a heap of its vectors keyed by gap plus
the drift that the cluster had accumulated when the vector was pushed; a round
pops only keys that the accumulated drift has caught up with, compares those
vectors with every centroid exactly, and pushes them again. All others are
known to stay, strictly nearer to their centroid than to any other.

On Spark, vectors lie in blocks of at most BLOCK rows, written once, bucketed by
block. A round's state (cluster and heaps of each block, about 15 bytes a vector)
is bucketed alike, so that a round joins both without a shuffle, sort or second
copy of the vectors, and a lost executor costs a re-read. A block holds its own
heaps: no heap grows with the data, and no group of equal vectors meets in one
task. Centroid sums change only by the vectors that moved; each block adds up its
own, and CLUSTERS times the width numbers a round reach the driver.

Exactness: distances are sums of integers, in doubles while those hold them
exactly and in 64-bit integers beyond; bounds are rounded to the safe side.

Defined results: a vector that is null, has another number of components, or
holds a null, NaN or infinity is left out; rows are vectors, so repeated ids and
equal rows count each. Components are floor(scale * x); beyond WIDEST they count
as WIDEST, so that squared distances fit in a long. Fewer vectors than
CLUSTERS give as many centroids as vectors; none give an empty table. A null id
hashes as an empty one; equal hashes go by components. Empty clusters keep
their centroid. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import shared_path, slices, written

COMPONENTS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
BLOCK = 4096
WIDEST = 1 << 27
BUCKET_BLOCKS, MOST_BUCKETS = 256, 100_000
SLACK = 1e-9  # relative, far above the rounding of square roots and sums
STATE = "block long, cluster binary, sizes array<int>, keys binary, members binary, moved array<struct<cluster:int,n:long,sums:array<long>>>"


# ---- blocks ------------------------------------------------------------

def _packed(width: int, scale: int):
    """(id, vector) rows to blocks: (block, ids, x), x the integers of all its vectors, row by row."""

    def block(number: int, ids: list, x: list) -> pa.RecordBatch:
        flat = np.concatenate(x)
        wide = bool(np.abs(flat).max() >= 1 << 15)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([wide]),
            pa.array([flat.astype(np.int32 if wide else np.int16).tobytes()], pa.binary())], names=["block", "ids", "wide", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, x, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in slices(batch):
                vectors = part.column(1)
                right = np.asarray(vectors.value_lengths().fill_null(-1)) == width
                rows = part.filter(pa.array(right))
                flat = rows.column(1).flatten()
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # nulls become NaN
                whole = np.isfinite(values).all(axis=1)
                own = rows.column(0).filter(pa.array(whole))
                with np.errstate(over="ignore"):
                    ints = np.clip(np.floor(values[whole] * scale), -WIDEST, WIDEST).astype(np.int32)
                for at in range(0, len(own), BLOCK):
                    ids.append(own.slice(at, BLOCK))
                    x.append(ints[at:at + BLOCK].ravel())
                    held += len(ids[-1])
                    if held >= BLOCK:
                        yield block(number, ids, x)
                        number, ids, x, held = number + 1, [], [], 0
        if held:
            yield block(number, ids, x)
    return run


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["x"], dtype=np.int32 if row["wide"] else np.int16).reshape(len(row["ids"]), -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks of the batches, one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _first(k: int, seed: int):
    """Blocks to their k vectors of smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = []
        for row in _rows(batches):
            m = _matrix(row)
            hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in row["ids"]]
            edge = heapq.nsmallest(k, hashes)[-1]
            best = heapq.nsmallest(k, best + [(h, m[at].tolist()) for at, h in enumerate(hashes) if h <= edge])
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([c for _, c in best], pa.list_(pa.int64()))], names=["hash", "centroid"])
    return run


# ---- one round ---------------------------------------------------------

def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c``, exact."""
    if not len(x) or max(np.abs(x).max(), np.abs(c).max()) * math.isqrt(4 * x.shape[1]) < 1 << 26:
        x, c = x.astype(np.float64), c.astype(np.float64)  # every sum below is an integer under 2 ** 53
    else:
        x, c = x.astype(np.int64), c.astype(np.int64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest row of ``c``, the smaller number on ties; gap to the second nearest, rounded down) of each row of ``x``."""
    d = distances(x, c)
    own = d.argmin(axis=1)
    if len(c) == 1:
        return own, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return own, two[:, 1] * (1 - SLACK) - two[:, 0] * (1 + SLACK)


def assign(x: np.ndarray, c: np.ndarray, drift: np.ndarray, cluster: np.ndarray | None, heaps: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Pop what ``drift`` (accumulated, one number a cluster) has caught up with, rescan and push it; the new clusters and
    the popped rows. ``heaps`` holds (key, row) of each cluster and is changed in place; ``cluster`` is None at the start."""
    if cluster is None:
        cluster, popped = np.full(len(x), -1, dtype=np.int32), np.arange(len(x))
    else:
        out = []
        for number, heap in enumerate(heaps):
            while heap and heap[0][0] <= drift[number]:
                out.append(heapq.heappop(heap)[1])
        cluster, popped = cluster.copy(), np.array(out, dtype=np.int64)
    own, gap = nearest(x[popped], c)
    cluster[popped] = own
    keys = gap + drift[own] * (1 - SLACK)
    for key, row, number in zip(keys.tolist(), popped.tolist(), own.tolist(), strict=True):
        heapq.heappush(heaps[number], (key, row))
    return cluster, popped


def _assign(c: np.ndarray, drift: np.ndarray):
    """Blocks with their state to their next state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x, heaps, cluster = _matrix(row), [[] for _ in c], None
            if row.get("cluster") is not None:
                cluster = np.frombuffer(row["cluster"], dtype=np.int32)
                keys, members = np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["members"], dtype=np.int32).tolist()
                at = 0
                for number, size in enumerate(row["sizes"]):
                    heaps[number] = list(zip(keys[at:at + size], members[at:at + size], strict=True))
                    at += size
            now, popped = assign(x, c, drift, cluster, heaps)
            before = cluster[popped] if cluster is not None else np.full(len(popped), -1)
            moved = popped[now[popped] != before]
            came, went = now[moved], before[now[popped] != before]
            changes = []
            for number in np.union1d(came, went[went >= 0]).tolist():
                plus, minus = x[moved[came == number]], x[moved[went == number]]
                sums = plus.sum(axis=0, dtype=np.int64) - minus.sum(axis=0, dtype=np.int64)
                changes.append({"cluster": number, "n": len(plus) - len(minus), "sums": sums.tolist()})
            flat = [entry for heap in heaps for entry in heap]
            yield pa.RecordBatch.from_pylist([{
                "block": row["block"], "cluster": now.astype(np.int32).tobytes(), "sizes": [len(h) for h in heaps],
                "keys": np.array([k for k, _ in flat], dtype=np.float64).tobytes(), "members": np.array([m for _, m in flat], dtype=np.int32).tobytes(),
                "moved": changes}], schema=ARROW)
    return run


ARROW = pa.schema([
    ("block", pa.int64()), ("cluster", pa.binary()), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("members", pa.binary()),
    ("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))])


def _spread(c: np.ndarray):
    """Blocks with their state to (id, cluster, distance) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x, cluster = _matrix(row).astype(np.int64), np.frombuffer(row["cluster"], dtype=np.int32)
            apart = x - c[cluster]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array((apart * apart).sum(axis=1))],
                                             names=["id", "cluster", "distance"])
    return run


class _Moves:
    """Sums and counts of all clusters, and how far centroids have drifted."""

    def __init__(self, c: np.ndarray):
        self.c, self.n, self.sums = c, [0] * len(c), [[0] * c.shape[1] for _ in c]
        self.drift = np.zeros(len(c))

    def take(self, rows) -> None:
        for r in rows:
            self.n[r["cluster"]] += r["n"] if r["at"] == 0 else 0
            self.sums[r["cluster"]][r["at"]] += r["x"]

    def step(self) -> None:
        after = np.array([[s // n for s in sums] if n else old.tolist() for sums, n, old in zip(self.sums, self.n, self.c, strict=True)], dtype=np.int64)
        by = np.sqrt(((after - self.c).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        others = np.full(len(by), by.max())
        others[by.argmax()] = np.delete(by, by.argmax()).max(initial=0.0)
        self.drift = (self.drift + by + others) * (1 + SLACK)
        self.c = after


def _bucketed(df: DataFrame, name: str, buckets: int, tables: list[str]) -> DataFrame:
    """``df`` as a table bucketed by block, in the shared folder."""
    spark, title = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", shared_path(spark, name)).saveAsTable(title)
    tables.append(title)
    return spark.table(title)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = COMPONENTS, clusters: int = CLUSTERS,
            rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): (id, cluster, distance) of every vector that is kept, and the final centroids, in order."""
    spark, tables = vectors.sparkSession, []
    n = vectors.count()
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, math.ceil(n / (BLOCK * BUCKET_BLOCKS))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    blocks = _bucketed(rows.mapInArrow(_packed(width, scale), "block long, ids array<long>, wide boolean, x binary").repartition(buckets, "block"),
                       "vectors", buckets, tables)
    first = blocks.select("ids", "wide", "x").mapInArrow(_first(clusters, seed), "hash string, centroid array<long>")
    start = first.orderBy("hash", "centroid").limit(clusters).collect()
    if not start:
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, width), dtype=np.int64)
    moves, state = _Moves(np.array([r["centroid"] for r in start], dtype=np.int64)), None
    for number in range(rounds + 1):
        both = blocks if state is None else blocks.join(state.drop("moved").hint("shuffle_hash"), "block")
        state = _bucketed(both.mapInArrow(_assign(moves.c, moves.drift), STATE), "state", buckets, tables)
        if number < rounds:
            change = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("at", "x"))
            moves.take(change.groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect())  # clusters x width numbers
            moves.step()
    out = written(blocks.join(state.select("block", "cluster").hint("shuffle_hash"), "block").mapInArrow(_spread(moves.c), "id long, cluster int, distance long"), "clustered")
    for title in tables:  # the catalog's entries; the files stay in the shared folder
        spark.sql(f"DROP TABLE {title}")
    return out, moves.c


def summary(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, cluster_inertia, inertia, centroid_sha256) of every cluster that has vectors; a sum beyond a long counts as the largest one."""
    def long(total):
        return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")

    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("d")).collect()  # a row per cluster
    spark, total = rows.sparkSession, sum(r["d"] for r in each)
    table = [(r["cluster"], r["d"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in each]
    t = spark.createDataFrame(table, "cluster int, own decimal(38,0), total decimal(38,0), centroid_sha256 string")
    return t.select("cluster", long(F.col("own")).alias("cluster_inertia"), long(F.col("total")).alias("inertia"), "centroid_sha256")
