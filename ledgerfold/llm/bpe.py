"""Byte-level BPE encoding and decoding from a file of merge ranks.

Every match of the split pattern is encoded by itself. Its bytes form a linked
list; for each pair of neighbours with a rank, the list position goes into the
bucket of that rank. A hierarchical bitmap (one bit for a non-empty bucket, one
above it for a non-empty run of buckets) gives the lowest rank present by find-first-set, so
the next merge costs a few word operations however long the list is. Merged
neighbours leave stale entries behind; an entry counts only if the pair now at
its position still has the bucket's rank. Within a rank, the leftmost position
goes first. Matches that recur are remembered in two bounded tables; those that are new in a
batch share one list, in which no pair reaches over a match's edge.

Defined results: null and empty texts give no ids and no bytes; texts of any
length are encoded whole; ids that are no rank raise in decoding; rows repeat,
and other columns pass through untouched.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.llm.common import lean, slices

REMEMBERED, LONGEST_REMEMBERED = 250_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Characters of text split at a time, and bytes of split matches in one linked list (one match at least).
AT_ONCE, TOGETHER = 1 << 20, 1 << 12
SPAN = 10  # a leaf of the bitmap covers 2 ** SPAN ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one split match."""
    return merge_all([piece], ranks)[0]


def merge_all(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each split match; all matches lie in one linked list, and no pair reaches over a match's edge.

    ``buckets`` maps a rank to the positions waiting for it; ``leaf`` holds a
    bit for each non-empty bucket, ``top`` one for each non-empty leaf. The
    lowest set bit of ``top``, then of that leaf, is the next rank.
    """
    text, get, low = b"".join(pieces), ranks.get, (1 << SPAN) - 1
    n = len(text)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends
    before = list(range(-1, n))
    inner = bytearray(b"\1") * (n + 1)  # 0 where a match begins: nothing merges to the left of it
    at = 0
    for piece in pieces:
        inner[at] = 0
        at += len(piece)
        if piece in ranks:
            inner[at - len(piece):at] = bytes(len(piece))  # done already: its bytes stay apart
    inner[n] = 0
    # rank of the pair that begins at i; -1 if none or merged into its left
    now = [get(text[i:i + 2], -1) if inner[i + 1] else -1 for i in range(n)]
    buckets: dict[int, list[int]] = {}
    for i, rank in enumerate(now):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
    leaf: dict[int, int] = {}
    top = 0
    for rank in buckets:
        a = rank >> SPAN
        leaf[a] = leaf.get(a, 0) | 1 << (rank & low)
        top |= 1 << a
    while top:
        a = (top & -top).bit_length() - 1
        word = leaf[a]
        rank = a << SPAN | (word & -word).bit_length() - 1
        bucket = buckets[rank]  # a heap: the leftmost position first
        lower = False
        while bucket and not lower:
            i = heappop(bucket)
            if now[i] != rank:
                continue  # stale
            middle = end[i]
            stop = end[i] = end[middle]
            now[middle] = now[i] = -1
            near = ()
            if inner[stop]:
                before[stop] = i
                r = now[i] = get(text[i:end[stop]], -1)
                if r >= 0:
                    near = ((r, i),)
            if inner[i]:
                j = before[i]
                r = now[j] = get(text[j:stop], -1)
                if r >= 0:
                    near = (*near, (r, j))
            for r, j in near:
                if r in buckets:
                    heappush(buckets[r], j)
                else:
                    buckets[r] = [j]
                    c = r >> SPAN
                    leaf[c] = leaf.get(c, 0) | 1 << (r & low)
                    top |= 1 << c
                if r < rank:
                    lower = True
        if not bucket:
            del buckets[rank]
            leaf[a] &= ~(1 << (rank & low))
            if not leaf[a]:
                top &= ~(1 << a)
    out, i = [], 0
    for piece in pieces:
        ids, stop = [], i + len(piece)
        whole = get(piece)
        if whole is not None:
            ids.append(whole)
            i = stop
        while i < stop:
            ids.append(ranks[text[i:end[i]]])
            i = end[i]
        out.append(ids)
    return out


class Encoder(dict):
    """Ids (32-bit, as bytes) of split matches. A full table becomes the older one, whose
    entries come back as they are met again, and the one that was the older goes."""

    def __bool__(self) -> bool:
        return True  # also while nothing is remembered

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; the matches that none of the tables holds are encoded together."""
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self)
        for piece in new.intersection(self.older):
            self[piece] = self.older[piece]
        new = list(new.difference(self))
        first = 0
        while first < len(new):
            part, size = [], 0
            while first < len(new) and size < TOGETHER:
                part.append(new[first].encode("utf-8"))
                size += len(part[-1])
                first += 1
            for piece, ids in zip(new[first - len(part):first], merge_all(part, self.ranks), strict=True):
                self[piece] = array("i", ids).tobytes()
        out = [b"".join(map(self.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > LONGEST_REMEMBERED:
                del self[piece]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text])[0], dtype="<i4").tolist()

    def column(self, texts: pa.Array) -> pa.Array:
        made, some, size = [], [], 0
        for text in texts.to_pylist():
            some.append(text)
            size += len(text or "")
            if size >= AT_ONCE:
                made += self.packed(some)
                some, size = [], 0
        made += self.packed(some)
        ends = np.cumsum([0, *(len(m) // 4 for m in made)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), dtype="<i4"), pa.int32()))


class Decoder:
    """The bytes of ids, gathered from one table of all ranks' bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        top = max(ranks.values(), default=-1) + 1
        parts = [b""] * top
        self.known = np.zeros(top, dtype=bool)
        for piece, i in ranks.items():
            parts[i], self.known[i] = piece, True
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is no rank of the vocabulary")
        size = self.size[ids]
        at = np.repeat(self.start[ids] - np.cumsum(size) + size, size)
        return self.table[at + np.arange(len(at))]

    def column(self, lists: pa.ListArray) -> pa.Array:
        ends = np.asarray(lists.offsets, dtype=np.int64)
        ids = np.asarray(lists.values)[ends[0]:ends[-1]]
        out = []
        ends = ends - ends[0]
        for i in range(len(lists)):  # one document at a time bounds what a very long one needs
            out.append(self.bytes_of(ids[ends[i]:ends[i + 1]]).tobytes())
        return pa.array(out, pa.binary())


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process, so its table outlives a task."""
    return _ENCODERS.get((ranks_path, pattern)) or _ENCODERS.setdefault((ranks_path, pattern), Encoder(load_ranks(ranks_path), pattern))


def _with_column(df: DataFrame, name: str, kind: T.DataType, source: str, make) -> DataFrame:
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])
    names = schema.names

    def run(batches):
        step = make()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names[:-1]), step(part.column(source))], names=names)

    return df.mapInArrow(lean(run), schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` as array<int>. ``ranks_path`` must be readable on every executor."""
    return _with_column(df, out_col, T.ArrayType(T.IntegerType()), text_col, lambda: encoder(ranks_path, pattern).column)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids_col`` stands for."""
    return _with_column(df, out_col, T.BinaryType(), ids_col, lambda: Decoder(load_ranks(ranks_path)).column)


def digest_columns(ids_col: str = "ids", decoded_col: str = "decoded") -> list[F.Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    decimal = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return [F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col(decoded_col), 256).alias("decoded_sha256")]
