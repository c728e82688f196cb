"""Benchmark decontamination by SimHash of item-sized windows.

For each length that a benchmark item has (in words), the windows of that many
words are fingerprinted: 256 bits, each the sign of the sum of its words' bits.
Sixteen 16-bit blocks index the items' fingerprints: if a fingerprint is
within RADIUS bits of an item's, some block is within RADIUS/16 bits of the
item's block (pigeonhole), and the index holds all such block values, so no
fingerprint within the radius is missed. Candidates are verified exactly:
weighted Jaccard similarity of the two multisets of five-word shingles (weight:
how often a shingle occurs), at least 0.75. Windows that share no shingle with
any item have similarity 0 and are not fingerprinted. A document of fewer words
than an item is one window, itself (an item whose end was cut off, say).

The radius covers what a similarity of 0.75 can change: at most one word in
eight of a window (its ends cut off or written over), an angle of 29 degrees, about 41 of 256
bits with a deviation of 6.

Items are held in memory in blocks of at most ITEMS items and BYTES bytes of
text; a larger benchmark is run block after block over the documents.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; null texts
have none, match nothing, and stay; items without words are skipped; items of
fewer than five words have one shingle, themselves, and match equal windows;
rows of one item_id are items of their own that report the same id; a null
item_id is skipped in the list of ids, yet counts as a match; empty tables
match nothing; other columns are ignored. Whole texts of any length are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.llm.common import U64, WordHash, lean, mix, shingles, slices

WIDTH, THRESHOLD = 5, 0.75
LANES, RADIUS = 4, 63  # 256 bits; RADIUS // 16 = 3
ITEMS, BYTES = 4096, 16 << 20
CHUNK = 4096


def word_bits(words: np.ndarray) -> np.ndarray:
    """0/1 bits of each word: (n, 256)."""
    lanes = np.stack([mix(words + U64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) for i in range(LANES)], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1)


def fingerprints(bits_before: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints (n, 16) of 16-bit blocks of the windows at ``starts``; bits_before are running sums of word_bits."""
    ones = bits_before[starts + size] - bits_before[starts]
    return np.packbits(2 * ones > size, axis=1).view(np.uint16)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two multisets of hashes."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(m[i], n[j]).sum())
    return low / (len(a) + len(b) - low)


class ItemIndex:
    """Items by length, their fingerprints, the block index and the set of all shingles."""

    def __init__(self, items: list[tuple[int | None, str]], width: int = WIDTH) -> None:
        words_of = WordHash()
        self.width, self.by_size = width, defaultdict(list)
        near = np.zeros((16, 1 << 16), dtype=bool)
        masks = np.array([sum(1 << b for b in c) for k in range(RADIUS // 16 + 1) for c in combinations(range(16), k)], dtype=np.uint16)
        grams = defaultdict(list)
        for item_id, text in items:
            words = words_of.array(text.encode("utf-8").lower().split())
            if not len(words):
                continue
            sh = shingles(words, width)
            grams[min(len(words), width)].append(sh)
            bits = np.vstack([np.zeros((1, 64 * LANES), np.int32), np.cumsum(word_bits(words), axis=0, dtype=np.int32)])
            finger = fingerprints(bits, np.array([0]), len(words))[0]
            for block in range(16):
                near[block, finger[block] ^ masks] = True
            self.by_size[len(words)].append((item_id, sh, finger))
        self.near = np.packbits(near, axis=1)
        self.grams = {k: np.unique(np.concatenate(v)) for k, v in grams.items()}
        self.fingers = {m: np.stack([f for *_, f in rows]) for m, rows in self.by_size.items()}

    def match(self, words: np.ndarray, near: np.ndarray, threshold: float) -> dict:
        """{item_id: (similarity, first word)} of the items that some window holds."""
        best: dict = {}
        n = len(words)
        hits = {}
        for k, grams in self.grams.items():
            if n >= k:
                sh = shingles(words, k)
                at = np.searchsorted(grams, sh)
                hit = grams[np.minimum(at, len(grams) - 1)] == sh
                if hit.any():
                    hits[k] = (sh, np.concatenate([[0], np.cumsum(hit)]))
        if not hits:
            return best
        bits = None
        for length, rows in self.by_size.items():
            k = min(length, self.width)
            size = min(length, n)  # a document with fewer words than the items is one window, itself
            if k not in hits:
                continue
            sh, before = hits[k]
            count = size - k + 1
            if count < threshold * (length - k + 1):
                continue
            starts = np.flatnonzero(before[count:] > before[:len(before) - count])
            starts = starts[starts <= n - size]
            if not len(starts):
                continue
            if bits is None:
                bits = np.vstack([np.zeros((1, 64 * LANES), np.int32), np.cumsum(word_bits(words), axis=0, dtype=np.int32)])
            for a in range(0, len(starts), CHUNK):
                s = starts[a:a + CHUNK]
                finger = fingerprints(bits, s, size)
                probe = near[np.arange(16)[None, :], finger].any(axis=1)
                s, finger = s[probe], finger[probe]
                for (item_id, own, _), theirs in zip(rows, self.fingers[length], strict=True):
                    apart = np.bitwise_count(finger ^ theirs).sum(axis=1)
                    for x in s[apart <= RADIUS].tolist():
                        got = weighted_similarity(sh[x:x + count], own)
                        if got >= threshold and got > best.get(item_id, (0.0, 0))[0]:
                            best[item_id] = (got, x)
        return best


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[DataFrame]:
    """The items in blocks within ITEMS and BYTES, by a running hash range."""
    view = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, size = view.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-2 * n // ITEMS) if n > ITEMS else 1, -(-2 * size // BYTES) if size > BYTES else 1)
    for k in range(blocks):
        yield view if blocks == 1 else view.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         threshold: float = THRESHOLD, width: int = WIDTH, out_col: str = "matches") -> DataFrame:
    """``docs`` with ``out_col``: array<struct<item_id, similarity, first_word>> by item_id, one entry for each item found."""
    spark = docs.sparkSession
    kind = "array<struct<item_id:bigint,similarity:double,first_word:bigint>>"
    out = docs.drop(out_col).withColumn(out_col, F.expr(f"cast(array() as {kind})"))
    for block in item_blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in block.collect()], width))  # within ITEMS and BYTES
        out = _one_block(out, held, text_col, threshold)
    return out


def _one_block(docs: DataFrame, held, text_col: str, threshold: float) -> DataFrame:
    schema = docs.schema
    names = schema.names
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words_of = held.value, WordHash()
        near = np.unpackbits(index.near, axis=1).astype(bool)
        for batch in batches:
            for part in slices(batch):
                made = []
                for text, before in zip(part.column(text_col).to_pylist(), part.column(names[-1]).to_pylist(), strict=True):
                    words = words_of.array(text.encode("utf-8").lower().split()) if text else np.zeros(0, U64)
                    got = index.match(words, near, threshold) if len(words) and index.by_size else {}
                    rows = before + [{"item_id": i, "similarity": s, "first_word": x} for i, (s, x) in got.items()]
                    made.append(sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array(made, arrow)], names=names)

    return docs.mapInArrow(lean(run), T.StructType(schema.fields))
