"""Substring dedup against an index of content-cut reference blocks.

Factors are found by grouping, not by a greedy longest-factor (relative
Lempel-Ziv) parse: such a parse walks each document against every block that
shares words with it, which a passage that a third of all documents share makes
quadratic; no figure of one was measured. The grouping finds the same windows,
each of them, so the duplicate spans are those of the full parse.

The corpus itself is the reference. It is cut into blocks where its content
says so: every window of ``WINDOW`` words has an anchor, the run of ``GRAM``
words in it with the smallest hash, and the consecutive windows of one anchor
make a block. Equal windows have equal anchors at equal places, so a window can
recur in another document only in a block of the same anchor. The index maps
an anchor to the smallest document that holds it, the largest, and whether all
of its blocks are word for word the same.

A document's long factors are runs of blocks whose anchor an
earlier document (a smaller doc_id) holds with the same whole block; they need
no further look. A factor ends in a block whose anchor an earlier document
holds too, but with other words around it. Windows at those boundaries are
looked up one at a time in the reference blocks of that anchor. Every word that
a found window covers becomes part of a duplicate span.

Anchors, blocks and windows are compared by 64-bit (anchors) and 128-bit
(blocks and windows) hashes of word sequences. Every grouping is a minimum or
maximum, reduced before its shuffle, so a passage that a third of all documents
share is no single group.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null texts have none; texts
with fewer than WINDOW words lose nothing; a null doc_id counts as larger than
all others, and rows of one doc_id (null too) are one document, so they take
nothing from one another; passages that recur inside one document stay; other
columns are ignored; whole texts of any length are parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import U64, WordHash, docs_view, mix, signed, slices, written

WINDOW, GRAM = 50, 25
LAST = (1 << 63) - 1  # stands for a null doc_id: larger than all others
STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BACK = tuple(pow(s, -1, 1 << 64) for s in STEP)
CHUNK = 1 << 17


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n; short tables are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, 8192) + 1, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 16:
            _POWERS[base] = have
    return have[:n + 1]


class Sums:
    """Prefix sums of word hashes times powers of an odd step: the hash of any run of words is one subtraction away."""

    def __init__(self, words: np.ndarray, k: int) -> None:
        n = len(words)
        w = mix(words + U64(k) * U64(0x632BE59BD9B4E019)) if k else words
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(w * powers(STEP[k], n)[:n], out=self.sums[1:])
        self.back = powers(BACK[k], n)

    def runs(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[first]) * self.back[first] + (stop - first).astype(U64))


def blocks(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, "Sums"]:
    """Of each block: its anchor's hash, the anchor's place, the first and the last start of its windows."""
    one = Sums(words, 0)
    starts = np.arange(len(words) - gram + 1)
    grams = one.runs(starts, starts + gram)
    span = window - gram + 1
    n = len(words) - window + 1
    place = np.empty(n, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        place[a:b] = view[a:b].argmin(axis=1) + np.arange(a, b)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return grams[place[first]], place[first], first, last, one


def _rows(window: int, gram: int, kind: str):
    """kind 'index': a row for each block. kind 'windows': a row for each window of the blocks listed in ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHash()
        for batch in batches:
            for part in slices(batch, 8 << 20):
                ids, ties, texts = (part.column(c) for c in ("id", "tie", "text"))
                which = part.column("open").to_pylist() if kind == "windows" else None
                row_no, cols = [], []
                for r, text in enumerate(texts.to_pylist()):
                    words = text.encode("utf-8").split()
                    if len(words) < window:
                        continue
                    hashes = words_of.array(words)
                    anchor, place, first, last, one = blocks(hashes, window, gram)
                    two = Sums(hashes, 1)
                    if kind == "index":
                        # the words of a block and where its anchor stands in it
                        where = (place - first).astype(U64)
                        h1 = mix(one.runs(first, last + window) + where)
                        h2 = mix(two.runs(first, last + window) + where)
                        cols.append((signed(anchor), np.arange(len(first), dtype=np.int64), signed(h1), signed(h2)))
                    else:
                        own = np.asarray(which[r], dtype=np.int64)
                        lengths = last[own] - first[own] + 1
                        s = np.repeat(first[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                        cols.append((s, signed(one.runs(s, s + window)), signed(two.runs(s, s + window))))
                    row_no.append(np.full(len(cols[-1][0]), r))
                if not cols:
                    continue
                take = pa.array(np.concatenate(row_no))
                made = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*cols, strict=True)]
                names = ["anchor", "block", "h1", "h2"] if kind == "index" else ["s", "h1", "h2"]
                yield pa.RecordBatch.from_arrays([ids.take(take), ties.take(take), *made], names=["id", "tie", *names])
    return run


def _spans(window: int, gram: int):
    """Documents with their found blocks and windows -> words, kept text and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHash()
        for batch in batches:
            for part in slices(batch, 8 << 20):
                n_words, n_removed, kept, spans = [], [], [], []
                for text, found, windows in zip(*(part.column(c).to_pylist() for c in ("text", "found", "windows")), strict=True):
                    words = text.encode("utf-8").split()
                    if not found and not windows:
                        n_words.append(len(words))
                        n_removed.append(0)
                        kept.append(b" ".join(words).decode("utf-8"))
                        spans.append([])
                        continue
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    if found:
                        _, _, first, last, _ = blocks(words_of.array(words), window, gram)
                        own = np.asarray(found, dtype=np.int64)
                        np.add.at(edge, first[own], 1)
                        np.add.at(edge, last[own] + window, -1)
                    if windows:
                        s = np.asarray(windows, dtype=np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8"))
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append(turn.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                                                  pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])
    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_text, spans (word positions, end exclusive)."""
    d = docs_view(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("tie"), "text")
    index = d.select("id", "tie", "text").mapInArrow(_rows(window, gram, "index"), "id long, tie long, anchor long, block long, h1 long, h2 long")
    # the index of anchors that two documents hold: the smallest of them, and whether all blocks are alike
    anchors = index.groupBy("anchor").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2"))
    shared = written(anchors.filter("low < high").select("anchor", "low", ((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).alias("alike")), "anchors")
    held = index.select("id", "tie", "anchor", "block").join(shared, "anchor").filter("not alike or id > low")
    # a list a document, of its own blocks
    parsed = written(held.groupBy("id", "tie").agg(
        F.collect_list(F.when(F.col("alike"), F.col("block"))).alias("found"), F.collect_list(F.when(~F.col("alike"), F.col("block"))).alias("open")), "parsed")
    border = parsed.filter(F.size("open") > 0).select("id", "tie", "open")
    windows = d.select("id", "tie", "text").join(border, ["id", "tie"]).mapInArrow(
        _rows(window, gram, "windows"), "id long, tie long, s long, h1 long, h2 long")
    windows = written(windows, "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("h1", "h2", "low")
    extra = windows.join(first, ["h1", "h2"]).filter("id > low").groupBy("id", "tie").agg(F.collect_list("s").alias("windows"))
    todo = parsed.filter(F.size("found") > 0).select("id", "tie", "found").join(extra, ["id", "tie"], "full")
    out = d.join(todo, ["id", "tie"], "left").select("doc_id", "text", "found", "windows")
    return out.mapInArrow(_spans(window, gram), "doc_id long, n_words long, n_removed long, kept_text string, spans array<array<long>>")
