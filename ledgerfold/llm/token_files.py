"""Token-id output: flat files of unsigned integers plus 64-bit document offsets.

Documents are dealt by ranges of doc_id; each task encodes its range in order
and writes one shard: ``NAME.bin`` (ids one after another, little-endian,
two bytes each if the vocabulary and the end id fit, else four) and
``NAME.idx`` (int64 little-endian: the offset, in ids, at which each document
of the shard begins, then the shard's length); ``NAME.doc`` (int64: doc_ids,
the smallest int64 for a null). File names are unique to the
attempt, and the manifest, itself a table, names only files of attempts that
ended well, so a retried task leaves at worst a file that nothing names. The
manifest's running sum gives every shard's base, so a document's place in the
whole stream is base + offset. ``read`` maps the files into memory where the
folder is a local one, and reads the byte ranges otherwise.

The tokenizers library encodes every text. Where its pre-tokenizer can only
break at a single blank between two other characters, a text is cut there
first, and the library's ids of a piece are remembered by the worker process,
also from task to task, so that a word is not encoded at each occurrence. New
pieces are encoded many in one text, joined by such blanks, and told apart by
the bytes that each id stands for.

Defined results: a null or empty text is a document of the end id alone; null
doc_ids come first; rows of equal doc_id are ordered by a hash of the text;
an empty table writes no shard; other columns are ignored. ``<|...|>`` strings
in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.llm.common import docs_view, shared_path, slices, written

NO_ID = -(1 << 63)
MANIFEST = "shard int, base_name string, n_docs long, n_tokens long, width int"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Encoder:
    """Texts to the bytes of their ids. Remembers pieces of at most ``LONGEST`` characters, about ``MOST`` of them."""

    # other than white space, in any Unicode version
    DARK = "[^\\s\\u180e\\u200b\\ufeff]"
    CUT = re.compile(f" (?<={DARK} )(?={DARK})")
    ENDS_DARK = re.compile(f"{DARK}\\Z")
    LONGEST, MOST, JOINED = 64, 600_000, 256

    def __init__(self, tokenizer_path: str, end_id: int) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.encode_special_tokens = True
        self.width = 2 if max(self.tok.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        spec = json.loads(self.tok.to_str())
        first = spec["pre_tokenizer"] or {}
        # a match of the byte-level pattern holds a blank before other characters, never after them
        self.cuts = (first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not spec["normalizer"]
                     and not spec["post_processor"] and not spec["truncation"] and not spec["padding"] and not spec["model"].get("dropout")
                     and all(t["special"] for t in spec["added_tokens"]))
        self.known: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # a character of the byte-level alphabet is a byte
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)

    def whole(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        encoded = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        data = np.fromiter(chain.from_iterable(encoded), dtype=kind).tobytes()
        ends = [0, *accumulate(len(ids) * self.width for ids in encoded)]
        return [data[a:b] for a, b in pairwise(ends)]

    def following(self, words: list[str]) -> list[bytes]:
        """The ids of ``words``, each after a blank; all of them begin and end with other characters."""
        groups = [words[i:i + self.JOINED] for i in range(0, len(words), self.JOINED)]
        encoded = [e.ids for e in self.tok.encode_batch_fast([f" {' '.join(g)}" for g in groups], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(encoded), dtype=f"<u{self.width}")
        ends = np.cumsum(self.n_bytes[ids])
        stops = np.cumsum(np.fromiter((len(w.encode("utf-8")) + 1 for w in words), dtype=np.int64, count=len(words)))
        at = np.searchsorted(ends, stops)
        if len(at) and (at[-1] != len(ends) - 1 or (ends[at] != stops).any()):  # ids that are no plain bytes
            return self.whole([f" {w}" for w in words])
        data, cut = ids.tobytes(), ((at + 1) * self.width).tolist()
        return [data[a:b] for a, b in pairwise([0, *cut])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.whole(texts)
        pieces = [self.CUT.split(t) for t in texts]
        heads = self.whole([p.pop(0) for p in pieces])
        known, flat = self.known, list(chain.from_iterable(pieces))
        found = list(map(known.get, flat))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = set(map(flat.__getitem__, missing))
        blank = [w for w in {p[-1] for p in pieces if p} & new if not self.ENDS_DARK.search(w)]  # the last of a text alone can be so
        known.update(zip(blank, self.whole([f" {w}" for w in blank]), strict=True))
        dark = list(new.difference(blank))
        known.update(zip(dark, self.following(dark), strict=True))
        for i in missing:
            found[i] = known[flat[i]]
        ids = iter(found)
        out = [h + b"".join(islice(ids, len(p))) for h, p in zip(heads, pieces, strict=True)]
        for w in new:
            if len(w) > self.LONGEST:
                del known[w]
        if len(known) > self.MOST:  # the pieces of the last texts stay
            rest = set(flat)
            self.known = {w: known[w] for w in rest.intersection(known)} if len(rest) < self.MOST else {}
        return out


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str, end_id: int) -> Encoder:
    """One encoder for each worker process, with what it remembers."""
    return Encoder(tokenizer_path, end_id)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode and write every document; the manifest, with every shard's base."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = None
        fs, root = filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        out, ends, total, width = None, [], 0, 4
        doc_ids = []
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for part in slices(batch, 4 << 20):
                if encoder is None:
                    encoder = encoder_of(tokenizer_path, end_id)
                    width = encoder.width
                    end = end_id.to_bytes(width, "little")
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.bin", compression=None)
                doc_ids.append(part.column("doc_id").fill_null(NO_ID).to_numpy())
                for ids in encoder.encode(part.column("text").to_pylist()):
                    ends.append(total)
                    total += len(ids) // width + 1
                    out.write(ids + end)
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
            f.write(np.array([*ends, total], dtype="<i8").tobytes())
        with fs.open_output_stream(f"{root}/{name}.doc", compression=None) as f:
            f.write(np.concatenate(doc_ids).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(ends)], pa.int64()),
                                          pa.array([total], pa.int64()), pa.array([width], pa.int32())], names=["shard", "base_name", "n_docs", "n_tokens", "width"])

    d = docs_view(docs).withColumn("tie", F.xxhash64("text"))
    ordered = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(run, MANIFEST), "manifest")
    # a row for each shard: the only data that one task sees whole
    base = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    first = F.sum("n_docs").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(base, F.lit(0))).withColumn("first_doc", F.coalesce(first, F.lit(0))).withColumn("folder", F.lit(folder))


class Shard:
    """One shard's documents by position; local files are memory-mapped."""

    def __init__(self, folder: str, base_name: str, width: int) -> None:
        fs, root = filesystem(folder)
        self.width, self.kind = width, np.dtype(f"<u{width}")
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = lambda end: pa.memory_map(f"{root}/{base_name}.{end}") if local else fs.open_input_file(f"{root}/{base_name}.{end}")
        self.data = opened("bin")
        with opened("idx") as f:
            self.offsets = np.frombuffer(f.read(), dtype="<i8")
        with opened("doc") as f:
            self.doc_ids = np.frombuffer(f.read(), dtype="<i8")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def tokens(self, first: int, stop: int) -> np.ndarray:
        """Ids of documents first..stop-1, one after another."""
        at, end = int(self.offsets[first]), int(self.offsets[stop])
        return np.frombuffer(self.data.read_at((end - at) * self.width, at * self.width), dtype=self.kind)

    def runs(self, most: int) -> Iterator[tuple[int, int]]:
        """(first, stop) of runs of documents with about ``most`` ids, one document at least."""
        first = 0
        while first < len(self):
            stop = int(np.searchsorted(self.offsets, self.offsets[first] + most, side="right")) - 1
            stop = min(max(stop, first + 1), len(self))
            yield first, stop
            first = stop


def read(manifest: DataFrame, shards: int) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary: little-endian unsigned 32-bit) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["folder"], row["base_name"], row["width"])
                for first, stop in shard.runs(1 << 20):
                    ids = shard.tokens(first, stop).astype("<u4")
                    off = shard.offsets[first:stop + 1]
                    cut = (off - off[0]).tolist()
                    doc = shard.doc_ids[first:stop]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(off[:-1] + row["base"], pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "start", "ids"])

    return manifest.repartition(max(1, shards), "shard").mapInArrow(run, "doc_id long, start long, ids binary")
