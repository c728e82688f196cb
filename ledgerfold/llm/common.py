"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.session import checkpoint_dir

U64 = np.uint64
MASK64 = (1 << 64) - 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def docs_view(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of ``df``: a null text is empty, every other column is left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with one function per task; it turns the lists of a batch's columns into lists of the output's."""
    struct = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                cols = step({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(lean(run), struct)


def give_back() -> None:
    """What this process has freed goes back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` of ``mapInArrow``, which gives back its memory at the end of a task: a worker process outlives its tasks and
    lies idle beside those of other steps."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes, one row at least, so that very long texts don't add up."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), most)
        yield from slices(batch.slice(half), most)


class WordHash(dict):
    """64-bit hash of a word (bytes), remembered; bounded by ``most`` words (about 50 MB a worker)."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of ``width`` consecutive words, in order; a shorter sequence is one run, no words give none."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    h = np.zeros(n - k + 1, dtype=U64)
    for i in range(k):
        h = h * U64(0x9E3779B97F4A7C15) + words[i:n - k + 1 + i]
        h = h ^ (h >> U64(29))
    return mix(h)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
