"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.sources.tables import drop_scratch, materialise, scratch_dir, table  # noqa: F401

# Words are maximal runs outside ASCII white space. bytes.split() has exactly these separators.
WORD_RE = r"[^\x20\x09-\x0D]+"

# What a function sees at once: bounds a Python worker's memory whatever batches Spark hands over.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and about `size` bytes of text (or one row), without copies."""
    for batch in batches:
        long = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        total = np.cumsum(sum((np.array(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in long), np.zeros(len(batch), np.int64)))
        start = 0
        while start < len(batch):
            before = total[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(total, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Gives what a task has freed back to the system, so that a worker which serves many stages doesn't keep the most of each."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches; what a task has freed goes back to the system when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(small(batches))
        release()

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of the whole-number columns `keys`, which must lie together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = np.stack([np.asarray(batch[k]) for k in keys], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in itertools.pairwise(cuts):
            key = values[a].tolist()
            if held and key != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def ranked(rows: DataFrame, key: str, buckets: Column) -> DataFrame:
    """`rows` (row_id, key and others) with `rank`, 0 to n - 1 among those of its key, in order of hashed buckets.

    `buckets` is the number of buckets of a row's key: a key that a third of all rows share is numbered in
    many tasks, and only the sizes of its buckets are summed in one.
    """
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), buckets.cast("long")))
    sizes = dealt.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("row_id")) - 1
    return dealt.withColumn("number", number).join(sizes, [key, "bucket"]).withColumn("rank", F.col("number") + F.col("before")).drop("bucket", "number", "before")


def texts(col: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as the empty text."""
    return [x or "" for x in col.to_pylist()]


class WordIds(dict):
    """Word (bytes) to a running number, assigned on first sight; `fresh` holds words not yet described."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        self[word] = n
        self.fresh.append(word)
        return n


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
