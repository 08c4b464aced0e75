"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for every host (the column source) Spark counts the distinct texts
that hold a line, so exact copies of a document count once. Lines held by more than `share` of the
host's texts, and by at least `least` of them, count as boilerplate and are removed; documents with
too little left are rejected.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a null
source is a host of its own; repeated rows give repeated results and count as one text of their host;
whole texts are read, however long; an empty table gives no rows; extra columns are ignored, whatever
their names. Hosts with fewer than `least` distinct texts never lose a line to the rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import WordIds, map_batches, materialise, texts

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
DIGITS = re.compile(b"[0-9]+")
SHORT = 12  # words; longer lines keep their digits, so that paragraphs that differ in numbers only stay apart

MEASURED = "row_id long, doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<struct<hash:long,words:long>>"


def repeat_words(ids: np.ndarray, vocabulary: int) -> int:
    """Words inside a window of three that is found twice or more; ids below `vocabulary`."""
    if len(ids) < 3:
        return 0
    if vocabulary < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pair = np.unique(ids[:-1] * vocabulary + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * vocabulary + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def normal(line: bytes) -> bytes:
    """A-Z in lower case, single spaces for ASCII white space, and in a line of at most SHORT words 0 for every run of digits."""
    words = line.lower().split()
    joined = b" ".join(words)
    return DIGITS.sub(b"0", joined) if len(words) <= SHORT else joined


def measure(docs: DataFrame) -> DataFrame:
    """Base figures and hashed lines of every document; row_id tells rows apart."""

    def signed(digests: list[int]) -> list[int]:
        return np.array(digests, np.uint64).astype(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = WordIds()
            cols: list[list] = [[] for _ in range(10)]
            for doc_id, source, text in zip(batch["doc_id"].to_pylist(), batch["source"].to_pylist(), texts(batch["text"]), strict=True):
                raw = text.encode()
                words = raw.split()
                numbers = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                seen: set[bytes] = set()
                dup, held = 0, {}
                for line in raw.split(b"\n"):
                    n = len(line.split())
                    if not n:
                        continue
                    if line in seen:
                        dup += 1
                    seen.add(line)
                    key = xxhash.xxh64_intdigest(normal(line))
                    held[key] = held.get(key, 0) + n
                row = (row_id, doc_id, source, len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat_words(numbers, len(ids)), signed([xxhash.xxh64_intdigest(raw)])[0], [{"hash": h, "words": n} for h, n in zip(signed(list(held)), held.values(), strict=True)])
                row_id += 1
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            line_type = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, line_type]
            names = [x.split()[0] for x in MEASURED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")), run, MEASURED)


def common_lines(measured: DataFrame, share: float, least: int) -> DataFrame:
    """(host, hash) of lines above the limits; host is the source, an empty struct field for null."""
    host = F.struct("source").alias("host")
    held = measured.select(host, "text_hash", F.explode("lines.hash").alias("hash")).distinct()
    found = held.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    hosts = measured.select(host, "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    return found.join(hosts, "host").filter(F.col("n") > share * F.col("texts")).select("host", "hash")


def line_rules(docs: DataFrame, share: float = 0.05, least: int = 20, left: float = 0.3, broadcast_rows: int = 100_000) -> DataFrame:
    """Base figures of every document of `docs` (doc_id, text, source), n_removed_words and the verdict `kept`.

    kept is false if the base rule fails or less than `left` of the words stay once common lines are gone.
    """
    measured = materialise(measure(docs))
    common = materialise(common_lines(measured, share, least))
    if common.count() <= broadcast_rows:  # else an ordinary join, whose hot keys AQE splits
        common = F.broadcast(common)
    lines = measured.select("row_id", F.struct("source").alias("host"), F.explode("lines").alias("line")).select("row_id", "host", "line.hash", "line.words")
    lost = lines.join(common, ["host", "hash"]).groupBy("row_id").agg(F.sum("words").alias("n_removed_words"))
    out = measured.join(lost, "row_id", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row_id", "source", "text_hash", "lines")
