"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78 over words: each phrase is the longest known phrase
and one more word; words above 24 characters are cut where their characters say so, so that texts
without spaces parse too and an inserted character moves only the cuts beside it). The phrases are
hashed; the 128 smallest hashes are the signature, and the likeness of two signatures estimates the
Jaccard likeness of the phrase sets.

Defined results: a null text is empty; an empty text has an empty signature, which is like another
empty one (1) and unlike all others (0); whole texts are parsed, however long; repeated ids follow in
order of their texts' hashes, rows without a doc_id come first in that order; repeated rows
give a row each, and those equal in doc_id and text lie in one partition; a single document follows itself; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import map_batches, mix64

KEPT = 128
LONGEST = 24
FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def pieces(word: str) -> list[str]:
    """A long word, cut after each character pair whose hash is a multiple of 4: the same passage is cut alike wherever it stands.

    Stretches without such a pair (runs of few characters) go by single characters.
    """
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pairs = mix64((codes[:-1] << np.uint64(32)) | codes[1:])
    ends = [*(np.flatnonzero(pairs & np.uint64(3) == 0) + 2).tolist(), len(word)]
    found = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]
    return [x for piece in found for x in (piece if len(piece) > LONGEST else (piece,))]


def tokens(text: str) -> list[str]:
    words = text.split()
    if words and len(max(words, key=len)) > LONGEST:
        words = [x for w in words for x in (pieces(w) if len(w) > LONGEST else (w,))]
    return words


class Parser:
    """LZ78 over numbered words; a parse is the list of its dictionary's keys in order, key = parent * SPAN + word."""

    SPAN = 1 << 32

    def __init__(self, limit: int = 500_000) -> None:
        self.limit = limit
        self.numbers: dict[str, int] = {}
        self.hashes: list[int] = []

    def start(self) -> None:
        """Before a batch: forget words when there are too many."""
        if len(self.numbers) > self.limit:
            self.numbers, self.hashes = {}, []

    def number(self, words: list[str]) -> list[int]:
        import xxhash

        numbers, hashes = self.numbers, self.hashes
        out = []
        for w in words:
            n = numbers.get(w)
            if n is None:
                n = numbers[w] = len(hashes)
                hashes.append(xxhash.xxh64_intdigest(w))
            out.append(n)
        return out

    @staticmethod
    def parse(words: list[int], known: dict[int, int], node: int = 0) -> int:
        """Adds the phrases of `words` to `known`; returns the node at the end."""
        span, get = Parser.SPAN, known.get
        for w in words:
            key = node * span + w
            node = get(key, 0)
            if not node:
                known[key] = len(known) + 1
        return node

    def signatures(self, parses: list[list[int]]) -> list[np.ndarray]:
        """Smallest phrase hashes of each parse."""
        sizes = np.fromiter(map(len, parses), np.int64, len(parses))
        keys = np.fromiter((k for p in parses for k in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        parent = keys >> 32
        word = mix64(np.array(self.hashes, np.uint64)[keys & (self.SPAN - 1)]) if len(keys) else np.zeros(0, np.uint64)
        at = np.repeat(ends - sizes, sizes) + parent - 1  # place of the parent
        value = word * np.uint64(0x9E3779B97F4A7C15)
        done = parent == 0
        todo = np.flatnonzero(~done)
        while len(todo):
            ready = todo[done[at[todo]]]
            value[ready] = mix64(value[at[ready]]) + word[ready]
            done[ready] = True
            todo = todo[~done[todo]]
        low = (mix64(value) >> np.uint64(32)).astype(np.uint32)
        return [np.unique(low[a:b])[:KEPT] for a, b in zip(ends - sizes, ends, strict=True)]

    def pair(self, text: str, edited: str) -> tuple[list[int], list[int]]:
        """Parses of a text and its edited form; what they share at the start is parsed once."""
        a, b = self.number(tokens(text)), self.number(tokens(edited))
        same = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            same += 1
        known: dict[int, int] = {}
        node = self.parse(a[:same], known)
        other = dict(known)
        self.parse(a[same:], known, node)
        self.parse(b[same:], other, node)
        return list(known), list(other)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness estimated from two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:KEPT]
    return float(np.intersect1d(np.intersect1d(a, b, assume_unique=True), least, assume_unique=True).size / least.size)


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


KEY = np.dtype([("known", "?"), ("doc_id", "i8"), ("key", "i8")])


def firsts(keys: DataFrame, parts: int) -> np.ndarray:
    """The smallest row of each of about `parts` even ranges of `keys` (the columns of KEY): a row a range comes to the driver."""
    ranges = keys.repartitionByRange(parts, *keys.columns).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys.columns)).alias("first"))
    return np.unique(np.array([tuple(r.first) for r in ranges.select("first").collect()], KEY))


def fingerprint_neighbours(docs: DataFrame, parts: int | None = None, rows_per_part: int = 50_000) -> DataFrame:
    """Fingerprints of every text of `docs` (doc_id, text), of its edited form, and likeness to both and to the next.

    Documents go to ranges of doc_id, sorted, a range to a partition; the first of each range also goes to
    the range before, so that every document meets its successor without a global order in one task.
    Rows without a doc_id, and those of a doc_id that would fill a range, are dealt by their texts' hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_part)
    # Fewer than `parts` ids, and null.
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    often = [r.doc_id for r in counts.filter(F.col("doc_id").isNull() | (F.col("n") > max(1, n // parts))).select("doc_id").collect()]
    hash_, key = F.xxhash64("text"), F.lit(0).cast("long")
    if often:  # only then are texts read for the ranges
        key = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin([d for d in often if d is not None]), hash_).otherwise(key)
    keys = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), key.alias("key"))
    heads = firsts(keys, parts)
    parts = max(1, len(heads))
    shared = spark.sparkContext.broadcast(heads)  # a row a part

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        names = ["doc_id", "text", "hash", "part", "edge"]
        for batch in batches:
            own = np.empty(len(batch), KEY)
            own["known"], own["doc_id"], own["key"] = np.array(batch["doc_id"].is_valid()), np.array(batch["doc_id"].fill_null(0)), np.array(batch["key"])
            part = np.searchsorted(heads, own, "right") - 1
            first = heads[part] == own
            columns = [batch[c] for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.int32()), pa.array(np.zeros(len(part)), pa.int32())], names=names)
            if first.any():  # to the part before; the first of all to the last part
                some = [c.filter(pa.array(first)) for c in columns]
                yield pa.RecordBatch.from_arrays([*some, pa.array((part[first] - 1) % parts, pa.int32()), pa.array(np.ones(first.sum()), pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        held: list[tuple] = []  # (doc_id, text, next text)
        before = None  # (part, doc_id, text) that waits for its successor
        chars = 0  # of held texts

        def out() -> pa.RecordBatch:
            parser.start()
            parses, rows = [], []
            for doc_id, text, after in held:
                edited = edited_text(text, after)
                parses += parser.pair(text, edited)
                rows.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
            known: dict[int, int] = {}
            last = held[-1][2] if held else ""
            parser.parse(parser.number(tokens(last)), known)
            signs = parser.signatures([*parses, list(known)])
            own, changed = signs[0:-1:2], signs[1:-1:2]
            # The next document's signature: the row after it, unless the chain breaks there.
            following = []
            for i, (_, _, after) in enumerate(held):
                if i + 1 < len(held) and held[i + 1][1] is after:
                    following.append(own[i + 1])
                elif after is last:
                    following.append(signs[-1])
                else:
                    alone: dict[int, int] = {}
                    parser.parse(parser.number(tokens(after)), alone)
                    following.append(parser.signatures([list(alone)])[0])
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [to_hex(s) for s in own], [to_hex(s) for s in changed], [likeness(a, b) for a, b in zip(own, changed, strict=True)], [likeness(a, b) for a, b in zip(own, following, strict=True)]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FINGERPRINTED.split(", ")])

        for batch in batches:
            for doc_id, text, part, edge in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "part", "edge")), strict=True):
                if before is not None and before[0] == part:
                    held.append((*before[1:], text))
                    before = None
                if not edge:
                    before = (part, doc_id, text)
                chars += len(text)
                if len(held) >= 500 or (held and chars > 4_000_000):
                    chars = 0
                    yield out()
        if held:
            yield out()

    dealt = map_batches(docs.select("doc_id", "text", hash_.alias("hash"), key.alias("key")), deal, "doc_id long, text string, hash long, part int, edge int")
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "edge", "doc_id", "hash", "text")
    return map_batches(ordered, run, FINGERPRINTED)
