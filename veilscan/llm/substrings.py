"""Removal of long repeats across documents, by recompression.

Rounds name runs and then pairs of neighbouring symbols, words first. A name is a hash of what it
stands for, so it is the same in every document without any exchange; whether a pair is named
depends on the two symbols alone (one of each kind, drawn by hash and round). So equal passages get
equal symbols in their interior. Every symbol keeps the stretch of words that its making looked at.

Each window of `window` words picks, among the symbols whose stretch lies inside it, the first of the
latest round: equal windows pick equal symbols. Only windows whose symbol occurs in different texts
can repeat; these are matched against the smallest doc_id that holds them, by two hashes that come
from independent hashes of their words (64 and 32 bits).

Texts with equal words are one class, kept by its smallest doc_id; other rows of a class are removed
whole if they have a window at all. Only that document's symbols are dealt out, so a group of copies
however large is one row there. A symbol or window that many texts share is met by partial sums and
by joins whose large keys Spark may split.

Defined results: null, empty and wordless texts have 0 words and keep the empty text; texts of fewer
words than the window lose none; whole texts are read, but a document's windows that may repeat are gathered in one
row (24 bytes each), so one of over 80 million such words isn't for this operator; ties (one window in several
documents) go to the smallest doc_id, which keeps it; repeated rows of one doc_id are no copies of each other; a null
doc_id is smaller than none and is kept whole; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import map_batches, materialise, mix64, texts
from veilscan.llm._words import word_hashes

PARSED = "doc_id long, n_words long, hi long, lo long, sha binary, anchors array<struct<symbol:long,first:int,last:int>>"
ROUNDS = 14
ODD = np.uint64(0x9E3779B97F4A7C15)


class Level:
    """Symbols made in one round, in order: name, and the stretch [low, high) of words they depend on."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.low, self.high = name, low, high


def parse(words: np.ndarray, fence: np.ndarray, window: int) -> list[Level]:
    """The symbols of every round that fit a window. fence: places that belong to no document; they never merge."""
    place = np.arange(len(words), dtype=np.int64)
    name, low, high, wall = words.copy(), place, place + 1, fence
    levels = [Level(name[~wall], low[~wall], high[~wall])]

    def keep(made: np.ndarray) -> None:
        fits = made & (high - low <= window)
        levels.append(Level(name[fits], low[fits], high[fits]))  # an empty round too: rounds keep their numbers

    # Runs of one word. That a run ends is seen at the words around it.
    start = np.ones(len(name), bool)
    start[1:] = (name[1:] != name[:-1]) | wall[1:] | wall[:-1]
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(name)) - 1
    length = last - first + 1
    run = mix64(name[first] * ODD + length.astype(np.uint64))
    made = (length > 1) & ~wall[first]
    wide_low, wide_high = np.maximum(first - 1, 0), np.minimum(last + 2, len(name))
    edge = wall[first]
    name = np.where(made, run, name[first])
    low, high = np.where(edge, low[first], low[wide_low]), np.where(edge, high[last], high[wide_high - 1])
    wall = edge
    keep(made)
    for turn in range(1, ROUNDS):
        left = (mix64(name ^ np.uint64((int(ODD) * (2 * turn + 1)) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool) & ~wall
        right = ~left & ~wall
        pair = np.zeros(len(name), bool)  # at the pair's first symbol
        pair[:-1] = left[:-1] & right[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # What stays single has looked at the neighbour that it might have merged with.
        new_low, new_high = low.copy(), high.copy()
        single_left, single_right = left & ~pair, right & ~second
        new_high[:-1] = np.where(single_left[:-1] | pair[:-1], np.maximum(high[:-1], high[1:]), high[:-1])
        new_low[1:] = np.where(single_right[1:], np.minimum(low[1:], low[:-1]), low[1:])
        new_name = name.copy()
        new_name[:-1] = np.where(pair[:-1], mix64(mix64(name[:-1] + np.uint64(turn)) * ODD + name[1:]), name[:-1])
        stay = ~second
        name, low, high, wall, made = new_name[stay], new_low[stay], new_high[stay], wall[stay], pair[stay]
        keep(made)
        if (high[1:] - low[:-1] > window).all():
            break  # stretches only grow: no later symbol fits
    return levels


def anchors(levels: list[Level], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, and a number that tells its place) for each window start."""
    symbol, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for n in range(len(levels) - 1, -1, -1):
        level = levels[n]
        if not len(level.low):
            continue
        p = starts[todo]
        at = np.searchsorted(level.low, p, "left")
        inside = np.minimum(at, len(level.low) - 1)
        fits = (at < len(level.low)) & (level.high[inside] <= p + window)
        symbol[todo[fits]] = level.name[inside[fits]] + np.uint64(n)
        place[todo[fits]] = level.low[inside[fits]] * 64 + n
        todo = todo[~fits]
        if not len(todo):
            break
    return symbol, place


def fenced(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents with one fence around each, the fence's mask, and where each document starts."""
    begin = np.cumsum(counts + 1) - counts
    words = np.zeros(int(counts.sum()) + len(counts) + 1, np.uint64)
    fence = np.ones(len(words), bool)
    at = np.arange(len(values)) + np.repeat(begin - np.cumsum(counts) + counts, counts)
    words[at] = values
    fence[at] = False
    return words, fence, begin


def window_hashes(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A hash of the `window` words from each place on, by doubling."""
    size, block = 1, mix64(words + np.uint64(seed))
    out, done = None, 0
    rest = window
    while rest:
        if rest & 1:
            part = np.zeros_like(block)
            part[: max(0, len(block) - done)] = block[done:]
            out = part if out is None else mix64(out * ODD + part)
            done += size
        rest >>= 1
        if rest:
            part = np.zeros_like(block)
            part[: max(0, len(block) - size)] = block[size:]
            block = mix64(block * ODD + part + np.uint64(size))
            size *= 2
    return out


def both_hashes(raw: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of the window at each place, where each text starts, and its words."""
    values, counts = word_hashes(raw)
    words, _, begin = fenced(values, counts)
    h = window_hashes(words, window, 1)
    words = fenced(word_hashes(raw, 1)[0], counts)[0]
    return h, window_hashes(words, window, 2).astype(np.uint32).view(np.int32), begin, counts


def pairs(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Both hashes of each window as one value."""
    both = np.empty((len(h), 2), np.uint64)
    both[:, 0], both[:, 1] = h, check.view(np.uint32)
    return both.view("V16").ravel()


def joined(raw: bytes) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(raw.split())


class Repeats:
    def __init__(self, window: int = 50) -> None:
        self.window = window

    def parsed(self, docs: DataFrame) -> DataFrame:
        """Words, class key, digest of the whole text and picked symbols of every row."""
        import xxhash

        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [t.encode() for t in texts(batch["text"])]
                whole = [joined(t) for t in raw]
                values, counts = word_hashes(raw)
                words, fence, begin = fenced(values, counts)
                windows = np.maximum(counts - window + 1, 0)
                ends = np.cumsum(windows)
                starts = np.arange(int(windows.sum())) + np.repeat(begin - ends + windows, windows)
                owner = np.repeat(np.arange(len(counts)), windows)
                symbol, place = anchors(parse(words, fence, window), starts, window)
                new = np.ones(len(starts), bool)
                new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(starts)) - 1
                inside = starts - begin[owner] if len(starts) else starts
                entry = pa.StructArray.from_arrays([pa.array(symbol[first].view(np.int64)), pa.array(inside[first], pa.int32()), pa.array(inside[last] if len(first) else inside, pa.int32())], names=["symbol", "first", "last"])
                offsets = np.searchsorted(owner[first], np.arange(len(counts) + 1)).astype(np.int32)
                key = np.frombuffer(b"".join(xxhash.xxh128_digest(w) for w in whole), np.int64).reshape(-1, 2)
                sha = [hashlib.sha256(w).digest() for w in whole]
                arrays = [batch["doc_id"], pa.array(counts), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), entry)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "hi", "lo", "sha", "anchors"])

        return map_batches(docs, run, PARSED)

    def windows(self, candidates: DataFrame) -> DataFrame:
        """(h, check, doc_id): hashes of the windows in each candidate's ranges, each once a document."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, check, begin, counts = both_hashes([t.encode() for t in texts(batch["text"])], window)
                for i, (doc_id, ranges) in enumerate(zip(batch["doc_id"].to_pylist(), batch["ranges"].to_pylist(), strict=True)):
                    at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges])
                    at = at[at <= counts[i] - window] + begin[i]  # another text of this doc_id may be longer
                    _, once = np.unique(h[at], return_index=True)
                    at = at[once]
                    same = [pa.array(h[at].view(np.int64)), pa.array(check[at]), pa.array(np.full(len(at), doc_id, np.int64))]
                    yield pa.RecordBatch.from_arrays(same, names=["h", "check", "doc_id"])

        return map_batches(candidates, run, "h long, check int, doc_id long")

    def kept(self, candidates: DataFrame) -> DataFrame:
        """(doc_id, hi, kept text, n_removed) of candidates, given the hashes of their repeated windows."""
        import xxhash

        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [t.encode() for t in texts(batch["text"])]
                h, check, begin, counts = both_hashes(raw, window)
                cols: list[list] = [[], [], [], []]
                for i, (doc_id, gone) in enumerate(zip(batch["doc_id"].to_pylist(), batch["gone"].to_pylist(), strict=True)):
                    own = slice(begin[i], begin[i] + max(0, counts[i] - window + 1))
                    hit = np.isin(pairs(h[own], check[own]), pairs(np.array([g["h"] for g in gone], np.int64).view(np.uint64), np.array([g["check"] for g in gone], np.int32)))
                    change = np.zeros(counts[i] + 1, np.int64)
                    change[: len(hit)] += hit
                    change[window : window + len(hit)] -= hit
                    stay = np.cumsum(change)[:-1] == 0
                    left = b" ".join([w for w, s in zip(raw[i].split(), stay.tolist(), strict=True) if s])
                    hi = int(np.frombuffer(xxhash.xxh128_digest(joined(raw[i])), np.int64)[0])
                    for c, x in zip(cols, (doc_id, hi, left.decode(), int(counts[i] - stay.sum())), strict=True):
                        c.append(x)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "hi", "kept", "n_removed"])

        return map_batches(candidates, run, "doc_id long, hi long, kept string, n_removed long")

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of every row of `docs` (doc_id, text).

        Whether a window repeats depends on its words and doc_id alone, so several texts of one doc_id
        may share ranges and hashes; only their results are told apart, by the class key.
        """
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        parsed = materialise(self.parsed(docs))
        # Written, so that the join stands on its own exchanges and a large class can be split.
        classes = materialise(parsed.filter("n_words > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
        rows = materialise(parsed.select("doc_id", "n_words", "hi", "lo", "sha").join(classes, ["hi", "lo"], "left"))
        # Representatives alone can share a window with a smaller doc_id of another text.
        heads = rows.filter("doc_id = rep").select("doc_id", "hi", "lo").distinct()
        picked = materialise(parsed.select("doc_id", "hi", "lo", "anchors").join(heads, ["doc_id", "hi", "lo"], "left_semi").select("doc_id", "hi", F.inline("anchors")))
        # Written, so that the join stands on its own exchanges and a symbol of many texts can be split.
        shared = materialise(picked.groupBy("symbol").agg(F.min("hi").alias("least"), F.max("hi").alias("most")).filter("least <> most").select("symbol"))
        hits = materialise(picked.join(shared, "symbol").groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("ranges")))
        candidates = materialise(docs.join(hits, "doc_id"))
        found = materialise(self.windows(candidates))
        least = materialise(found.groupBy("h", "check").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
        gone = materialise(found.join(least, ["h", "check"]).filter("least < doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("h", "check")).alias("gone")))
        cut = self.kept(candidates.drop("ranges").join(gone, "doc_id")).select("doc_id", "hi", "n_removed", F.sha2("kept", 256).alias("cut_sha")).distinct()
        out = rows.join(cut, ["doc_id", "hi"], "left")
        copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= self.window)
        removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        sha = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha"))))
        return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))
