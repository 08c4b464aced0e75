"""Packing of tokenised documents by column generation for the cutting-stock problem.

Whole sequences of a document go by themselves; what is left of it is shorter than a sequence, so the
problem is a histogram of fewer than `capacity` numbers, however many documents there are. On it the
driver solves a linear program: patterns (lengths that fill a sequence exactly) and how often each is
used, so that as many tokens as possible stay uncut. It begins with the columns of a greedy filling; further
ones are priced by a knapsack over the lengths' prices (dynamic programming, exact sums), several a round, until
the prices prove that no more than a ten thousandth can be gained, or for at most as many pivots as there are
lengths and 1,000 more. Multiplicities are rounded down, then up where counts allow; exact sums are looked for
among what is left. Documents that no pattern takes are cut: they
lie one after the other in a stream that every `capacity` tokens begins a sequence, and its end goes to
sequences whose sizes are powers of two. So no sequence is padded, and few documents are cut.

Spark ranks the documents of each length in hashed buckets of bounded size, and each looks its place up by
its rank. No document passes through the driver.

Defined results: a null text is empty (the end id alone); texts of any length are cut into pieces; equal
lengths are ranked by their row of the written table, so ties depend on how the input is dealt, but not
the number of sequences or of cuts; repeated rows are packed once each; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import map_batches, materialise, ranked
from veilscan.llm.packing import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: How often a pattern is used: ((length, how many), ...), times.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


class Program:
    """max sum(capacity * x) over patterns with A x <= counts: revised simplex whose columns are priced on demand."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> None:
        self.lengths, self.counts, self.capacity = lengths, counts.astype(float), capacity
        m = len(lengths)
        self.inverse = np.eye(m)
        self.basis: list[dict[int, int] | None] = [None] * m  # patterns by index of length; None is the row's slack
        self.x = self.counts.copy()
        self.prices = np.zeros(m)
        # Of equal prices, common lengths first: tiny beside a price.
        self.rare = 1e-5 / np.maximum(self.counts, 1)
        # The prices of the best bound so far. A token's worth each is a dual solution: no pattern holds more than its tokens.
        self.centre, self.most = lengths.astype(float), float(lengths @ counts)

    def knapsack(self, prices: np.ndarray) -> list[dict[int, int]]:
        """Cheapest patterns at these prices that hold each length, cheapest first; the bound that the prices give is kept if it is the best."""
        size, lengths = self.capacity, self.lengths
        price = prices + self.rare
        cost, last = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        cost[0] = 0
        fit = np.searchsorted(lengths, np.arange(size + 1), "right")
        for c in range(1, size + 1):
            if k := fit[c]:
                total = cost[c - lengths[:k]] + price[:k]
                last[c] = j = int(total.argmin())
                cost[c] = total[j]
        # Raised so that no pattern costs less than it holds, prices are a dual solution.
        if 0 < cost[size] < np.inf and (bound := float(price @ self.counts) * size / cost[size]) < self.most:
            self.most, self.centre = bound, price * size / cost[size]
        held = price + cost[size - lengths]
        out, seen = [], set()
        for j in np.argsort(held, kind="stable")[:128].tolist():
            if held[j] == np.inf:
                break
            pattern, c = Counter([j]), size - int(lengths[j])
            while c:
                pattern[int(last[c])] += 1
                c -= int(lengths[last[c]])
            if (key := tuple(sorted(pattern.items()))) not in seen:
                seen.add(key)
                out.append(dict(pattern))
        return out

    def gain(self, pattern: dict[int, int]) -> float:
        return self.capacity - sum(self.prices[j] * n for j, n in pattern.items())

    def enter(self, pattern: dict[int, int] | None, gain: float, row: int = -1) -> None:
        """Brings a pattern, or the slack of `row`, into the basis."""
        column = self.inverse[:, row].copy() if pattern is None else sum(self.inverse[:, j] * n for j, n in pattern.items())
        up = np.flatnonzero(column > 1e-7)
        ratio = self.x[up] / column[up]
        tied = up[ratio <= ratio.min() * (1 + 1e-9) + 1e-9]
        out = int(tied[column[tied].argmax()])  # of ties the largest: small divisors spoil the inverse
        step = self.x[out] / column[out]
        line = self.inverse[out] / column[out]
        self.prices += gain * line
        touched, along = np.flatnonzero(np.abs(column) > 1e-12), np.flatnonzero(line)
        touched = touched[touched != out]
        self.inverse[np.ix_(touched, along)] -= np.outer(column[touched], line[along])
        self.inverse[out] = line
        self.x = np.maximum(self.x - step * column, 0)
        self.x[out] = step
        self.basis[out] = pattern

    def solve(self, first: list[dict[int, int]], most_pivots: int, least_share: float = 1e-4) -> None:
        """From the columns `first` on, until the solution is proven to be within `least_share` of the best, or `most_pivots`.

        Prices that a few columns have set are wild, so columns are priced between them and the prices
        of the best bound; where nothing gains there, nearer to the program's own.
        """
        self.pivots, pull = 0, 0.9
        self.improve(first)
        while self.pivots < most_pivots and self.value() < (1 - least_share) * self.most:
            columns = self.knapsack(pull * self.centre + (1 - pull) * np.maximum(self.prices, 0))
            if self.improve(columns):
                pull = min(0.9, pull + 0.1)
            elif pull == 0:
                return  # no column gains at the program's own prices
            else:
                pull = max(0.0, pull - 0.3)

    def improve(self, columns: list[dict[int, int]]) -> int:
        """Enters those that gain, then slacks with a negative price; the number of pivots."""
        before = self.pivots
        for pattern in columns:
            if (gain := self.gain(pattern)) > 1e-6 * self.capacity:
                self.enter(pattern, gain)
                self.pivots += 1
        for _ in range(len(self.lengths)):
            row = int(self.prices.argmin())
            if self.prices[row] > -1e-6 * self.capacity:
                break
            self.enter(None, -self.prices[row], row)
            self.pivots += 1
        return self.pivots - before

    def value(self) -> float:
        return self.capacity * sum(x for x, p in zip(self.x, self.basis, strict=True) if p is not None)

    def patterns(self) -> list[tuple[dict[int, int], float]]:
        """({length: how many}, times) of the patterns in use."""
        return [({int(self.lengths[j]): n for j, n in p.items()}, float(x)) for p, x in zip(self.basis, self.x, strict=True) if p is not None and x > 0]


def exact_fill(left: np.ndarray, gap: int) -> Counter | None:
    """Available lengths that sum to `gap`, longer ones first: reachable sums as the bits of a number."""
    reach, steps = 1, []
    mask = (1 << gap + 1) - 1
    for length in np.flatnonzero(left[: gap + 1])[::-1].tolist():
        n, part = min(int(left[length]), gap // length), 1
        while n:
            take = min(part, n)
            grown = reach | reach << take * length & mask
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            n -= take
            part *= 2
        if reach >> gap & 1:
            break
    if not reach >> gap & 1:
        return None
    found: Counter = Counter()
    for before, length, take in reversed(steps):
        if not before >> gap & 1:
            found[length] += take
            gap -= take * length
    return found


class Stock:
    """What is left of each length, and the patterns that have taken the rest."""

    def __init__(self, left: np.ndarray) -> None:
        self.left, self.made = left.copy(), []

    def fits(self, pattern: dict[int, int]) -> int:
        return min(int(self.left[k]) // n for k, n in pattern.items())

    def use(self, pattern: dict[int, int], times: int) -> None:
        if times > 0:
            self.made.append((tuple(sorted(pattern.items(), reverse=True)), times))
            for length, n in pattern.items():
                self.left[length] -= n * times

    def fill(self, capacity: int) -> None:
        """Exact sums of what is left, longest first."""
        for big in range(capacity - 1, 0, -1):
            while self.left[big]:
                self.left[big] -= 1
                rest = exact_fill(self.left, capacity - big)
                self.left[big] += 1
                if rest is None:
                    break
                rest[big] += 1
                self.use(rest, self.fits(rest))


def plan(counts: dict[int, int], capacity: int, more_pivots: int = 1_000) -> tuple[Plan, np.ndarray]:
    """(patterns that fill a sequence exactly with how often each is used, how many of each length no pattern takes)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    first = Stock(left)
    first.fill(capacity)  # columns to begin with
    stock = Stock(left)
    if first.made:
        lengths = np.flatnonzero(left)
        program = Program(lengths, left[lengths], capacity)
        program.solve([{int(np.searchsorted(lengths, k)): n for k, n in pattern} for pattern, _ in first.made], len(lengths) + more_pivots)
        found = sorted(program.patterns(), key=lambda p: -(p[1] % 1))
        for pattern, x in found:  # down
            stock.use(pattern, min(int(x + 1e-6), stock.fits(pattern)))
        for pattern, _ in found:  # and up, where counts allow
            stock.use(pattern, min(1, stock.fits(pattern)))
        stock.fill(capacity)
    left_of = lambda s: int(np.arange(capacity + 1) @ s.left)
    best = min(stock, first, key=left_of)  # rounding can cost small tables more than the program gains
    return best.made, best.left


def remainders(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of `capacity` tokens of every document (doc_id, text) and what is left of it, with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_json, end_id)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), own.batch(batch["text"]), strict=True):
                ids = ids.astype("<u4", copy=False)
                whole = len(ids) // capacity * capacity
                rest = ids[whole:].astype("<u2") if own.last.size <= 1 << 16 else ids[whole:]  # half the bytes where ids allow
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((doc_id, start, len(part), zlib.crc32(part), len(ids), rest.tobytes() if start == whole else None))
            kinds = (pa.int64(),) * 5 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, PIECES + ", ids binary").withColumn("row_id", F.monotonically_increasing_id())


def buckets_of(counts: dict[int, int], rows_per_bucket: int = 400, most_buckets: int = 100_000) -> Column:
    """A length's number of buckets: one for every `rows_per_bucket` rows, but no more than `most_buckets`."""
    of = {k: min(-(-n // rows_per_bucket), most_buckets) for k, n in counts.items()}
    return F.element_at(F.create_map(*(F.lit(x) for kn in of.items() for x in kn)), F.col("length").cast("int")) if of else F.lit(1)


class Places:
    """Where a document of a length and rank goes: a pattern's sequence, or the stream of those to be cut."""

    def __init__(self, made: Plan, left: np.ndarray, capacity: int) -> None:
        rows, used, sequence = [], Counter(), 0
        for pattern, times in made:
            offset = 0
            for length, each in pattern:
                rows.append((length, used[length], each, offset, sequence))
                used[length] += each * times
                offset += each * length
            sequence += times
        rows.sort()
        self.length, self.first, self.each, self.offset, self.sequence = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.used = np.array([used[k] for k in range(capacity + 1)], np.int64)
        # Longer documents first; what is left of the stream after whole sequences goes to powers of two.
        tokens = np.arange(capacity + 1) * left
        self.base = np.cumsum(tokens[::-1])[::-1] - tokens
        self.capacity, self.whole = capacity, int(tokens.sum()) // capacity
        rest = int(tokens.sum()) % capacity
        bits = [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1]
        self.ends = self.whole * capacity + np.cumsum([0, *bits])
        self.streams = sequence  # sequences of patterns come first

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, place in the stream or -1)."""
        over = rank - self.used[length]
        stream = np.where(over >= 0, self.base[length] + over * length, -1)
        if not len(self.length):
            return np.full(len(length), -1), np.full(len(length), -1), stream
        span = np.int64(1) << np.int64(44)
        at = np.maximum(np.searchsorted(self.length * span + self.first, length * span + rank, "right") - 1, 0)
        inside = rank - self.first[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length, stream

    def cut(self, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the piece, tokens, sequence, offset) of a piece of the stream."""
        start = 0
        while start < length:
            p = place + start
            if p < self.whole * self.capacity:
                k, offset = divmod(p, self.capacity)
                end = (k + 1) * self.capacity
            else:
                i = int(np.searchsorted(self.ends, p, "right"))
                k, offset, end = self.whole + i - 1, p - int(self.ends[i - 1]), int(self.ends[i])
            n = min(length - start, end - p)
            yield start, n, self.streams + k, offset
            start += n


def cut_pieces(rows: DataFrame, places: Places) -> DataFrame:
    """The pieces of those in the stream, from their ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['length']}").astype("<u4")
                for start, n, sequence, offset in places.cut(r["stream"], r["length"]):
                    out.append((r["doc_id"], r["start"] + start, n, zlib.crc32(ids[start : start + n]), r["doc_tokens"], sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 7], names=names)

    return map_batches(rows, run, ", ".join(f"{n} long" for n in names))


def pack(pieces: DataFrame, capacity: int = 2048, broadcast_rows: int = 500_000) -> DataFrame:
    """PIECES with sequence_id and offset, of a written table of `remainders`."""
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    short = pieces.filter(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer than `capacity` rows
    made, left = plan(counts, capacity)
    places = Places(made, left, capacity)

    @F.pandas_udf("sequence_id long, offset long, stream long")
    def look(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("sequence_id", "offset", "stream"), places.of(length.to_numpy(), rank.to_numpy()), strict=True)))

    placed = ranked(short.select(*own, "row_id"), "length", buckets_of(counts)).select(*own, "row_id", look("length", "rank").alias("place"))
    placed = materialise(placed.select(*own, "row_id", "place.*"))
    whole = pieces.filter(F.col("length") == capacity).select(*own, (-1 - F.col("row_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    stream = placed.filter("stream >= 0").select("row_id", "stream")
    stream = F.broadcast(stream) if int(left.sum()) <= broadcast_rows else stream  # 16 bytes a row
    cut = cut_pieces(short.select(*own, "row_id", "ids").join(stream, "row_id"), places)
    return placed.filter("stream < 0").select(*own, "sequence_id", "offset").unionByName(whole).unionByName(cut)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenise `docs` (doc_id, text) and pack them."""
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; the text goes to the tasks
        tokenizer_json = json.dumps(json.load(f))
    return pack(materialise(remainders(docs, tokenizer_json, capacity, end_id)), capacity)
