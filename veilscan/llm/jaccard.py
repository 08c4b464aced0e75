"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one class. Similar classes are put in groups (by the smallest
mixed shingle hash, cut into chunks of bounded size) and compared within; what that links is a
component, and a group's part in one component goes on as a group; those it has linked to nothing go on
with those akin to them (of about one size, and with two more least shingles in common), so that documents
which share a common line alone are asked one by one, not all at once. The matrix has, for every such
group, the union of its members' prefix shingles (which shingle occurs in which group) and a folded
histogram of the union of all their shingles. A query class meets the groups of other components that
share a prefix shingle and have a fitting size; the histograms bound its overlap with any member, and
only groups whose bound reaches the threshold are opened, where overlaps are counted exactly. Once a
family of near copies is one component, its members meet no more, so work doesn't grow with its square.

Prefixes follow one global order (shingles found often in some batch last, then by hash), so any two
sets that reach the threshold share a prefix shingle: no link is lost, whatever the order.

Shingles are 64-bit hashes of eight-byte steps of their words: two unlike shingles of a pair of documents
count as equal with a chance of about 1e-13, which is not verified against the words.

Defined results: null, empty and wordless texts have no shingles and link to nothing; whole texts are
read, however long; rows that share a doc_id are one node, which joins the groups of all its texts;
repeated rows give repeated results; a null doc_id is not linked; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import drop_scratch, groups, map_batches, materialise, mix64, texts
from veilscan.llm._words import word_hashes
from veilscan.llm.components import components

SETS = "doc_id long, n long, hi long, lo long, token long, times long"
INDEXED = "doc_id long, n long, mkey long, akin long, prefix array<struct<token:long,position:int>>, sketch binary"
# Of the orders in which a set's least shingle is taken: for its group, and two for those that are akin in it.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(batch: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, A-Z lower-cased; fewer words: one shingle."""
    values, counts = word_hashes([t.encode().lower() for t in batch])
    if not len(values):
        return [np.zeros(0, np.uint64) for _ in batch]
    rolled = np.zeros(len(values), np.uint64)
    for j in range(k):
        part = np.zeros(len(values), np.uint64)
        part[: max(0, len(values) - j)] = values[j:]
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + mix64(part + np.uint64(j + 1))
    rolled = mix64(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            short = np.uint64(n)
            for v in values[at : at + n]:
                short = mix64(np.array([short ^ v]))[0] + np.uint64(n)
            out.append(np.array([short]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Histogram of the tokens' leading bits in about a quarter as many bins; 255 means 255 or more."""
    bits = int(np.clip(np.ceil(np.log2(max(1, len(tokens) / 4))), 4, 13))
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def fold(histogram: np.ndarray, size: int) -> np.ndarray:
    """Histograms (the last axis) in `size` bins; a full bin counts as endless."""
    if histogram.size and histogram.max() == 255:
        histogram = np.where(histogram == 255, 1 << 40, histogram.astype(np.int64))
    return histogram.reshape(*histogram.shape[:-1], size, -1).sum(-1, dtype=np.int64) if histogram.shape[-1] > size else histogram


def overlap_bounds(a: list[bytes], b: list[bytes], at_once: int = 1 << 21) -> np.ndarray:
    """For each pair of histograms, a number not less than the overlap of any two sets that have them."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for i, j in np.unique(sizes, axis=0).tolist():
        alike = np.flatnonzero((sizes == (i, j)).all(1))
        step = max(1, at_once // max(i, j))
        for some in (alike[k : k + step] for k in range(0, len(alike), step)):
            x, y = (np.frombuffer(b"".join([z[n] for n in some]), np.uint8).reshape(len(some), -1) for z in (a, b))
            size = min(i, j)
            out[some] = np.minimum(fold(x, size), fold(y, size)).sum(1, dtype=np.int64)
    return out


def union_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["sub", "union", "n_least"])


def forest(ids: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, answers: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join what no other of them joins, between the sets that ask and those that answer."""
    sizes = np.array([len(x) for x in sets], np.int64)
    names, node = np.unique(ids, return_inverse=True)
    own = np.flatnonzero(answers)
    label = np.arange(len(names))
    edges: list[tuple[int, int]] = []
    if not len(own):
        return edges
    tokens = np.concatenate([sets[i] for i in own])
    holder = np.repeat(np.arange(len(own)), sizes[own])
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    for q in np.flatnonzero(asks):
        if (label[node[own]] == label[node[q]]).all():
            continue  # joined to every member already
        low, high = np.searchsorted(tokens, sets[q], "left"), np.searchsorted(tokens, sets[q], "right")
        count = high - low
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)
        both = np.bincount(holder[at], minlength=len(own))
        for m in np.flatnonzero(den * both >= num * (sizes[own] + sizes[q] - both)):
            a, b = label[node[q]], label[node[own[m]]]
            if a != b:
                label[label == b] = a
                edges.append((int(ids[q]), int(ids[own[m]])))
    return edges


# A group's members in one component are a part of it. Of those alone in theirs, the ones of about one size that are
# akin are a part together: most near copies are, documents that have no more than a line in common aren't.
PART = "xxhash64(gid, family IS NULL, family, IF(family IS NULL, akin, NULL), IF(family IS NULL, FLOOR(LOG2(n) * 2), NULL))"


class Join:
    """Settings of one join: k-word shingles, threshold num/den, and sizes that bound a task's memory."""

    def __init__(self, k: int = 5, num: int = 80, den: int = 100, group_tokens: int = 200_000, query_tokens: int = 400_000, broadcast_bytes: int = 16 << 20, heavy_most: int = 2_000_000, pivots: int = 4) -> None:
        self.k, self.num, self.den, self.pivots = k, num, den, pivots
        self.group_tokens, self.query_tokens, self.broadcast_bytes, self.heavy_most = group_tokens, query_tokens, broadcast_bytes, heavy_most

    def prefix_length(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def index_length(self, n: int) -> int:
        """The shorter prefix that suffices for the smaller set of a pair."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    # Pass 1: classes of equal sets, and shingles that are frequent somewhere.
    def measure(self, docs: DataFrame) -> DataFrame:
        import xxhash

        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = shingle_sets(texts(batch["text"]), k)
                digest = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                ends = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) if digest else np.zeros((0, 2), np.int64)
                token, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                often = times >= max(2, len(sets) // 500)
                token, times = token[often], times[often]
                m, extra = len(sets), len(token)
                cols = [
                    pa.concat_arrays([batch["doc_id"], pa.nulls(extra, pa.int64())]),
                    pa.array([*map(len, sets), *[None] * extra], pa.int64()),
                    pa.concat_arrays([pa.array(ends[:, 0]), pa.nulls(extra, pa.int64())]),
                    pa.concat_arrays([pa.array(ends[:, 1]), pa.nulls(extra, pa.int64())]),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(token.view(np.int64))]),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(times.astype(np.int64))]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "hi", "lo", "token", "times"])

        return materialise(map_batches(docs, run, SETS))

    def heavy(self, measured: DataFrame) -> np.ndarray:
        """The shingles to put last, sorted. Which ones they are changes the work, never the links; so their number is bounded."""
        counts = measured.filter("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
        # No sort of all: a histogram of at most a few thousand steps says from which count on few enough are left.
        counts = materialise(counts.withColumn("step", F.floor(F.log2("times") * 64).cast("int")))
        left, least = self.heavy_most, None
        for r in sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
            left -= r["n"]
            if left < 0:
                break
            least = r["step"]
        if least is None:
            return np.zeros(0, np.uint64)
        rows = counts.filter(F.col("step") >= least).select("token").toPandas()  # bounded: heavy_most
        return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))

    # Pass 2: prefixes, group keys and histograms.
    def index(self, docs: DataFrame, heavy: np.ndarray) -> DataFrame:
        k, length = self.k, self.prefix_length
        shared = docs.sparkSession.sparkContext.broadcast(heavy)  # bounded: heavy_most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            late = shared.value
            for batch in batches:
                cols: list[list] = [[] for _ in range(6)]
                for doc_id, s in zip(batch["doc_id"].to_pylist(), shingle_sets(texts(batch["text"]), k), strict=True):
                    if not len(s):
                        continue
                    p = length(len(s))
                    if len(late):
                        is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                        first = np.concatenate([s[~is_late], s[is_late]])[:p]
                    else:
                        first = s[:p]
                    key, *other = (mix64(s ^ np.uint64(seed)).min().view(np.int64) for seed in SEEDS)
                    for c, x in zip(cols, (doc_id, len(s), int(key), int(other[0] ^ other[1]), first.view(np.int64), sketch(s).tobytes()), strict=True):
                        c.append(x)
                flat = np.concatenate(cols[4]) if cols[4] else np.zeros(0, np.int64)
                sizes = np.array([len(x) for x in cols[4]], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                position = np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)
                entry = pa.StructArray.from_arrays([pa.array(flat, pa.int64()), pa.array(position, pa.int32())], names=["token", "position"])
                arrays = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.ListArray.from_arrays(pa.array(offsets), entry), pa.array(cols[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "mkey", "akin", "prefix", "sketch"])

        return map_batches(docs, run, INDEXED)

    def small(self, df: DataFrame) -> DataFrame:
        """`df`, numbers only, written and broadcast where it is counted to be small enough, else left to an ordinary join."""
        df = materialise(df)
        return F.broadcast(df) if df.count() * 8 * len(df.columns) <= self.broadcast_bytes else df

    def grouped(self, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(`indexed` with gid instead of mkey, pivots (doc_id, gid)).

        Classes of one mkey are a group. A large group is cut into chunks, and each chunk also gets a few
        classes of the whole group (pivots), so that chunks of one family of near copies are linked by them.
        """
        hot = indexed.groupBy("mkey").agg(F.ceil(F.sum("n") / self.group_tokens).alias("chunks")).filter("chunks > 1")
        hot = self.small(hot)
        chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
        dealt = indexed.join(hot, "mkey", "left").withColumn("gid", F.when(F.col("chunks").isNull(), F.col("mkey")).otherwise(F.xxhash64("mkey", chunk)))
        dealt = materialise(dealt)
        cut = dealt.filter("chunks IS NOT NULL").select("mkey", "gid", "doc_id")
        hashed = F.xxhash64(F.lit(1), "doc_id")
        pivots = cut.groupBy("mkey", F.pmod(hashed, F.lit(self.pivots)).alias("draw")).agg(F.min(F.struct(hashed.alias("hash"), "doc_id")).alias("least")).select("mkey", "least.doc_id")
        return dealt.drop("mkey", "chunks"), cut.select("mkey", "gid").distinct().join(pivots, "mkey").select("doc_id", "gid")

    def candidates(self, indexed: DataFrame) -> DataFrame:
        """(doc_id, sub): parts of groups, and the classes that ask them, which cover all pairs of classes that share a prefix shingle.

        Shingles are met part by part, never class by class. Parts of one group or of one component are left
        out: they have been compared, or need no more links. Of two parts, the one of fewer members asks.
        """
        index_length = F.col("n") - F.ceil(F.lit(2 * self.num) * F.col("n") / F.lit(self.num + self.den)) + 1
        rows = indexed.select("n", "gid", "comp", "family", "sub", (index_length + 1).alias("short"), F.explode("prefix").alias("entry"))
        rows = rows.select(F.col("entry.token").alias("token"), "n", "gid", "comp", "family", "sub", F.when(F.col("entry.position") < F.col("short"), F.col("n")).alias("short_n"))
        # Most shingles are in one component: these go first, by partial sums. What stays is small, and written.
        shared = materialise(rows.groupBy("token").agg((F.min("comp") != F.max("comp")).alias("apart")).filter("apart").select("token"))
        held = rows.drop("comp").join(shared, "token", "left_semi").groupBy("token", "gid", "family", "sub")
        held = held.agg(F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.min("short_n").alias("short_least"), F.max("short_n").alias("short_most"))
        held = materialise(held)
        other = held.filter("short_least IS NOT NULL").select("token", *(F.col(c).alias(f"other_{c}") for c in ("gid", "family", "sub", "short_least", "short_most")))
        # The smaller of two similar sets shares a shingle of its shorter prefix.
        fits = (F.col("gid") != F.col("other_gid")) & F.coalesce(F.col("family") != F.col("other_family"), F.lit(True))
        fits &= (F.col("other_short_least") <= F.col("n_most")) & (F.col("other_short_most") * self.den >= F.col("n_least") * self.num)
        met = held.join(other, "token").filter(fits)
        met = materialise(met.select(F.least("sub", "other_sub").alias("one"), F.greatest("sub", "other_sub").alias("two")).distinct())
        sizes = indexed.groupBy("sub").agg(F.count(F.lit(1)).alias("members"))
        for c in ("one", "two"):
            met = met.join(sizes.select(F.col("sub").alias(c), F.col("members").alias(f"in_{c}")), c)
        fewer = F.col("in_one") <= F.col("in_two")
        met = met.select(F.when(fewer, F.col("one")).otherwise(F.col("two")).alias("asking"), F.when(fewer, F.col("two")).otherwise(F.col("one")).alias("sub"))
        return met.join(indexed.select("doc_id", F.col("sub").alias("asking")), "asking").select("doc_id", "sub")

    def qualify(self, met: DataFrame, indexed: DataFrame) -> DataFrame:
        """The candidate pairs whose histograms don't rule the threshold out."""
        num, den = self.num, self.den
        members = indexed.select("sub", "n", "sketch")

        def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for group in groups(batches, "sub"):
                found = group["sketch"].to_pylist()
                if len(found) > 1:
                    parts = [np.frombuffer(x, np.uint8) for x in found]
                    size = min(map(len, parts))
                    found = [np.minimum(np.max([fold(x, size) for x in parts], axis=0), 255).astype(np.uint8).tobytes()]
                out.append((group["sub"][0].as_py(), found[0], int(np.asarray(group["n"]).min())))
                if len(out) == 1000:
                    yield union_rows(out)
                    out = []
            yield union_rows(out)

        asked = members.join(self.small(met.select("sub").distinct()), "sub", "left_semi")
        unions = map_batches(asked.repartition("sub").sortWithinPartitions("sub"), union, "sub long, union binary, n_least long")

        @F.pandas_udf("boolean")
        def fits(n: pd.Series, a: pd.Series, n_least: pd.Series, b: pd.Series) -> pd.Series:
            # Overlap needed with the smallest member: num/den of the union of both.
            return pd.Series(overlap_bounds(a.tolist(), b.tolist()) * (num + den) >= num * (n.to_numpy() + n_least.to_numpy()))

        pairs = indexed.select("doc_id", "n", "sketch").join(self.small(met), "doc_id").join(unions, "sub")
        return pairs.filter(fits("n", "sketch", "n_least", "union")).select("doc_id", "sub").distinct()

    def links(self, docs: DataFrame, rows: DataFrame) -> DataFrame:
        """Links (a, b) that join what no other link of the task joins, counted exactly.

        rows: (doc_id, gid, salt, asks, answers); in every (gid, salt) those that ask meet those that answer.
        """
        k, num, den = self.k, self.num, self.den

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [s.tobytes() for s in shingle_sets(texts(batch["text"]), k)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], names=["doc_id", "tokens"])

        rows = self.small(rows)
        held = map_batches(docs.join(self.small(rows.select("doc_id").distinct()), "doc_id", "left_semi"), sets, "doc_id long, tokens binary")

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups(batches, "gid", "salt"):
                edges = forest(np.asarray(group["doc_id"]), [np.frombuffer(x, np.uint64) for x in group["tokens"].to_pylist()], group["asks"].to_numpy(False), group["answers"].to_numpy(False), num, den)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])

        dealt = held.join(rows, "doc_id").repartition("gid", "salt").sortWithinPartitions("gid", "salt")
        return materialise(map_batches(dealt, link, "a long, b long"))

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

        Groups are compared within first; what that joins is a component, and only parts of groups of
        different components meet afterwards.
        """
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        measured = self.measure(docs)
        rows = measured.filter("token IS NULL")
        # Written, so that the join stands on its own exchanges and a large class can be split.
        classes = materialise(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
        own = materialise(rows.join(classes, ["hi", "lo"], "left").select("doc_id", "n", "rep"))
        reps = self.small(own.filter("doc_id = rep").select("doc_id").distinct())
        indexed, pivots = self.grouped(self.index(docs, self.heavy(measured)).join(reps, "doc_id", "left_semi"))
        members = indexed.select("doc_id", "gid").distinct()  # repeated rows once
        several = members.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("gid")
        within = members.join(several, "gid", "left_semi").unionByName(pivots).distinct()
        yes, no = F.lit(True), F.lit(False)
        near = self.links(docs, within.select("doc_id", "gid", F.lit(0).alias("salt"), yes.alias("asks"), yes.alias("answers")))
        twice = own.filter("rep IS NOT NULL").select("doc_id", "rep").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("doc_id")
        # A doc_id with several texts joins their classes.
        same_id = own.filter("doc_id <> rep").join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        first = self.small(components(near.unionByName(same_id)).withColumnsRenamed({"component": "comp"}))

        # The parts are found on numbers alone; prefixes and histograms meet them in one join.
        comps = members.join(first, members["doc_id"] == first["id"], "left").select("doc_id", "gid", F.coalesce("comp", "doc_id").alias("comp"))
        sizes = comps.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("gid", "comp", F.col("comp").alias("family"))
        comps = self.small(comps.join(self.small(sizes), ["gid", "comp"], "left").select("doc_id", "gid", "comp", "family"))
        ungrouped, indexed = indexed, materialise(indexed.join(comps, ["doc_id", "gid"]).withColumn("sub", F.expr(PART)))
        drop_scratch(ungrouped)  # prefixes and histograms, as large as nearly half the texts, are held once
        parts = indexed.select("doc_id", "n", "sub")
        met = materialise(self.candidates(indexed))
        opened = materialise(self.qualify(met, indexed))
        salts = opened.join(parts.select("doc_id", "n"), "doc_id").groupBy("sub").agg(F.ceil(F.sum("n") / self.query_tokens).cast("int").alias("salts"))
        salts = self.small(salts)
        asking = opened.join(salts, "sub").select("doc_id", F.col("sub").alias("gid"), F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), yes.alias("asks"), no.alias("answers"))
        answering = parts.join(salts, "sub").select("doc_id", F.col("sub").alias("gid"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), no.alias("asks"), yes.alias("answers"))
        far = self.links(docs, asking.unionByName(answering))
        drop_scratch(indexed)
        far = far.join(first.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(first.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
        second = components(far.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        found = own.join(first, own["rep"] == first["id"], "left").select("doc_id", "n", F.coalesce("comp", "rep", "doc_id").alias("comp"))
        out = found.join(second, found["comp"] == second["id"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "comp").alias("component_id"))
