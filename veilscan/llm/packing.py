"""Best-fit packing of tokenised documents by exact-complement hashing.

Lengths are at most the sequence length, so the whole packing problem is a histogram of at most
that many numbers, however many documents there are. The driver solves it on the histogram
(single, pair and triple sums that exactly fill a gap are consumed under availability counts, the
rest goes best-fit), which gives a bounded list of patterns with multiplicities. Spark then numbers
the pieces of every length and looks up each number's place; no piece passes through the driver.

Defined results: a null text is empty (one piece that holds only the end id); texts of any length are cut
into pieces; ties (pieces of one length) are numbered by bucket, doc_id and piece, which decides where each goes but
not how many sequences there are; an empty table gives no rows; repeated rows are packed once each; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import string
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm._common import WordIds, map_batches, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# The last letter of the scripts whose words may be encoded without what stands beside them: up to
# Cyrillic, every Unicode version agrees on what a letter is.
LAST_LETTER = "\u052f"


def only_letters(word: str) -> bool:
    """Whether the word is letters and stays so once the tokenizer has composed and lower-cased it, as all of Latin-1 do."""
    return word.isalpha() and (word.isascii() or (last := max(word)) <= "\xff" or last <= LAST_LETTER and unicodedata.normalize("NFC", word).lower().isalpha())


def kind_of(word: bytes) -> int:
    """2: lower-case letters of Latin-1, 1: other letters, 0: other words."""
    if word.isalpha() and word.islower():  # bytes: ASCII letters only
        return 2
    text = word.decode()
    return 0 if not only_letters(text) else 2 if max(text) <= "\xff" and text == text.lower() else 1


# Words of such letters, for Arrow; ASCII marks after them are a piece of their own.
LETTERS = "^[" + "".join(c for c in map(chr, range(ord(LAST_LETTER) + 1)) if only_letters(c)) + "]+$"
MARKS = string.punctuation


class Encoder:
    """Token ids of texts, word by word, with a bounded memory of words.

    No token of this kind of vocabulary spans white space, so a text's ids are its words' ids in turn.
    Letters and the ASCII marks after them are pieces of their own too, and letters are lower-cased, so
    words that differ in these only are encoded once. That holds for words which stay letters when they are
    normalised (`only_letters`); any other word is encoded whole. Arrow tells a batch's words apart, so each
    is looked up once a batch. When the memory is full, the words used most stay.
    """

    def __init__(self, tokenizer_json: str, end_id: int = 0, limit: int = 300_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # The same model for lower-case letters of Latin-1, on which the normalizer and the expression of pieces do nothing.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that only end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end_id, self.limit = end_id, limit
        self._reset()

    def _reset(self) -> None:
        self.words = WordIds()
        self.words[b" end"] = 0  # no word has a space: this one stands for the end id
        self.words[b""] = 1  # no marks after a word
        self.ids, self.total = np.array([self.end_id], np.uint32), 1
        self.start, self.size, self.uses = np.zeros(2, np.int64), np.array([1, 0], np.int64), np.zeros(2, np.int64)

    def _forget(self) -> None:
        """Half of the words stay, those used most, and no more than half of the ids."""
        order = np.argsort(-self.uses, kind="stable")[: self.limit // 2]
        order = order[np.cumsum(self.size[order]) <= 4 * self.limit]
        keep = np.union1d(order, [0, 1])
        names, known, start, size, uses = list(self.words), self.ids, self.start[keep], self.size[keep], self.uses[keep]
        self._reset()
        self.words.update(zip([names[i] for i in keep.tolist()], range(len(keep)), strict=True))
        after = np.cumsum(size)
        self.ids, self.total = spans(known, start, size), int(after[-1])
        self.start, self.size, self.uses = after - size, size, uses // 2

    def _encode(self, words: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, ids of each). Words of letters go many to a call, told apart by the ids that end one."""
        if kind:
            tokenizer = self.plain if kind == 2 else self.tokenizer
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self) -> None:
        """Ids of words met for the first time."""
        fresh, self.words.fresh = self.words.fresh, []
        kinds = np.fromiter(map(kind_of, fresh), np.int8, len(fresh))
        start, size, parts = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), [self.ids[: self.total]]
        for kind in range(3):
            which = np.flatnonzero(kinds == kind)
            for some in np.array_split(which, -(-len(which) // 4000)) if len(which) else ():
                ids, n = self._encode([fresh[i] for i in some.tolist()], kind)
                start[some], size[some] = self.total + np.cumsum(n) - n, n
                parts.append(ids)
                self.total += len(ids)
        self.ids = np.concatenate(parts)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])

    def _known(self, words: pa.Array, uses: np.ndarray) -> np.ndarray:
        """Each word's number in the memory, which notes how often it is used."""
        own = words.dictionary_encode()
        names = own.dictionary.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_numpy(False)
        known = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))
        if self.words.fresh:
            self._learn()
        at = own.indices.to_numpy()
        self.uses[known] += np.bincount(at, uses, len(known)).astype(np.int64)
        return known[at]

    def _pieces(self, words: pa.Array, uses: np.ndarray) -> np.ndarray:
        """(letters, marks after them) of each word, or (the word, nothing), by their numbers in the memory."""
        bare = pc.ascii_rtrim(words, characters=MARKS)
        letters = pc.match_substring_regex(bare, LETTERS)
        heads = pc.if_else(letters, pc.utf8_lower(bare), words)
        pieces = np.ones((len(words), 2), np.int64)
        marked = np.flatnonzero(letters.to_numpy(False) & (pc.binary_length(bare).to_numpy() < pc.binary_length(words).to_numpy()))
        pieces[:, 0] = self._known(heads, uses)
        if len(marked):
            some = pa.array(marked)
            tails = [w[n:] for w, n in zip(words.take(some).to_numpy(False), pc.utf8_length(bare.take(some)).to_numpy(), strict=True)]
            pieces[marked, 1] = self._known(pa.array(tails, words.type), uses[marked])
        return pieces

    def batch(self, batch: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id after them."""
        if len(self.words) > self.limit or self.total > 8 * self.limit:
            self._forget()
        if not len(batch):
            return []
        split = pc.ascii_split_whitespace(batch if isinstance(batch, pa.Array) else pa.array(batch, pa.string()))
        words = split.flatten().dictionary_encode()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())
        at = np.insert(words.indices.to_numpy(), ends, len(words.dictionary))
        pieces = np.concatenate([self._pieces(words.dictionary, np.bincount(at)[:-1]), [[0, 1]]])  # the end id stands last
        # The ids of every word of the batch, a word's one piece after the other; then those of the texts.
        n = self.size[pieces]
        ids = spans(self.ids, self.start[pieces].ravel(), n.ravel())
        n = n.sum(1)
        found = spans(ids, (np.cumsum(n) - n)[at], n[at])
        return np.split(found, np.cumsum(n[at])[ends + np.arange(len(ends))])[:-1]


def spans(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each span, one after the other."""
    after = np.cumsum(size)
    return values[np.repeat(start - after + size, size) + np.arange(after[-1])]


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_json: str, end_id: int) -> Encoder:
    """A Python worker's encoder: its memory of words serves the worker's next tasks too."""
    return Encoder(tokenizer_json, end_id)


def token_pieces(docs: DataFrame, tokenizer_json: str, sequence_length: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of at most `sequence_length` tokens of every document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_json, end_id)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), own.batch(batch["text"]), strict=True):
                for piece, start in enumerate(range(0, len(ids), sequence_length)):
                    part = ids[start : start + sequence_length]
                    out.append((doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def _exact(left: np.ndarray, big: int, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to `gap`, beside one of length `big`."""
    left[big] -= 1
    try:
        if left[gap] > 0:
            return (gap,)
        have = left[: gap + 1] > 0
        have[0] = False
        a = np.flatnonzero(have & have[::-1])
        a = a[(2 * a > gap) | ((2 * a == gap) & (left[a] > 1))]
        if len(a):
            return int(a[-1]), gap - int(a[-1])
        lengths = np.flatnonzero(have)
        for a in lengths[::-1]:
            rest = gap - int(a)
            if 3 * a < gap:
                break
            if rest < 2:
                continue
            b = np.flatnonzero(have[: rest + 1] & have[: rest + 1][::-1])
            for x in b[(2 * b >= rest) & (b <= a)][::-1]:
                combo = (int(a), int(x), rest - int(x))
                if all(left[k] >= n for k, n in Counter(combo).items()):
                    return combo
        return None
    finally:
        left[big] += 1


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many), ...) with the number of sequences that follow each.

    Every step uses up at least one length of a pattern, so the list stays within a few times `capacity`.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if left[capacity]:
        patterns.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    for big in range(capacity - 1, capacity // 4, -1):
        while left[big] > 0 and (combo := _exact(left, big, capacity - big)):
            need = Counter((big, *combo))
            times = min(int(left[k]) // n for k, n in need.items())
            for k, n in need.items():
                left[k] -= n * times
            patterns.append((tuple(sorted(need.items(), reverse=True)), times))
    # Best fit, longest first, on sequences that are alike: gap -> [pattern, how many sequences].
    open_: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = min(n, capacity // length)
                times = n // each
                open_.setdefault(capacity - each * length, []).append([((length, each),), times])
                n -= each * times
                continue
            row = open_[gap][-1]
            each = min(n, gap // length)
            times = min(row[1], n // each)
            row[1] -= times
            pattern = (*row[0], (length, each))
            if not row[1]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            open_.setdefault(gap - each * length, []).append([pattern, times])
            n -= each * times
    patterns.extend((row[0], row[1]) for rows in open_.values() for row in rows)
    return patterns


def _segments(patterns: list) -> dict[str, np.ndarray]:
    """For each length, which of its numbers go where: sorted by (length, first number)."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, offset, sequence))
            used[length] += each * times
            offset += each * length
        sequence += times
    rows.sort()
    names = ("length", "first", "each", "offset", "sequence")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_bucket: int = 20_000) -> DataFrame:
    """`pieces` (any columns with doc_id, piece, length) with sequence_id and gapless offset.

    `pieces` is read several times: give a written table. Numbering within a length goes by hashed
    buckets with prefix sums, so a length that a third of all pieces share isn't one task.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = _segments(plan_packing(counts, capacity))
    buckets = max(8, sum(counts.values()) // rows_per_bucket)
    key = ["length", "bucket_"]
    dealt = pieces.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    order = Window.partitionBy(*key).orderBy("doc_id", "piece")
    numbered = dealt.withColumn("number_", F.row_number().over(order) - 1).join(sizes, key)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        span = np.int64(1) << np.int64(44)
        at = np.searchsorted(segments["length"] * span + segments["first"], length.to_numpy() * span + number.to_numpy(), "right") - 1
        inside = number.to_numpy() - segments["first"][at]
        each = segments["each"][at]
        return pd.DataFrame({"sequence_id": segments["sequence"][at] + inside // each, "offset": segments["offset"][at] + inside % each * length.to_numpy()})

    placed = numbered.withColumn("place_", place("length", F.col("number_") + F.col("before_")))
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*keep, "place_.sequence_id", "place_.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence_length: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise `docs` (doc_id, text), cut the longer ones and pack all pieces."""
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; the text goes to the tasks
        tokenizer_json = json.dumps(json.load(f))
    return pack(materialise(token_pieces(docs, tokenizer_json, sequence_length, end_id)), sequence_length)
