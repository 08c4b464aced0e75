"""Hashes of all words of a batch of texts, without a Python object for each word."""

from __future__ import annotations

import numpy as np

from veilscan.llm._common import mix64

SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
ODD = np.uint64(0xD1342543DE82EF95)
# What a load of eight bytes keeps of a word's last 0 to 8.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 64  # bytes; longer words are hashed one by one


def splits(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all documents with a space after each, start and end of every word, words of each document)."""
    raw = np.frombuffer(b" ".join([*docs, b""]), np.uint8)
    space = np.concatenate([[True], SPACE[raw]])
    change = np.flatnonzero(space[1:] != space[:-1])
    begin, end = change[::2], change[1::2]
    ends = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    return raw, begin, end, counts


def hashed(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of raw[begin:end] of each word, eight bytes a step: every step multiplies and scrambles, so that no sum over a word's places can cancel."""
    import xxhash

    data = raw.tobytes() + b"\0" * 8
    eight = np.ndarray(len(raw) + 1, np.dtype("<u8"), data, strides=(1,))
    size = end - begin
    h = mix64(size.astype(np.uint64) * ODD + np.uint64(seed * 2 + 1))
    todo, at, left = None, begin, size
    for _ in range(LONG // 8):
        h_now = h if todo is None else h[todo]
        h_now = mix64((h_now ^ (eight[at] & KEEP[np.minimum(left, 8)])) * ODD)
        if todo is None:
            h = h_now
        else:
            h[todo] = h_now
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]], seed)
    return h


def word_hashes(docs: list[bytes], seed: int = 0, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all documents in turn, number of words of each document).

    Hashes of different seeds are independent. Documents go in runs of about `at_once` bytes, which bounds memory.
    """
    values, counts, part, size = [], [], [], 0
    for i, doc in enumerate(docs):
        part.append(doc)
        size += len(doc) + 1
        if size >= at_once or i + 1 == len(docs):
            raw, begin, end, n = splits(part)
            values.append(hashed(raw, begin, end, seed))
            counts.append(n)
            part, size = [], 0
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(counts)
