import hashlib
import random
import re

import numpy as np

from veilscan.llm import queries, substrings


def brute(docs, window=50):
    """Multiset of (doc_id, n_words, n_removed, sha) by a table of all windows."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None and (key not in least or d < least[key]):
                least[key] = d
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()), key=str)


def test_op2_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op2_recompression_dedup(spark, sf)) == brute(docs)


def test_planted_repeats(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    few = ["a", "b", "c"]
    docs = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0 and docs:
            other = rng.choice(docs)[1].split()
            n = rng.choice([48, 49, 50, 51, 60, 120])
            at = rng.randrange(1 + max(0, len(other) - n))
            text[len(text) // 2 : len(text) // 2] = other[at : at + n]
        if i % 10 == 1:
            text += ["spam"] * rng.randrange(30, 90)
        if i % 10 == 2:
            text += [rng.choice(few) for _ in range(120)]
        if i % 10 == 3:
            text += "x y z".split() * rng.randrange(10, 40)
        docs.append((rng.randrange(10_000) * 200 + i, "  ".join(text)))
    docs += [(d + 7, t) for d, t in docs[:20]] + docs[20:25] + [(docs[30][0], docs[31][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(substrings.Repeats().run(frame)) == brute(docs)


def test_equal_windows_pick_equal_symbols():
    rng = np.random.default_rng(4)
    for letters in (2, 5, 1000):
        core = rng.integers(1, letters + 1, 70).astype(np.uint64)
        found = []
        for n in (0, 1, 40):
            a, b = rng.integers(1, letters + 1, n).astype(np.uint64), rng.integers(1, letters + 1, 31).astype(np.uint64)
            words, fence, begin = substrings.fenced(np.concatenate([a, core, b]), np.array([n + 101]))
            starts = begin[0] + n + np.arange(21)
            symbol, place = substrings.anchors(substrings.parse(words, fence, 50), starts, 50)
            found.append((symbol.tolist(), (place // 64 - starts).tolist()))
        assert found[0] == found[1] == found[2]


def test_odd_rows(spark, odd, none):
    assert got(substrings.Repeats().run(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert substrings.Repeats().run(none).count() == 0
    rows = [(None, "k " * 60), (5, "k " * 60), (6, "k " * 61), (None, "k " * 60)]
    assert got(substrings.Repeats().run(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def morse(n, letters="ab"):
    text = letters[0]
    while len(text) < n:
        text += text.translate(str.maketrans(letters, letters[::-1]))
    return text


def test_words_whose_sums_cancel_are_told_apart(spark):
    """Thue-Morse words and their mirrors: polynomial hashes modulo a power of two can't tell them apart."""
    docs = []
    for n in (64, 1024, 2048, 4096):
        for other in (False, True):
            odd = morse(n, "ba" if other else "ab")
            docs.append((len(docs), " ".join([f"x{i}" for i in range(30)] + [odd] + [f"y{i}" for i in range(30)])))
    assert got(substrings.Repeats().run(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    from veilscan.llm._words import word_hashes

    words = [morse(n, a).encode() for n in (8, 16, 32, 64, 128, 1024, 2048, 4096) for a in ("ab", "ba")] + [b"a", b"a\0", b"\0", b"a" * 8, b"a" * 9, b"a" * 64, b"a" * 65]
    for seed in (0, 1):
        assert len(set(word_hashes(words, seed)[0].tolist())) == len(words)
        assert word_hashes([b" ".join(words)], seed)[0].tolist() == word_hashes(words, seed, at_once=10)[0].tolist()


def test_a_passage_that_most_texts_share(spark):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(55)]
    docs = [(i, " ".join([rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(rng.randrange(5, 90))] + passage)) for i in range(300)]
    docs += [(1000 + i, docs[0][1]) for i in range(200)]
    assert got(substrings.Repeats().run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == brute(docs)
