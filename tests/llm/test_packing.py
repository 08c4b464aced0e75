import functools
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilscan.llm import packing, queries

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one text at a time: threads would only wait for one another


@functools.cache
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def whole(text):
    return [*reference().encode(text or "", add_special_tokens=False).ids, 0]


@functools.cache
def encoder(limit):
    return packing.Encoder(open(queries.tokenizer_path(), encoding="utf-8").read(), limit=limit)


def check(rows, docs):
    want = sorted((d, p, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in docs for ids in [whole(t)] for p, s in enumerate(range(0, len(ids), 2048)) for x in [ids[s : s + 2048]])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_op1_equals_whole_text_encoding_and_packs_tightly(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    assert check(rows, docs) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.pack_documents(odd, queries.tokenizer_path()).collect(), docs)
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_every_length_once(counts):
    used = defaultdict(int)
    for pattern, times in packing.plan_packing(counts, 64):
        assert sum(k * n for k, n in pattern) <= 64 and times > 0
        for k, n in pattern:
            used[k] += n * times
    assert dict(used) == counts


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_words_give_the_ids_of_the_text(texts):
    assert [x.tolist() for x in encoder(5).batch(texts)] == [whole(t) for t in texts]


# Letters that fall apart or together when they are normalised, marks, and what stands beside words.
MARKED = st.text(alphabet="İıK\u0958\ufb2aﬁǆǅß\u0301\u0307\u0345éE\u212b가\u1100\u1161ªʰЙй०१٣Σς'.,s t\u00a0\u1e9eA", max_size=12)


@pytest.mark.parametrize("text", ["İ.", "Gİ, b", "\u0958.", "\ufb2a.", "İ,. İ x. \u0958", "'S 'Ll it's, don't."])
def test_letters_that_normalise_to_marks(text):
    assert [x.tolist() for x in encoder(1000).batch([text])] == [whole(text)]


@settings(max_examples=400, deadline=None)
@given(st.lists(MARKED, max_size=6))
def test_words_of_odd_letters_give_the_ids_of_the_text(texts):
    assert [x.tolist() for x in encoder(50).batch(texts)] == [whole(t) for t in texts]


def test_every_letter_in_either_case_and_with_marks_gives_the_ids_of_the_text():
    letters = [c for c in map(chr, range(0x600)) if c.isalpha()]
    texts = [f"{c} a{c}b {c.upper()}{c}... {c}a!?* ({c}) {c}'s {c}' {c}_$^`" for c in letters]
    assert [x.tolist() for x in encoder(5_000).batch(texts)] == [whole(t) for t in texts]


def test_letters_are_encoded_once_whatever_their_case_and_marks(monkeypatch):
    given_, encode = [], packing.Encoder._encode
    monkeypatch.setattr(packing.Encoder, "_encode", lambda self, words, *kind: given_.extend(words) or encode(self, words, *kind))
    own = packing.Encoder(open(queries.tokenizer_path(), encoding="utf-8").read())
    marks = ["", ".", "!!", "###", "&&&", "%%%", ".***", ",$$$"]
    forms = [f(w) for w in ("thenation", "étionché", "größe") for f in (str.lower, str.capitalize, lambda w: w[:2] + w[2:].replace("ß", "s").upper())]
    texts = [" ".join(f + m for f in forms) for m in marks]
    assert [x.tolist() for x in own.batch(texts)] == [whole(t) for t in texts]
    assert len(given_) <= 4 + len(marks)  # the words (one loses its ß) and the marks


def test_nulls_white_space_and_slices():
    import pyarrow as pa

    texts = [None, "", " ", "a", "\x1c\x1d a\x85b ", "\n\t\x0b\x0c\r", "x" * 70_000, None]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["left out", *texts, "left out"], kind).slice(1, len(texts))
        assert [x.tolist() for x in encoder(1000).batch(column)] == [whole(t) for t in texts]
    assert encoder(1000).batch([]) == []


def test_triples_are_found():
    left = np.zeros(101, int)
    left[[60, 20, 15, 5]] = 1
    assert packing._exact(left, 60, 40) == (20, 15, 5)
    assert packing._exact(left, 60, 39) is None


@pytest.mark.parametrize("n", [1, 7])
def test_equal_lengths(n):
    assert sum(t for _, t in packing.plan_packing({3: n * 10}, 10)) == -(-n * 10 // 3)
