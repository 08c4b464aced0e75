import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilscan.llm import cutting, queries

from test_packing import reference

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def check(rows, docs):
    """All ids once, in gapless sequences without padding; the numbers of sequences and of cuts."""
    held, cuts = defaultdict(list), 0
    for r in rows:
        held[r.doc_id, r.doc_tokens].append(r)
    want = Counter()
    for d, t in docs:
        ids = [*reference().encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids)] += 1
        own = held[d, len(ids)]
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert sum(r.length for r in own) == len(ids) * sum(1 for e, u in docs if e == d and (u or "") == (t or ""))
        if sum(1 for e, _ in docs if e == d) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == len(ids)
            cuts += len(own) - 1 - (len(ids) - 1) // 2048
    assert set(want) == {k for k, v in held.items() if v}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    return len(bins), cuts


def test_op11_equals_whole_text_encoding_and_pads_nothing(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op11_cutting_stock(spark, sf).collect()
    sequences, cuts = check(rows, docs)
    assert sequences <= sum(r.length for r in rows) // 2048 + 11
    assert cuts <= 0.1 * len(docs)


@pytest.mark.parametrize("broadcast_rows", [500_000, -1])
def test_odd_rows(odd, none, monkeypatch, broadcast_rows):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    pack = cutting.pack
    monkeypatch.setattr(cutting, "pack", lambda pieces, capacity: pack(pieces, capacity, broadcast_rows))
    check(cutting.pack_documents(odd, queries.tokenizer_path()).collect(), docs)
    assert cutting.pack_documents(none, queries.tokenizer_path()).count() == 0


def test_lengths_that_never_fit_are_cut(spark):
    docs = [(i, "word " * 1400) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sequences, cuts = check(cutting.pack_documents(frame, queries.tokenizer_path()).collect(), docs)
    assert cuts <= 30 and sequences <= 30 * 1401 // 2048 + 11


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=30))
def test_plan_uses_no_more_than_there_is(counts):
    made, left = cutting.plan(counts, 64)
    used = Counter()
    for pattern, times in made:
        assert sum(k * n for k, n in pattern) == 64 and times > 0
        for k, n in pattern:
            used[k] += n * times
    assert all(used[k] + int(left[k]) == counts.get(k, 0) for k in range(65))
    places = cutting.Places(made, left, 64)
    taken = Counter()
    for k, n in counts.items():
        for s, o, p in zip(*(x.tolist() for x in places.of(np.full(n, k), np.arange(n))), strict=True):
            for sequence, offset, size in [(s, o, k)] if p < 0 else [(q, o, n) for _, n, q, o in places.cut(p, k)]:
                taken.update((sequence, offset + i) for i in range(size))
    assert not taken or max(taken.values()) == 1
    sizes = Counter(q for q, _ in taken)
    assert sum(sizes.values()) == sum(k * n for k, n in counts.items()) and all(v & (v - 1) == 0 for v in sizes.values())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 19), st.integers(1, 30), min_size=1, max_size=12))
def test_program_reaches_its_bound(counts):
    lengths = np.array(sorted(counts))
    program = cutting.Program(lengths, np.array([counts[k] for k in lengths.tolist()]), 20)
    program.solve([], 500, 1e-6)
    value = program.value()
    assert value <= program.most + 1e-6
    # Prices at which no pattern gains and no price is negative prove the optimum: the two values are equal.
    if len(columns := program.knapsack(np.maximum(program.prices, 0))) and all(program.gain(c) <= 1e-4 for c in columns) and program.prices.min() >= -1e-4:
        assert abs(value - program.prices @ program.counts) < 1e-2
    for pattern, x in program.patterns():
        assert sum(k * n for k, n in pattern.items()) == 20 and x > 0
    used = Counter()
    for pattern, x in program.patterns():
        for k, n in pattern.items():
            used[k] += n * x
    assert all(used[k] <= counts[k] + 1e-6 for k in counts)


def test_program_finds_what_greedy_misses():
    # Longest first pairs 12 with 8 and leaves the fives and threes without exact sums.
    counts = {12: 10, 8: 10, 5: 20, 3: 10}
    lengths = np.array(sorted(counts))
    program = cutting.Program(lengths, np.array([counts[k] for k in lengths.tolist()]), 20)
    program.solve([], 200, 1e-9)
    assert program.value() >= 0.999 * program.most


def test_exact_fill():
    left = np.zeros(101, np.int64)
    left[[60, 20, 15, 5]] = 1
    assert cutting.exact_fill(left, 40) == {20: 1, 15: 1, 5: 1}
    assert cutting.exact_fill(left, 39) is None
    left[7] = 100
    found = cutting.exact_fill(left, 70)
    assert sum(k * n for k, n in found.items()) == 70 and all(n <= left[k] for k, n in found.items())
