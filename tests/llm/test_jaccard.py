import random
import re

import numpy as np
import pytest

from veilscan.llm import jaccard, queries
from veilscan.llm.components import components


def brute(docs, k, num, den):
    """{doc_id: (n, component)} by all pairs that share a shingle."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for d in sorted(sets):
        met = {o for s in sets[d] for o in where.get(s, ())}
        for o in met:
            both = len(sets[d] & sets[o])
            if den * both >= num * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((top(d), top(o)))
                parent[b] = a
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_op7_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_jaccard(spark, sf).collect()}
    assert got == brute(docs, 4, 85, 100)


@pytest.mark.parametrize("settings", [{}, {"group_tokens": 300, "query_tokens": 500, "broadcast_bytes": -1, "heavy_most": 3}, {"group_tokens": 2000, "pivots": 1}])
def test_families_of_near_copies(spark, settings):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    docs, bases = [], [[rng.choice(words) for _ in range(n)] for n in (8, 30, 120, 120, 300)]
    passage = [rng.choice(words) for _ in range(40)]
    for i in range(260):
        text = list(bases[i % 5])
        for _ in range(rng.randrange(0, 1 + len(text) // 25)):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(text)))
    docs += [(300 + i, " ".join([rng.choice(words) for _ in range(60)] + passage)) for i in range(60)]
    docs += [(400, ""), (401, None), (402, "one two"), (403, "ONE two"), (404, " ")]
    docs += docs[5:8] * 3  # repeated rows
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.Join(4, 85, 100, **settings).run(frame).collect()}
    assert got == brute(docs, 4, 85, 100)
    assert len({c for _, c in got.values()}) > 70


def test_bound_is_never_below_the_overlap():
    rng, pairs = np.random.default_rng(2), []
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([rng.choice(a, len(a) // 2), rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64)]))
        pairs.append((jaccard.sketch(a).tobytes(), jaccard.sketch(b).tobytes(), len(np.intersect1d(a, b))))
    one, other, overlap = zip(*pairs, strict=True)
    assert (jaccard.overlap_bounds(one, other, at_once=500) >= overlap).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100}


def test_odd_rows(odd, none):
    got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in jaccard.Join().run(odd).collect()]
    assert len(got) == odd.count() and dict(got) == brute([(r.doc_id, r.text) for r in odd.collect()], 5, 80, 100)
    assert jaccard.Join().run(none).count() == 0


def test_sets_whose_sums_cancel_are_told_apart(spark):
    from test_substrings import morse

    docs = [(2 * j + k, " ".join([morse(n, "ba" if k else "ab")] * 3 + [f"x{j}"] * (j % 2))) for j, n in enumerate((64, 1024, 2048)) for k in (0, 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.Join(4, 85, 100).run(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 4, 85, 100)


def test_near_copies_at_the_threshold_are_all_linked(spark):
    """Copies with few words changed: every one that the definition links is linked, whichever the chunk."""
    rng = random.Random(8)
    docs, words = [], [f"w{i}" for i in range(3000)]
    for f in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 90, 200]))]
        docs.append((f * 100, " ".join(base)))
        for i in range(1, 25):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((f * 100 + i, " ".join(text)))
    want = brute(docs, 4, 85, 100)
    found = jaccard.Join(4, 85, 100, group_tokens=500).run(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want
    assert sum(d != c for d, (_, c) in want.items()) > 150


def test_texts_of_one_doc_id_join_their_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(9, a), (8, a + " end"), (5, a), (5, b), (7, b + " end"), (3, c), (5, b)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.Join(4, 85, 100).run(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(3, 57, 3), (5, 57, 5), (5, 57, 5), (5, 57, 5), (7, 58, 5), (8, 58, 5), (9, 57, 5)]


def test_heavy_shingles_are_cut_by_their_counts(spark):
    from veilscan.llm import jaccard

    counts = [(i, 1 + i) for i in range(100)] + [(1000 + i, 500) for i in range(7)]
    measured = spark.createDataFrame(counts, "token long, times long")
    for most in (0, 5, 7, 20, 500):
        got = jaccard.Join(k=4, num=85, den=100, heavy_most=most).heavy(measured).tolist()
        times = dict(counts)
        assert len(got) <= most and got == sorted(got)
        assert not got or min(times[t] for t in got) >= max((n for t, n in counts if t not in got), default=0)
    assert len(jaccard.Join(k=4, num=85, den=100).heavy(measured.limit(0))) == 0


@pytest.mark.parametrize("group_tokens", [200_000, 12_000])
def test_a_common_line_opens_no_group(spark, monkeypatch, group_tokens):
    """Documents whose least shingle is of one common line are a group, but what shares a shingle with one of them isn't compared with all."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    line = [rng.choice(words) for _ in range(60)]
    parts = [[rng.choice(words) for _ in range(12)] for _ in range(800)]
    docs = [(i, " ".join([*line, *(rng.choice(words) for _ in range(300)), *parts[i // 2], *parts[i * 7 % 800], *parts[i * 11 % 800]])) for i in range(800)]
    docs += [(1000 + i, f"{docs[i][1]} z{i}") for i in range(5)]
    met, links = [], jaccard.Join.links
    monkeypatch.setattr(jaccard.Join, "links", lambda self, docs, rows: (met.append(rows.count()), links(self, docs, rows))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.Join(group_tokens=group_tokens).run(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(docs, 5, 80, 100)
    assert len(met) == 2 and met[1] < 50, met


def test_prefixes_are_not_kept(spark):
    from pathlib import Path

    from veilscan.sources.tables import scratch_dir

    tables = lambda: {str(p) for p in Path(scratch_dir(spark).removeprefix("file://")).glob("veilscan-*")}
    before, docs = tables(), [(i, " ".join(f"{i // 2}w{j}" for j in range(40)) + f" z{i}") for i in range(20)]
    found = jaccard.Join().run(spark.createDataFrame(docs, "doc_id long, text string"))
    held = {c for p in tables() - before for c in spark.read.parquet(p).columns}
    assert "component_id" not in held and "prefix" not in held and "sketch" not in held
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i // 2 * 2 for i in range(20)}
