import zlib

import corpus_pipeline as cp
from veilscan.llm import jaccard, mixing, packing, quality, secrets

from test_jaccard import brute
from test_packing import check


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], sf).cache()
        if name != "packing":
            assert out.columns == docs.columns
        seen.append(out)
    good, single, clean, mixed, packed = ([r for r in x.collect()] for x in seen[1:])
    before = {r.doc_id: r for r in docs.collect()}
    assert 0.7 * len(before) < len(good) < len(before)
    want = {d for d, (_, c) in brute([(r.doc_id, r.text) for r in good], 5, 80, 100).items() if d == c}
    assert {r.doc_id for r in single} == want and len(single) == len(want)
    words = secrets.automaton()
    assert {(r.doc_id, r.text) for r in clean} == {(r.doc_id, secrets.mask(r.text, secrets.spans(r.text, words))) for r in single}
    assert all(r.n_chars == len(r.text) for r in clean)
    copies = {r.doc_id: r.copies for r in mixing.draw(mixing.measured(seen[3])).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(d for d, n in copies.items() for _ in range(n))
    check(packed, [(r.doc_id, r.text) for r in mixed])
    assert sorted(cp.run(spark, sf).drop("sequence_id", "offset").collect()) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_odd_rows(spark, sf, odd, none):
    for docs in (odd, none):
        at = docs
        for _, stage in cp.STAGES:
            at = stage(spark, at, sf)
        at.collect()
    assert {r.doc_id for r in cp.near_duplicate_stage(spark, odd, sf).collect()} == {1, 2, 3, 4, 5, 6, 7}
    assert cp.near_duplicate_stage(spark, odd, sf).count() == 7
