import hashlib
from statistics import mean

import numpy as np

from veilscan.llm import fingerprints as fp
from veilscan.llm import queries


def phrases(text):
    known, at = set(), ()
    for w in fp.tokens(text):
        at = (*at, w)
        if at not in known:
            known.add(at)
            at = ()
    return known


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_op6_chain_and_likeness(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    rows = {r.doc_id: r for r in queries.op6_lz_fingerprint(spark, sf).collect()}
    assert len(rows) == len(docs)
    off = []
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = phrases(t), phrases(edited), phrases(after)
        off += [abs(r.near_edited - jaccard(a, b)), abs(r.near_next - jaccard(a, c))]
    assert mean(off) < 0.03 and max(off) < 0.25
    assert mean(r.near_edited for r in rows.values()) > mean(r.near_next for r in rows.values()) + 0.2


def test_equal_texts_have_equal_fingerprints_in_any_parts(spark):
    docs = spark.createDataFrame([(i, f"some words {i % 7} and more of them " * (1 + i % 5)) for i in range(200)], "doc_id long, text string")
    one = sorted(fp.fingerprint_neighbours(docs, 1).collect())
    many = sorted(fp.fingerprint_neighbours(docs.repartition(5), 40).collect())
    assert one == many
    by_text = {}
    for r, d in zip(one, sorted(docs.collect()), strict=True):
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint


def test_parse_and_hash_follow_lz78():
    parser = fp.Parser()
    known = {}
    parser.parse(parser.number("a b a b a b a".split()), known)
    assert len(known) == len(phrases("a b a b a b a")) == 4
    first, second = parser.signatures([list(known), list(known)])
    assert np.array_equal(first, second) and len(first) == 4


def test_odd_rows(spark, odd, none):
    rows = fp.fingerprint_neighbours(odd).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in odd.collect())
    assert {r.near_next for r in rows if r.doc_id in (1, 2)} == {1.0}  # empty beside empty
    assert fp.fingerprint_neighbours(none).count() == 0
    alone = fp.fingerprint_neighbours(spark.createDataFrame([(None, "x y z")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0 and alone[0].doc_id is None
    nulls = fp.fingerprint_neighbours(spark.createDataFrame([(None, "a"), (1, "b"), (None, "c"), (2, "d")], "doc_id long, text string")).collect()
    assert len(nulls) == 4


def test_near_copies_without_spaces_share_their_phrases(spark):
    rng = np.random.default_rng(4)
    one, other = ("".join(chr(0x4E00 + int(n)) for n in rng.integers(0, 1500, 2000)) for _ in range(2))
    hexed = "".join(rng.choice(list("0123456789abcdef"), 2000))
    texts = [one, "\u7684" + one, other, hexed, "f" + hexed, "ab" * 1000, "b" + "ab" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in fp.fingerprint_neighbours(docs).collect()}
    assert near[0] > 0.9 and near[1] < 0.2 and near[3] > 0.9
    assert all("".join(fp.tokens(t)) == t for t in texts)
    assert max(len(x) for t in texts for x in fp.tokens(t)) <= fp.LONGEST


def test_rows_of_one_id_are_dealt_to_many_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(7 if i % 3 else i, f"words of text {i} and {i * i}") for i in range(600)] + [(None, f"none {i}") for i in range(200)], "doc_id long, text string")
    heads = []
    found = fp.firsts
    monkeypatch.setattr(fp, "firsts", lambda *a: heads.append(found(*a)) or heads[-1])
    many = sorted(fp.fingerprint_neighbours(docs, 16).collect(), key=str)
    assert len(heads[0]) >= 12 and sum(h["known"] and h["doc_id"] == 7 for h in heads[0]) >= 4 and sum(not h["known"] for h in heads[0]) >= 2
    assert many == sorted(fp.fingerprint_neighbours(docs.repartition(3), 1).collect(), key=str)
    assert len(many) == 800
