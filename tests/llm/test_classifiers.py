import itertools
import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from veilscan.llm import quality, queries, toxicity

BIG = "/root/testdata/sf0.01"


def auc(rows):
    rows = sorted(rows)
    ones = [i for i, (_, y) in enumerate(rows) if y]
    n1, n0 = len(ones), len(rows) - len(ones)
    return (sum(ones) - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("query", "label", "folds", "held", "least"), [("op9_quality_rank", "quality", 5, 0, 0.98), ("op10_toxicity_cnn", "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    rows = {r.doc_id: r for r in queries.queries()[query](spark, BIG).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert auc([(rows[d].score, y) for d, y in labels.items() if rows[d].held_out]) > least


def plain_figures(text):
    """The figures of a text, one character and word at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    if not n:
        return [0.0] * len(quality.FIGURES)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda kind: sum(c in kind for c in text) / len(text)
    upper, lower = (sum(c in kind for c in text) for kind in (string.ascii_uppercase, string.ascii_lowercase))
    often = max(Counter(words).values()) / n
    threes = {tuple(words[i : i + 3]) for i in range(n - 2)}
    spaces = sum(c in " \t\n\r\x0b\x0c" for c in text)
    return [
        math.log(n), upper / max(1, upper + lower), share(string.digits), share("#*$%&<>^~=+@\\{}[]_"), share("!"), share("|"), share(".,;:?'\"()-"), spaces / len(text), len(set(words)) / n**0.9,
        sum(a == b for a, b in itertools.pairwise(words)) / n, 1 - len(set(lines)) / len(lines), (len(text) - spaces) / n, math.log(n / len(lines)), often if n > 1 else 0, 1 - len(threes) / max(1, n - 2),
    ]


def test_quality_scores_equal_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    measured = quality.measure(docs).cache()
    ranker = quality.train(measured, labels)
    got = {r.doc_id: r.score for r in quality.scored(measured, ranker).collect()}
    weights = np.split(ranker.weights, np.cumsum([len(e) + 1 for e in ranker.edges])[:-1])
    for d in docs.collect():
        raw = sum(w[sum(x >= edge for edge in e)] for x, e, w in zip(plain_figures(d.text or ""), ranker.edges, weights, strict=True))
        z = (raw - ranker.cut) / ranker.scale + math.log(0.3 / 0.7)
        assert got[d.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def plain_logit(model, text):
    """The logit of a text, one window and filter at a time."""
    embedded = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        bare = word.strip(toxicity.STRIP.decode()).lower()
        keys = [bare] + [bare[:n] + "-" for n in toxicity.STARTS if len(bare) > n]
        embedded.append(sum(model.params["emb"][1 + xxhash.xxh32_intdigest(k) % (toxicity.ROWS - 1)] for k in keys))
    embedded += [np.zeros(toxicity.WIDTH)] * 2
    z, at = model.params["out_bias"][0], 0
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            windows = [sum(embedded[i + j] @ model.params[f"k{w}"][j][:, f] for j in range(w) if i + j < len(embedded)) for i in range(len(embedded) - 2)]
            z += max(0, max([0, *windows]) + model.params["bias"][at]) * model.params["out"][at]
            at += 1
    return z


def test_toxicity_scores_equal_a_plain_scorer(spark):
    rng = np.random.default_rng(2)
    model = toxicity.TextCNN()
    for k, v in model.params.items():
        model.params[k] = rng.normal(0, 0.4, v.shape).astype(np.float32)
    model.params["emb"][0] = 0
    docs = spark.read.parquet(f"{BIG}/documents.parquet").filter("length(text) < 1500").limit(40).select("doc_id", "text").collect()
    docs = [tuple(d) for d in docs] + [(-1, ""), (-2, None), (-3, "One"), (-4, "ÉCOLE, (élève) don't\u00a0stop")]
    got = {r.doc_id: r.z for r in toxicity.logits(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for i, t in docs:
        assert got[i] == pytest.approx(plain_logit(model, t or ""), abs=2e-3)


def test_ranker_orders_and_cuts():
    rng = np.random.default_rng(0)
    y = (rng.random(600) > 0.2).astype(int)
    x = rng.normal(size=(600, 3)) + 2.5 * y[:, None]
    ranker = quality.Ranker(pairs=20_000).fit(x, y)
    assert ((ranker.score(x) >= 0.3) == y).mean() > 0.95
    assert np.all(quality.Ranker().fit(x, np.ones(600)).score(x) == 0.5)


def test_windows_stay_inside_their_text():
    model = toxicity.TextCNN()
    model.params["emb"][:] = np.random.default_rng(1).normal(size=model.params["emb"].shape)
    model.fitted = True
    vocabulary, taps = toxicity.Vocabulary(limit=3), toxicity.Taps(model)

    def scores(texts):
        words, counts, before = vocabulary.batch(texts)
        taps.learn(vocabulary, before)
        around, starts = toxicity.padded(words, counts)
        return model.pooled(around, starts, taps=taps)[0], model.pooled(around, starts, vocabulary.rows)[0]

    texts = ["a b c d", "", "one", "longer words than others here", "é, ü!"]
    together, slow = scores(texts)
    assert np.allclose(together, slow, atol=1e-4)
    for i, t in enumerate(texts):
        assert np.allclose(scores([t])[0][0], together[i], atol=1e-4)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_odd_rows(spark, odd, none, classify):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert classify(none, labels).count() == 0
    assert all(r.predicted in (0, 1) for r in classify(odd, labels.limit(0)).collect())


@pytest.mark.parametrize("most_rows", [8_000, 200])
def test_thresholds_keep_the_mix_of_labels_above_the_cap(spark, most_rows):
    """Half of the toxic twentieth has a word of its own; the other half shares one with a fifth of the clean rows."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        toxic = int(rng.random() < 0.05)
        own = toxic and rng.random() < 0.5
        shared = not own and (toxic or rng.random() < 0.2)
        words = [f"word{n}" for n in rng.integers(0, 50, 12)] + ["vileness"] * own + ["doubtful"] * shared
        rows.append((i, " ".join(words), 0, toxic, own, shared))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels, most_rows=most_rows).collect()}
    assert np.mean([got[r[0]] for r in rows if r[4]]) > 0.9
    assert np.mean([got[r[0]] for r in rows if not r[3]]) < 0.05


def test_toxic_passages_late_in_a_text_are_learned(spark):
    filler = "plain words of a long text "
    rows = [(i, filler * 500 + ("vileness it is" if i % 4 == 0 else "kindness it is"), 0, int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    assert [got[r[0]] for r in rows] == [r[3] for r in rows]
    model = toxicity.train(docs, labels.selectExpr("doc_id", "toxic AS y"), most_chars=400_000)  # whole rows go, words stay
    assert model.fitted and {r.z > 0 for r in toxicity.logits(docs, model).filter("doc_id % 4 = 0").collect()} == {True}


def test_one_repeated_row_does_not_fill_the_fit(spark):
    """50,000 rows of one labelled doc_id reach neither the driver nor the place of other labels."""
    docs = [(i, ("good words in a line of plain text. " if i % 2 else "BUY!!! $$$ ### NOW ") * (5 + i)) for i in range(1, 41)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    many = spark.range(50_000).selectExpr("CAST(1 AS BIGINT) AS doc_id", "IF(id % 2 = 0, '', concat('text ', id)) AS text")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 41)], "doc_id long, quality int, toxic int")
    ranker = quality.train(quality.measure(frame.unionByName(many)), labels, most_rows=100)
    assert ranker.edges is not None
    good, bad = ranker.score(np.array([plain_figures(docs[i][1]) for i in (2, 3)]))
    assert good > bad
    collect, sizes = toxicity.TextCNN.fit, []

    def counted(self, words, rows, y):
        sizes.append(len(y))
        return collect(self, words, rows, y)

    toxicity.TextCNN.fit = counted
    try:
        toxicity.train(frame.unionByName(many), labels.selectExpr("doc_id", "toxic AS y"), most_rows=100)
        toxicity.train(frame.unionByName(many), labels.selectExpr("doc_id", "toxic AS y"), most_rows=10)
    finally:
        toxicity.TextCNN.fit = collect
    assert sizes == [40, 10]


def test_quality_fits_on_every_labelled_row_in_parts(spark):
    """12 bad rows of 1200, parts of 50: each part has them, edges and threshold are those of all rows."""
    rng = np.random.default_rng(3)
    bad = {int(i) for i in rng.choice(1200, 12, replace=False)}
    rows = [(i, " ".join(f"word{n}" for n in rng.integers(0, 400, int(rng.integers(20, 90)))) + " !!" * (3 * (i in bad))) for i in range(1200)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    small, whole = (quality.train(measured, labels, folds=1, held=-1, most_rows=n) for n in (50, 20_000))
    got = {r.doc_id: r.score >= quality.CUT for r in quality.scored(measured, small).collect()}
    assert {i for i, good in got.items() if not good} == bad
    x = np.array([r.figures for r in measured.collect()])
    y = np.array([r.doc_id not in bad for r in measured.collect()]).astype(int)
    local = quality.Ranker().fit(x, y)
    for a, b, c in zip(small.edges, whole.edges, local.edges, strict=True):
        assert np.array_equal(a, b) and len(b) <= 11 and np.allclose(np.unique([float(f"{e:.4g}") for e in c]), b, rtol=1e-9)
