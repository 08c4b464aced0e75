import itertools
import re
from collections import Counter

from veilscan.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Counts by (part, order, step) from each document's list of failing filters."""
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), copy]
        rows.append((s or "", {c for c, x in zip("ABCDE", fails, strict=True) if x}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for p in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == p]
            gone = []
            for step, c in enumerate(order, 1):
                here = [r for r in left if c in r[1]]
                redundant = sum(c in r[1] for r in gone)
                left, gone = [r for r in left if c not in r[1]], gone + here
                out[p, order, step] = (len(left), len(here), redundant, sum(r[1] == {c} for r in rows if r[0] == p), sum(r[2] for r in here), sum(r[3] for r in here))
                shapley[p, c] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_odd_rows(spark, odd, none):
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    more = odd.filter("doc_id IN (2, 6)").withColumn("doc_id", odd["doc_id"] + 100).unionByName(odd.filter("doc_id = 4").withColumn("doc_id", odd["doc_id"] - 5))
    more = more.unionByName(odd.filter("doc_id = 7").selectExpr("NULL AS doc_id", *(f"`{c}`" for c in odd.columns[1:])))
    docs = odd.unionByName(more)
    rows = docs.collect()
    assert {r.doc_id for r in rows} >= {None, -1, 102}
    frame = spark.createDataFrame(labels, LABELS)
    want = brute([(r.doc_id, r.text, r.source) for r in rows], labels)
    assert len(want) == 600 * 3
    assert got(audit.audit(docs, frame)) == want
    assert audit.audit(none, frame).count() == 0
    assert got(audit.audit(docs, frame.limit(0))) == brute([(r.doc_id, r.text, r.source) for r in rows], [])


def test_hot_copies_are_salted(spark, monkeypatch):
    monkeypatch.setattr(audit, "HOT_ROWS", 5)
    docs = [(i, "the same text" if i % 3 else f"text {i}", "a") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert got(audit.audit(frame, spark.createDataFrame([(4, 1, 1)], LABELS))) == brute(docs, [(4, 1, 1)])


def test_counts_are_combined_before_the_shuffle(spark):
    frame = spark.createDataFrame([("a", 3, True, False)], "part string, mask int, good boolean, toxic boolean")
    plan = audit.replay(frame)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "BroadcastNestedLoopJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan
