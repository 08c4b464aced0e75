import re

from oracle import connect

import numpy as np
import pytest

from veilscan.llm import mixing, queries, sql


def sizes(rows):
    return {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}


def test_op4_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op4_source_mix(spark, sf).collect()
    size, source = sizes(docs), {r.doc_id: r.source for r in docs}
    assert {r.doc_id: r.size for r in rows} == size
    for s, total, want in connect(sf).execute(f"SELECT DISTINCT source, source_size, target FROM ({sql.MIX_TARGETS}) JOIN documents USING (doc_id)").fetchall():
        own = [r for r in rows if source[r.doc_id] == s]
        assert {r.source_size for r in own} == {total} and [*{r.target for r in own}] == pytest.approx([want], abs=1e-3)
        assert abs(sum(r.taken for r in own) - want) <= max(r.size for r in own)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(rows) == sorted(queries.op4_source_mix(spark, sf).collect())


@pytest.mark.parametrize(("sizes", "weights", "want"), [
    ([10, 10], (1, 1), [10, 10]), ([1, 99], (99, 1), [3, 97]), ([0, 0], (5, 2), [0, 0]), ([], (5, 2, 1), []),
    ([10, 100, 1000], (5, 2, 1), [30, 300, 780]), ([100, 100, 100, 0], (5, 2, 1), [187.5, 75, 37.5, 0]), ([1, 1, 1, 300], (5, 2, 1), [3, 3, 3, 294]),
])
def test_targets_worked_by_hand(spark, sizes, weights, want):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long").repartition(3)
    got = sorted(mixing.source_targets(rows, weights, 3.0).collect())
    assert [r.target for r in got] == pytest.approx(want)


def test_sources_are_ranked_over_many_partitions(spark):
    names = [None, "", "B", "a", "Ä", "ä", "z", "\U0001F600", "\uffee"] + [f"n{i:03}" for i in range(200)]
    rows = spark.createDataFrame([(n, 1) for n in names for _ in range(2)], "source string, size long").repartition(7)
    got = {r.place: r.source for r in mixing.ranked_sources(rows).collect()}
    assert [got[i] for i in range(len(names))] == [*sorted(names[1:]), None]


def test_flight_keeps_totals_and_leaves_two():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 900, 5000).astype(float)
    p = np.full(5000, 0.37)
    out = mixing.fly(p, size, np.random.default_rng(1))
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert set(np.unique(mixing.land(out, size))) <= {0.0, 1.0}


def test_rounds_and_odd_rows(spark, odd, none):
    rows = mixing.draw(mixing.measured(odd)).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows if r.size == 0} == {1, 2, 3}
    assert mixing.draw(mixing.measured(none)).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    own = {tuple(r) for r in odd.collect()}
    assert {tuple(r) for r in mixed.collect()} <= own and {tuple(r) for r in mixing.mix(odd, broadcast_rows=-1).collect()} <= own
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 50 AS INT)) AS text", "IF(id % 3 = 0, 'a', 'b') AS source")
    sized = mixing.measured(many)
    got = mixing.draw(sized, block=100, broadcast_rows=-1).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 50 for r in got)


def test_the_draw_does_not_depend_on_where_rows_lie(spark):
    rows = [(i if i % 3 else None, "w " * (i % 17), f"s{i % 4}") for i in range(900)] + [(7, "same words here", "s1")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draws = []
    for parts in (1, 5):
        sized = mixing.measured(frame.repartition(parts))
        draws.append(sorted(tuple(r) for r in mixing.draw(sized, block=50).drop("row_id").fillna(-1).collect()))
    assert draws[0] == draws[1]
    draws = []
    for parts in (1, 5):  # equal rows go to several blocks
        sized = mixing.measured(frame.repartition(parts), often=100)
        draws.append(sorted(tuple(r) for r in mixing.draw(sized, block=50).drop("row_id").fillna(-1).collect()))
    assert draws[0] == draws[1]
    got = mixing.draw(sized, block=50).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert sized.filter("salt > 0").count() >= 299 and all(abs(r["sum(taken)"] - r.target) <= 17 for r in got)


def test_columns_of_any_name_come_through(spark):
    rows = spark.createDataFrame([(i, "a b c", "s", i, i) for i in range(9)], ["doc_id", "text", "source", "a.b", "Salt"])
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and all(r["a.b"] == r.doc_id for r in mixed.collect())
