import pytest
from pyspark.sql import functions as F

from veilscan.operators.scan import scan, verdict
from veilscan.sources.tables import table
from veilscan.streaming import arrivals as A


def scanned(spark, tmp_path, **more):
    rows = A.scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), **more).collect()
    return sorted((r.path.rpartition("/")[2], r.hiding, r.detectors, r.score) for r in rows)


def test_scan_of_arriving_files_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {}
    assert scanned(spark, tmp_path) == []
    for more in ({"a.txt": "plain", "b.txt": "in\u200bvisible"}, {"c.txt": "token = abcdefghijklmnop1234"}):
        texts |= more
        for n, text in more.items():
            (tmp_path / "in" / n).write_text(text)
        want = verdict(scan(spark.createDataFrame(list(texts.items()), "path string, text string"))).collect()
        assert scanned(spark, tmp_path) == sorted((r.path, r.hiding, r.detectors, r.score) for r in want)


def test_a_batch_that_fails_after_its_write_is_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text(f"text {i}")
    sink = A.once(str(tmp_path / "out"))

    def failing(df, batch):
        sink(df, batch)
        raise RuntimeError("after the write, before the commit")

    stream = lambda: A.arriving_files(spark, str(tmp_path / "in")).select("path", "length")
    with pytest.raises(Exception, match="before the commit"):
        A.run_once(stream(), failing, str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5  # it was written
    for i in range(5, 8):
        (tmp_path / "in" / f"{i}.txt").write_text(f"text {i}")
    got = A.landed(stream(), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted(r.path[-5:] for r in got) == [f"{i}.txt" for i in range(8)]


def test_finding_rate_of_stream_equals_batch(spark, sf, tmp_path):
    batch = {(r.start, r.event_type): r.n for r in A.finding_rate(A.timed(table(spark, sf, "events"))).collect()}
    got = {}
    stream = A.finding_rate(A.read_arrivals(spark, sf), late="400 days")
    A.run_once(stream, lambda df, _: got.update({(r.start, r.event_type): r.n for r in df.collect()}), str(tmp_path), "update")
    assert got == batch


def test_late_rows_are_counted_apart(spark, tmp_path):
    """Nulls, repeated rows, a window that only late rows fall in, and windows that are still open."""
    schema = "ts timestamp, event_type string"
    steps = [
        ["01 01", "01 02", "01 02", "02 01"],
        ["01 23", "05 12", "02 03"],  # two late rows, of which the watermark hasn't heard yet in the trigger that follows
        ["01 05", "03 01", "05 13", "06 01"],  # one late, and one in a window that closed empty
    ]
    seen = []
    for step in steps:
        rows = [(f"2024-01-{t[:2]} {t[3:]}:00:00", None if t == "01 02" else "a") for t in step]
        frame = spark.createDataFrame(rows, "ts string, event_type string").select(F.col("ts").cast("timestamp"), "event_type")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seen.append({(r.start.day, r.event_type): (r.n, r.n_late) for r in A.closed_windows(stream, str(tmp_path / "state")).collect()})
    # Each call ends with a trigger that moves the watermark to the latest time so far less a day.
    assert seen[0] == {}
    assert seen[1] == {(1, "a"): (2, 0), (1, None): (2, 0), (2, "a"): (2, 0)}
    assert seen[2] == {(1, "a"): (2, 1), (1, None): (2, 0), (2, "a"): (2, 0), (3, "a"): (0, 1)}


def test_repeat_arrivals_are_dropped(spark, sf):
    stream = A.drop_repeat_arrivals(A.read_arrivals(spark, sf), ["user_id", "event_type"], "400 days")
    want = table(spark, sf, "events").select("user_id", "event_type").distinct().collect()
    assert sorted(A.written(stream).select("user_id", "event_type").collect()) == sorted(want)


def test_byte_findings_set_the_verdict_of_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in {"a.pdf": b"MZ plain", "b.pdf": b"%PDF-1.4 x %%EOF\nhidden", "c.txt": b"text PK\x03\x04 more", "d.txt": b"plain"}.items():
        (tmp_path / "in" / name).write_bytes(content)
    want = [("a.pdf", True, "B1", 3), ("b.pdf", True, "B2", 2), ("c.txt", True, "B3", 2), ("d.txt", False, "", 0)]
    assert scanned(spark, tmp_path) == want


def test_large_files_arrive_with_the_verdict_of_their_ranges(spark, tmp_path):
    from veilscan.sources.tables import read_large_files, read_raw_files

    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": "plain", "b.txt": "x " * 50 + "in\u200bvisible" + " x" * 50, "c.txt": "y " * 100 + "y"}.items():
        (tmp_path / "in" / name).write_text(text)
    assert scanned(spark, tmp_path, most_bytes=50) == [("a.txt", False, "", 0), ("b.txt", True, "T1", 3), ("c.txt", False, "", 0)]
    assert sorted(r.length for r in read_large_files(spark, str(tmp_path / "in"), most_bytes=50).collect()) == [201, 212]
    assert read_raw_files(spark, str(tmp_path / "in"), most_bytes=50).count() == 1


def test_a_table_is_read_by_its_name_alone(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(9).write.parquet(str(tmp_path / "events.parquet.bak"))
    assert A.written(A.read_arrivals(spark, str(tmp_path))).count() == 3
