from pathlib import Path

from pyspark.sql import functions as F

from veilscan.functions import raw
from veilscan.operators import scan as S
from veilscan.operators.match import type_mismatch
from veilscan.operators import plant
from veilscan.sources import ranges
from veilscan.sources.tables import list_files, list_parts, read_raw_files

PNG = bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + b"x" * 17 + b"\0\0\0\0IEND\xaeB`\x82"
ZIP = b"PK\x03\x04data" + b"PK\x05\x06" + b"\0" * 16 + b"\x02\0ok"


def test_trailing_and_embedded():
    assert raw.trailing_bytes(PNG) == 0 and raw.trailing_bytes(PNG + b"abc") == 3
    assert raw.trailing_bytes(ZIP) == 0 and raw.trailing_bytes(ZIP + b"zz") == 2
    assert raw.trailing_bytes(b"%PDF-1.4 x %%EOF\r\n") == 0 and raw.trailing_bytes(b"%PDF-1.4 x %%EOF\nzip") == 3
    assert raw.trailing_bytes(b"\xff\xd8\xff..\xff\xd9") == 0 and raw.trailing_bytes(b"") == 0 and raw.trailing_bytes(b"text") == 0
    assert raw.embedded(PNG + ZIP) == [len(PNG)] and raw.embedded(PNG) == []


def test_files(spark, tmp_path):
    for name, content in {"a.png": PNG, "b.pdf": b"MZ\x90\0", "c.txt": b"hello", "d.png": PNG + ZIP, "e.png": b"not a png"}.items():
        (tmp_path / name).write_bytes(content)
    files = read_raw_files(spark, str(tmp_path))
    got = {r.path[-5:]: (r.actual, r.mismatch) for r in type_mismatch(files).collect()}
    assert got == {"a.png": ("png", False), "b.pdf": ("exe", True), "c.txt": (None, False), "d.png": ("png", False), "e.png": (None, True)}
    found = {r.path[-5:]: r.f for r in files.select("path", raw.structure(files["content"]).alias("f")).collect()}
    assert found["d.png"].trailing == len(ZIP) and found["d.png"].embedded == [len(PNG)] and found["c.txt"].trailing == 0
    assert read_raw_files(spark, str(tmp_path), "*.txt").count() == 1 and read_raw_files(spark, str(tmp_path), most_bytes=5).count() == 2


def test_ranges_find_what_whole_files_hold(spark, tmp_path):
    import random

    rng = random.Random(5)
    marks = [raw.ENDS["png"], raw.ENDS["jpg"], raw.ENDS["pdf"], raw.ZIP_END + b"\0" * 16 + b"\x03\0abc", ZIP, b"%PDF-", b"\r\n" * 9, b"GIF89a", b"\xff\xd8\xff", b"words of text\n"]
    heads = [b"", b"\xff\xd8\xff", b"%PDF-1.7", b"PK\x03\x04", PNG]
    contents = [b"".join([rng.choice(heads), *rng.choices(marks, k=rng.randrange(12)), b"\r\n" * rng.randrange(3)]) for _ in range(40)] + [b"%PDF-1.7 %%EOF\n\n\n", b"%PDF- %%EOF" + b"\n" * 50 + b"x" + b"\n" * 50]
    for i, c in enumerate(contents):
        (tmp_path / f"{i}.bin").write_bytes(c)
    files = list_files(spark, str(tmp_path)).select("path", "length")
    for size in (7, 64, 1 << 20):
        facts = ranges.read_ranges(files, size)
        sums = facts.groupBy("path", "length").agg(F.max("kind").alias("kind"), F.array_sort(F.flatten(F.collect_list("embedded"))).alias("embedded"), *ranges.ends())
        got = {int(r.path.rpartition("/")[2][:-4]): (r.kind, r.trailing, r.embedded) for r in ranges.with_trailing(sums).collect()}
        assert got == {i: (raw.kind_of(c), raw.trailing_bytes(c), raw.embedded(c)) for i, c in enumerate(contents)}
        # The ranges' texts are the file, cut.
        texts = facts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "content"))).alias("parts")).collect()
        assert {int(r.path.rpartition("/")[2][:-4]): b"".join(bytes(p.content) for p in r.parts) for r in texts} == dict(enumerate(contents))


def test_verdicts_by_ranges_equal_those_of_whole_files(spark, tmp_path):
    line = "some plain words in a line\n"
    texts = {"a.txt": line * 50, "b.txt": line * 20 + "in\u200bvisible\n" + line * 20 + "token = abcdefghijklmnop1234\n", "c.pdf": "MZ" + line * 9, "d.pdf": "%PDF-1.4\n" + line * 9 + "%%EOF\nhidden\n", "e.txt": line * 9 + "PK\x03\x04" + line * 9 + "PK\x03\x04", "f.txt": "x", "g b%20.txt": line + "4111111111111111\n" + line * 9}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    files = list_files(spark, str(tmp_path))
    key = lambda r: (r.path.rpartition("/")[2], r.hiding, r.n_findings, r.detectors, r.score, r.length)
    want = sorted(map(key, S.verdict_files(files).collect()))
    assert len(want) == len(texts) and sum(x[1] for x in want) == 5
    for size in (40, 300):
        assert sorted(map(key, S.verdict_ranges(files.select("path", "length"), size).collect())) == want
    mixed = S.verdict_files(files.withColumn("a.b", F.lit(1)).withColumn("Score", F.lit(9)), most_bytes=300, size=100)
    assert sorted(map(key, mixed.collect())) == want and "a.b" in mixed.columns and mixed.columns.count("Score") == 0


def test_a_null_length_keeps_its_row(spark):
    files = spark.createDataFrame([("a.txt", None, None), ("b.txt", 2, bytearray(b"hi"))], "path string, length long, content binary")
    assert sorted((r.path, r.hiding) for r in S.verdict_files(files).collect()) == [("a.txt", False), ("b.txt", False)]
    assert [(r.path, r.hiding) for r in S.verdict_ranges(files.filter("length IS NULL").drop("content")).collect()] == [("a.txt", None)]


def test_files_in_parts_are_read_as_one(spark, tmp_path):
    """Signatures, end marks, lines and bytes behind the end cross the parts; ranges are dealt to all tasks, and parts written by several."""
    rows = [(i, f"line {i} token = abcdefghij0123456789abcdefghij {'x' * (i % 97)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plant.big_files(docs, f"file://{tmp_path}/big", part_bytes=4 << 10)
    assert min(len(list(d.glob("*.txt"))) for d in (tmp_path / "big").glob("bucket=*")) > 2
    body = b"%PDF-1.7\n" + b"some text\n" * 500 + b"PK\x03\x04 inside\n%%EOF\n\nbehind\r\n"
    (tmp_path / "cut").mkdir()
    cuts = [0, 3, 4000, 5011, 5026, 5029, 5032, len(body)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / "cut" / f"part-{i}.txt").write_bytes(body[a:b])
    files = list_parts(spark, f"file://{tmp_path}", "*.txt")
    whole = spark.createDataFrame([(r.path, bytearray(b"".join(Path(p.path.removeprefix("file:")).read_bytes() for p in r.parts))) for r in files.collect()], "path string, content binary")
    want = {tuple(r) for r in S.verdict(S.scan_files(whole)).select("path", "hiding", "n_findings", "detectors", "score").collect()}
    assert len(want) == 11 and {r[3] for r in want if r[0].endswith("cut")} == {"B1,B2,B3"}
    for size in (700, 64 << 10):
        assert {tuple(r) for r in S.verdict_ranges(files, size).select("path", "hiding", "n_findings", "detectors", "score").collect()} == want
    assert ranges.read_ranges(files, 700).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
