"""Files of any size by byte ranges: Spark deals the ranges out, tasks read them in place.

A range begins every `size` bytes. A task reads it and `WINDOW` bytes more, so what crosses its end is
seen whole: a signature or end mark belongs to the range that it begins in, and text to the range whose
cuts hold it. Both ranges at a boundary look at the same bytes, so they cut at the same place. No more
than a range is held at once. Files are opened through pyarrow's file systems (local, HDFS, S3, GCS, Azure).

A file may lie in parts, as `tables.list_parts` lists it: `parts` (path, start, length of each) are then read in place of
`path`, which only names it. A range's row carries the parts that it touches. As many tasks as the bytes ask for read the
ranges, since their rows are too small for Spark to tell.

An empty file has one empty range; repeated paths are the caller's to drop.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import closing

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import raw
from veilscan.sources.tables import materialise

#: Bytes behind a boundary in which a cut is looked for; more than any signature or end mark.
WINDOW = 64 << 10
#: Of those, what is read at once: most lines end there. More than any mark and a zip's end record.
NEAR = 4 << 10
#: Bytes of files for a task, and of text that a task hands over at once.
TASK_BYTES, BATCH_BYTES = 32 << 20, 1 << 20
PARTS = "array<struct<path:string,start:long,length:long>>"
MARKS = {**raw.ENDS, "zip": raw.ZIP_END}
FACTS = "path string, length long, start long, content binary, kind string, embedded array<long>, " + ", ".join(f"first_{k} long, last_{k} long" for k in MARKS) + ", comment int"


def open_file(path: str) -> pa.NativeFile:
    """A file of a path as Spark lists it (not percent-encoded)."""
    if path.startswith("file:"):
        return pa.OSFile("/" + path.removeprefix("file:").lstrip("/"))
    if "://" not in path:
        return pa.OSFile(path)
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def read_at(path: str, parts: list[dict] | None, start: int, stop: int) -> bytes:
    """Bytes `start` to `stop` of a file, or of the parts that it lies in."""
    if parts is None:
        parts = [{"path": path, "start": 0, "length": stop}]
    found = []
    for p in parts:
        a, b = max(start, p["start"]), min(stop, p["start"] + p["length"])
        if a < b:
            with closing(open_file(p["path"])) as f:
                f.seek(a - p["start"])
                found.append(f.read(b - a))
    return b"".join(found)


def cut(window: bytes) -> int:
    """Where text is cut behind a boundary, from the bytes there: after the first line end, else blank, else at the boundary."""
    for mark in (b"\n", b" ", b"\t", b"\r"):
        if (at := window.find(mark)) >= 0:
            return at + 1
    return 0


def facts(path: str, length: int, start: int, size: int, parts: list[dict] | None = None) -> dict:
    """What a range holds: its text, the file's kind (first range), signatures inside, first and last of each end mark."""
    stop = min(start + size, length)
    data = read_at(path, parts, start, min(stop + NEAR, length))
    if stop < length and (b"\n" not in data[stop - start :] or (start and b"\n" not in data[:WINDOW])):  # no line ends near the boundaries
        data += read_at(path, parts, start + len(data), min(stop + WINDOW, length))
    begin = cut(data[:WINDOW]) if start else 0
    end = stop - start + (cut(data[stop - start :]) if stop < length else 0)
    # A cut behind the whole range: its text belongs to the range before, and none is left.
    out = {"path": path, "length": length, "start": start, "content": data[min(begin, end) : end], "kind": raw.kind_of(data) if start == 0 else None, "comment": None}
    out["embedded"] = [start + m.start() for m in raw.ANY_INSIDE.finditer(data) if start + m.start() > 0 and m.start() < stop - start]
    for k, mark in MARKS.items():
        within = stop - start + len(mark) - 1  # marks that begin in the range
        first, last = data.find(mark, 0, within), data.rfind(mark, 0, within)
        out |= {f"first_{k}": start + first if first >= 0 else None, f"last_{k}": start + last if last >= 0 else None}
        if k == "zip" and last >= 0 and last + 22 <= len(data):
            out["comment"] = int.from_bytes(data[last + 20 : last + 22], "little")
    return out


def read_ranges(files: DataFrame, size: int = 16 << 20) -> DataFrame:
    """FACTS of every range of `files` (path, length, and parts where they lie in such); files of unknown length have none."""
    spark = files.sparkSession
    parts = F.col("parts") if "parts" in files.columns else F.lit(None)
    known = materialise(files.filter("length IS NOT NULL").select(F.col("path").cast("string"), F.col("length").cast("long"), parts.cast(PARTS).alias("parts")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(known.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    places = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    touched = F.filter("parts", lambda p: (p["start"] < F.col("start") + size + WINDOW) & (p["start"] + p["length"] > F.col("start")))
    dealt = known.select("path", "length", "parts", F.explode(places).alias("start")).select("path", "length", "start", touched.alias("parts")).repartition(tasks, "path", "start")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.rsplit(" ", 1) for x in FACTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for r in batch.to_pylist():
                found.append(facts(r["path"], r["length"], r["start"], size, r["parts"]))
                held += len(found[-1]["content"])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, held = [], 0
            yield pa.RecordBatch.from_pylist(found, schema)

    return dealt.mapInArrow(run, FACTS)


def ends() -> list[Column]:
    """Aggregates of FACTS by file: the end mark that counts for each kind, and a zip's comment length there."""
    return [F.min("first_png").alias("png"), F.max("last_jpg").alias("jpg"), F.max("last_pdf").alias("pdf"), F.max(F.when(F.col("last_zip").isNotNull(), F.struct("last_zip", "comment"))).alias("zip")]


def with_trailing(files: DataFrame) -> DataFrame:
    """`files` (path, length, kind and `ends`, and parts where they lie in such) with `trailing`: bytes after the end of the file's kind, as `raw.trailing_bytes` counts them."""

    @F.pandas_udf("long")
    def behind_pdf(path: pd.Series, length: pd.Series, start: pd.Series, parts: pd.Series) -> pd.Series:
        own = [None if x is None else list(x) for x in parts]
        return pd.Series([stripped(p, int(a), int(n), x) if a == a and a is not None else 0 for p, n, a, x in zip(path, length, start, own, strict=True)])

    def behind(kind: str) -> Column:
        return F.col("length") - F.col(kind) - len(MARKS[kind])

    zipped = F.greatest(F.lit(0), F.col("length") - F.col("zip.last_zip") - 22 - F.col("zip.comment"))
    pdf = F.when(F.col("kind") == "pdf", F.col("pdf") + len(MARKS["pdf"]))
    kinds = F.when(F.col("kind") == "png", behind("png")).when(F.col("kind") == "jpg", behind("jpg")).when(F.col("kind") == "zip", zipped)
    parts = (F.col("parts") if "parts" in files.columns else F.lit(None)).cast(PARTS)
    counted = files.withColumn("behind_pdf", behind_pdf("path", "length", pdf, parts))
    return counted.withColumn("trailing", F.coalesce(F.when(F.col("kind") == "pdf", F.col("behind_pdf")).otherwise(kinds), F.lit(0).cast("long"))).drop("behind_pdf")


def stripped(path: str, start: int, length: int, parts: list[dict] | None = None, step: int = 1 << 20) -> int:
    """Bytes from `start` on without the line ends around them, read a step at a time from both sides."""
    while start < length:
        part = read_at(path, parts, start, min(start + step, length))
        if rest := part.lstrip(b"\r\n"):
            start += len(part) - len(rest)
            break
        start += len(part)
    while length > start:
        part = read_at(path, parts, max(start, length - step), length)
        if rest := part.rstrip(b"\r\n"):
            length -= len(part) - len(rest)
            break
        length -= len(part)
    return length - start
