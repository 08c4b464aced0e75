"""Planted concealment, so that detectors with no hits in a table can be compared with an oracle.

Every row is kept; each tenth row gets a mark, the rest are the negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plant_text(docs: DataFrame) -> DataFrame:
    """Invisible characters, look-alike letters and trailing blanks in each tenth document."""
    t = F.col("text")
    marked = F.concat(F.substring(t, 1, 20), F.lit("​‮"), F.translate(F.expr("substring(text, 21)"), "a", "а"), F.lit(" \t\nend"))
    return docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, marked).otherwise(t))


def payloads(docs: DataFrame) -> DataFrame:
    """In each tenth document a base64 payload, in others one that hides a password, a hex payload, and runs that decode to no text."""
    kind, key = F.pmod("doc_id", F.lit(10)), F.col("doc_id").cast("string")
    coded = lambda *parts: F.base64(F.encode(F.concat(*parts), "UTF-8"))
    extra = (
        F.when(kind == 0, F.concat(F.lit(" "), coded(F.lit("a plain payload of some length, "), key), F.lit(" ")))
        .when(kind == 1, F.concat(F.lit(" "), coded(F.lit("password: hidden-in-a-payload-"), key)))
        .when(kind == 2, F.concat(F.lit(" "), F.lower(F.hex(F.encode(F.concat(F.lit("hexed payload "), key, F.lit(" of text")), "UTF-8")))))
        .when(kind == 3, F.concat(F.lit(" "), F.lit("/+7_" * 12), F.lit("ff" * 20)))
        .otherwise(F.lit(""))
    )
    return docs.withColumn("text", F.concat("text", extra))


def plant_pages(pages: DataFrame) -> DataFrame:
    """A hidden element at the end of each tenth page."""
    extra = F.concat("html", F.lit('<div style="display: none">x</div><p hidden>y</p>'))
    return pages.withColumn("html", F.when(F.col("page_id") % 10 == 0, extra).otherwise(F.col("html")))


def camouflaged(docs: DataFrame) -> DataFrame:
    """All documents, and for each tenth a copy under a new id that only looks the same."""
    copies = docs.filter(F.col("doc_id") % 10 == 0).select((F.col("doc_id") + 1_000_000_000_000).alias("doc_id"), F.concat(F.lit("​"), "text", F.lit("  ")).alias("text"))
    return docs.select("doc_id", "text").unionByName(copies)


def raw_files(docs: DataFrame) -> DataFrame:
    """Each document as a raw file. Of ten, one has PDF bytes under .txt, one GIF bytes under .gif, one bytes after a PDF's end, one an archive inside."""
    kind = F.pmod("doc_id", F.lit(10))
    body = F.col("text")
    text = F.when(kind == 0, F.concat(F.lit("%PDF-1.7\n"), body)).when(kind == 1, F.concat(F.lit("GIF89a"), body)).when(kind == 2, F.concat(F.lit("%PDF-1.7\n"), body, F.lit("\n%%EOF\nhidden bytes"))).when(kind == 3, F.concat(body, F.lit("PK\x03\x04inside"))).otherwise(body)
    end = F.when(kind == 1, "gif").when(kind == 2, "pdf").otherwise("txt")
    return docs.select(F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit("."), end).alias("path"), F.encode(text, "UTF-8").alias("content"))


def big_files(docs: DataFrame, path: str, part_bytes: int = 32 << 20) -> None:
    """Ten files of all documents in order of doc_id, a folder each: one begins as a PDF, ends inside and goes on, one holds archives.

    A file lies in parts of about `part_bytes`, so that no task writes a tenth of the table; their names are in order.
    """
    doc_id, bucket = F.col("doc_id"), F.pmod("doc_id", F.lit(10))
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # ten rows
    heads = [r["first"] for r in firsts if r["bucket"] == 0]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(r["bytes"] or 0 for r in firsts) // part_bytes))
    none = F.lit("")
    head = F.when((bucket == 0) & doc_id.isin(heads), "%PDF-1.7\n").otherwise(none)
    inside = F.when((bucket == 3) & (doc_id % 7 == 0), "PK\x03\x04inside").otherwise(none)
    end = F.when((bucket == 0) & (doc_id % 500 == 0), "\n%%EOF\nx").otherwise(none)
    texts = docs.select(bucket.alias("bucket"), "doc_id", F.concat(head, F.coalesce("text", none), inside, end).alias("value"))
    order = ("bucket", "doc_id", F.xxhash64("value"))
    texts.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("doc_id").write.partitionBy("bucket").text(path)


def bits(message: Column) -> Column:
    """The bits of a text's bytes as 0 and 1."""
    digits = F.hex(F.encode(message, "UTF-8"))
    one = lambda i: F.lpad(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 2), 8, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), one), "")


def bit_payloads(docs: DataFrame) -> DataFrame:
    """A message in zero-width characters in each tenth document, in others in blanks and tabs at the ends of lines, or bits that are no text."""
    kind = F.pmod("doc_id", F.lit(10))
    spelled = bits(F.concat(F.lit("hidden wörds "), F.col("doc_id").cast("string")))
    at_ends = F.array_join(F.transform(F.split(F.regexp_replace(spelled, "(.{8})(?=.)", "$1,"), ","), lambda x: F.concat(F.lit("\nline"), F.translate(x, "01", " \t"))), "")
    zero_width = lambda x: F.translate(x, "01", "\u200b\u200c")
    text = F.col("text")
    inside = F.concat(F.substring(text, 1, 9), zero_width(spelled), F.expr("substring(text, 10)"))
    planted = F.when(kind == 0, inside).when(kind == 1, F.concat(text, at_ends)).when(kind == 2, F.concat(text, zero_width(F.lit("1" * 24)))).otherwise(text)
    return docs.withColumn("text", planted)


def lookalikes(docs: DataFrame) -> DataFrame:
    """All documents, and for each tenth a copy under a new id in which Cyrillic letters stand for Latin ones."""
    copies = docs.filter(F.col("doc_id") % 10 == 0).select((F.col("doc_id") + 1_000_000_000_000).alias("doc_id"), F.translate("text", "aoe", "аое").alias("text"))
    return docs.select("doc_id", "text").unionByName(copies)


STYLED = '<style>.hid-x, p#gone { display : none }</style><p class="a hid-x">h</p><p id=gone>g</p><div id=gone>shown</div>'
REFERENCES = "<p>in&#8203;visible p&#x430;ypal &amp;shy; &shy; &#128512; &#55296; &bogus;</p>"


def plant_styles(pages: DataFrame) -> DataFrame:
    """At the end of each tenth page elements that a style sheet hides, and one that it doesn't."""
    return pages.withColumn("html", F.when(F.col("page_id") % 10 == 1, F.concat("html", F.lit(STYLED))).otherwise(F.col("html")))


def plant_references(pages: DataFrame) -> DataFrame:
    """At the end of each tenth page hidden characters written as references."""
    return pages.withColumn("html", F.when(F.col("page_id") % 10 == 2, F.concat("html", F.lit(REFERENCES))).otherwise(F.col("html")))
