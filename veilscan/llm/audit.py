"""Filter interaction audit: what each of five filters removes, in every order they could run in.

Direct relational replay. Each document's failing filters are crossed with the 120 orders (a broadcast
table of fixed size), which gives the step of its first failure in each; the five steps are exploded and
counted by (part, order, step). Spark combines the counts before the shuffle, so what is shuffled is at
most 600 rows a part and task, however many documents there are. No Python runs.

Whether a text repeats a smaller doc_id's is a count by hash, joined back: hashes are shuffled, never texts.
Only hashes that occur twice or more are joined, and hashes with most rows are salted.

Defined results: a null text is empty (it fails A, and E where a smaller doc_id's text is empty or null);
a null doc_id is smaller than none, and no doc_id is smaller than it; repeated rows count each, and rows
that share doc_id and text aren't copies of one another; a null source is the part "", which it shares
with an empty one; several labels of a doc_id count as 1 if one of them is; whole texts are read, however
long; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import WORD_RE, materialise

FILTERS = "ABCDE"
#: Rows that share a hash above which they are dealt to several tasks, and to how many.
HOT_ROWS, SALTS = 10_000, 64


def conditions(text: Column) -> dict[str, Column]:
    """A to D, as whether a text fails; E needs the whole table."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD_RE})"))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(2) * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row of `docs` (doc_id, text, source): bit i of mask is set if the row fails filter i."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    failing = conditions(F.col("text_"))
    mask = sum((F.when(failing[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")), F.lit(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text_"))
    own = materialise(own.select("doc_id", "part", F.sha2("text_", 256).alias("hash"), mask.alias("mask")))
    groups = materialise(own.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL"))
    # A hash with many rows goes to SALTS tasks, each of which has its first doc_id.
    salts = F.when(F.col("n") > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hot = groups.filter(F.col("n") > HOT_ROWS).select("hash").withColumn("hot", F.lit(True))
    groups = groups.select("hash", "first", F.explode(salts).alias("salt"))
    # At most one hash in HOT_ROWS rows is hot; they are broadcast while counted to be few.
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    own = own.join(hot, "hash", "left").select("doc_id", "part", "hash", "mask", salt.alias("salt"))
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    own = own.join(groups, ["hash", "salt"], "left").select("doc_id", "part", (F.col("mask") + F.when(repeats, 16).otherwise(0)).alias("mask"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = own.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    unlabelled = own.filter("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return joined.unionByName(unlabelled).select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def orders(like: DataFrame) -> DataFrame:
    """All orders of the filters: filter_order, and for each step its number, letter and bit. 120 rows."""
    rows = ["".join(p) for p in itertools.permutations(FILTERS)]
    given = like.sparkSession.createDataFrame([(r,) for r in rows], "filter_order string")
    steps = F.expr("transform(sequence(1, 5), i -> struct(i AS step, substring(filter_order, i, 1) AS letter, shiftleft(1, ascii(substring(filter_order, i, 1)) - 65) AS bit))")
    return given.select("filter_order", steps.alias("steps"))


def replay(flagged: DataFrame) -> DataFrame:
    """Counts by part, order and step of `flagged` (part, mask, good, toxic)."""
    crossed = flagged.crossJoin(F.broadcast(orders(flagged)))
    fails_at = lambda i: F.col("mask").bitwiseAND(F.col("steps")[i]["bit"]) != 0
    first = F.coalesce(*(F.when(fails_at(i), i + 1) for i in range(5)), F.lit(6))
    steps = crossed.select("part", "filter_order", "mask", "good", "toxic", first.alias("first"), F.inline("steps"))
    here, fails = F.col("first") == F.col("step"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    n = lambda when, name: F.count(F.when(when, 1)).alias(name)
    return steps.groupBy("part", "filter_order", "step", "letter").agg(
        n(F.col("first") > F.col("step"), "kept"),
        n(here, "removed"),
        n(fails & (F.col("first") < F.col("step")), "redundant"),
        n(F.col("mask") == F.col("bit"), "unique_fails"),
        n(here & F.col("good"), "good_lost"),
        n(here & F.col("toxic"), "toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of all rows of `docs` with each filter's removals summed over all orders (shapley)."""
    counted = materialise(replay(flags(docs, labels)))
    shares = counted.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return counted.join(shares, ["part", "letter"]).select(*names)
