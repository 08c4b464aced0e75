"""J1 to J4: concealment that shows only across documents, and B1 on raw files.

Defined results: a null text is listed nowhere, holds nothing and looks like nothing; empty tables give no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import patterns as P
from veilscan.functions.raw import extension, wrong_type
from veilscan.sources.tables import materialise

WORDS = r"[^\s]+"


def known_content(docs: DataFrame, watchlist: DataFrame) -> DataFrame:
    """J1: documents whose text is listed (column text of `watchlist`). Only hashes are shuffled."""
    listed = watchlist.select(F.sha2("text", 256).alias("content_hash")).distinct()
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.join(listed, "content_hash", "left_semi").select("doc_id", "content_hash")


def hidden_passage(docs: DataFrame, passages: DataFrame, block_bytes: int = 16 << 20, broadcast_bytes: int = 64 << 20, n: int = 5) -> DataFrame:
    """J2: distinct (doc_id, item_id) where a passage sits inside a document; null and empty passages sit in none.

    Equal passages are looked for once, and their items joined to what was found; `counted_passages` counts them
    without a row for each. A passage's inner words are whole words of the text that holds it, so passages of n + 2 words or more
    are met by the hash of n of them, then verified: by the rarest of their runs, so passages that begin alike don't
    all meet where one does. What is broadcast is weighed before; beyond `broadcast_bytes` it is shuffled. Shorter passages
    are looked for by one automaton for each `block_bytes` of them, which reads every text once.
    """
    items = materialise(items_of(passages))
    listed = numbered(items.select("passage").distinct())
    found = held(docs, listed, block_bytes, broadcast_bytes, n)
    return found.join(items.join(listed.select("pid", "passage"), "passage"), "pid").select("doc_id", "item_id").distinct()


def counted_passages(docs: DataFrame, passages: DataFrame, block_bytes: int = 16 << 20, broadcast_bytes: int = 64 << 20, n: int = 5) -> DataFrame:
    """J2, counted: (doc_id, n_items, least) of each document that holds a passage: its distinct items and the smallest.

    Items that share a passage are counted with it once and for all, so no row is made for each of them in each document.
    Only an item of several passages is met by document, since two of its passages may sit in one.
    """
    items = materialise(items_of(passages))
    several = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("item_id").alias("id"))
    several = items.join(materialise(several), F.col("item_id").eqNullSafe(F.col("id")), "left").withColumn("alone", F.col("id").isNull() & F.col("item_id").isNotNull())
    own = lambda x: F.when(F.col("alone"), x)
    counts = several.groupBy("passage").agg(F.count(own(F.col("item_id"))).alias("n_items"), F.min(own(F.col("item_id"))).alias("least"), F.bool_or(~F.col("alone")).alias("shared"))
    listed = numbered(counts)
    found = materialise(held(docs, listed, block_bytes, broadcast_bytes, n))
    sums = found.join(listed.select("pid", "n_items", "least"), "pid").select("doc_id", "n_items", "least")
    rest = several.filter(~F.col("alone")).join(listed.filter("shared").select("pid", "passage"), "passage").select("pid", "item_id")
    one = F.when(F.col("item_id").isNull(), 0).otherwise(1).cast("long")
    rest = found.join(rest, "pid").select("doc_id", "item_id").distinct().select("doc_id", one.alias("n_items"), F.col("item_id").alias("least"))
    return sums.unionByName(rest).groupBy("doc_id").agg(F.sum("n_items").alias("n_items"), F.min("least").alias("least"))


def items_of(passages: DataFrame) -> DataFrame:
    """Distinct (item_id, passage) of `passages` (item_id, text) but null and empty ones."""
    return passages.filter("text IS NOT NULL AND text <> ''").select("item_id", F.col("text").cast("string").alias("passage")).distinct()


def numbered(listed: DataFrame) -> DataFrame:
    """`listed`, of distinct passages, written with their words and a number each (pid)."""
    words = F.regexp_extract_all("passage", F.lit(WORDS), F.lit(0))
    return materialise(listed.withColumn("words", words).withColumn("pid", F.monotonically_increasing_id()))


def held(docs: DataFrame, listed: DataFrame, block_bytes: int, broadcast_bytes: int, n: int) -> DataFrame:
    """Distinct (doc_id, pid) of the passages (passage, words, pid) that sit inside a document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n_words = F.size("words")
    found = found_long(docs, listed.filter(n_words >= n + 2), n, broadcast_bytes)
    return found.unionByName(found_short(docs, listed.filter(n_words < n + 2), block_bytes)).distinct()


def light(df: DataFrame, most_bytes: int, size: Column) -> DataFrame:
    """`df`, a written table, to be broadcast if its rows' sizes sum up to `most_bytes` or less."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes else df


def found_long(docs: DataFrame, listed: DataFrame, n: int, broadcast_bytes: int) -> DataFrame:
    """(doc_id, pid) of passages of n + 2 words or more (passage, words, pid)."""
    joined = lambda i: F.xxhash64(F.array_join(F.slice("words", i, n), " "))
    # Without the first and the last word, which may stand inside words of a text.
    inner = F.array_distinct(F.transform(F.sequence(F.lit(2), F.size("words") - n), joined))
    keys = materialise(listed.select("pid", F.explode(inner).alias("key")))
    wanted = light(materialise(keys.select("key").distinct()), broadcast_bytes, F.lit(8))
    grams = F.expr(f"array_distinct(transform(sequence(1, greatest(size(words) - {n - 1}, 1)), i -> xxhash64(array_join(slice(words, i, {n}), ' '))))")
    keyed = docs.select("doc_id", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words")).select("doc_id", F.explode(grams).alias("key"))
    met = materialise(keyed.join(wanted, "key", "left_semi").distinct())
    times = met.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    rarest = keys.join(times, "key", "left").groupBy("pid").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key")).alias("least"))
    chosen = rarest.filter("least.times > 0").select("pid", F.col("least.key").alias("key"))  # else no text has all of its words
    pairs = met.join(chosen, "key").select(F.col("doc_id").alias("id"), "pid")
    pairs = materialise(pairs.join(listed.select("pid", "passage"), "pid"))
    pairs = light(pairs, broadcast_bytes, F.octet_length("passage") + 24)
    return docs.join(pairs, docs["doc_id"].eqNullSafe(F.col("id"))).filter(F.expr("contains(text, passage)")).select("doc_id", "pid")


def found_short(docs: DataFrame, listed: DataFrame, block_bytes: int) -> DataFrame:
    """(doc_id, pid) of passages of few words (passage, pid), by an Aho-Corasick automaton of each block of them."""
    spark = docs.sparkSession
    total = listed.agg(F.sum(F.octet_length("passage") + 24)).first()[0] or 0
    blocks = -(-total // block_bytes)
    types = (docs.schema["doc_id"].dataType.simpleString(), "long")
    met = spark.createDataFrame([], f"doc_id {types[0]}, pid {types[1]}")
    for i in range(blocks):
        block = listed.filter(F.pmod(F.xxhash64("pid"), F.lit(blocks)) == i).select("pid", "passage").toArrow()  # about `block_bytes`
        packed = pa.BufferOutputStream()
        with pa.ipc.new_stream(packed, block.schema) as out:
            out.write_table(block)
        shared = spark.sparkContext.broadcast(packed.getvalue().to_pybytes())
        met = met.unionByName(docs.mapInArrow(lambda batches, shared=shared: search(batches, shared.value), f"doc_id {types[0]}, pid {types[1]}"))
    return met


def search(batches: Iterator[pa.RecordBatch], block: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, pid) of each passage of a block (an Arrow stream of pid and distinct passage) in each text (doc_id, text), once a text.

    A task holds the automaton, one text and the pairs of a batch, not the passages or a batch's texts as objects.
    """
    import ahocorasick

    listed = pa.ipc.open_stream(block).read_all()
    pids = np.asarray(listed["pid"])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, passage in enumerate(listed["passage"]):
        automaton.add_word(passage.as_py(), i)
    automaton.make_automaton()
    for batch in batches:
        rows, places = array("q"), array("q")
        for i, text in enumerate(batch["text"]):
            text = text.as_py()
            own = {x for _, x in automaton.iter(text)} if text and len(pids) else ()
            rows.extend([i] * len(own))
            places.extend(own)
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(np.frombuffer(rows, np.int64))), pa.array(pids[np.frombuffer(places, np.int64)])], names=["doc_id", "pid"])


def visible_text(text: Column) -> Column:
    """What a reader sees: invisible characters gone, white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, P.INVISIBLE, ""), r"\s+", " "))


def skeleton(text: Column) -> Column:
    """The visible text with letters that look like Latin ones as those; accents stay, as they show."""
    pairs = {chr(a): chr(b) for a, b in P.LOOKALIKES.items()}
    return F.translate(visible_text(text), "".join(pairs), "".join(pairs.values()))


def camouflaged_copies(docs: DataFrame) -> DataFrame:
    """J3: groups of documents that look the same, letter by letter, but differ in bytes. Hashes are shuffled, never texts; empty looks are dropped."""
    shown = docs.select("doc_id", F.sha2("text", 256).alias("raw_hash"), F.sha2(skeleton(F.col("text")), 256).alias("visible_hash"))
    empty = hashlib.sha256(b"").hexdigest()
    seen = shown.filter(F.col("visible_hash") != empty).groupBy("visible_hash", "raw_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return seen.groupBy("visible_hash").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_forms"), F.min("first").alias("first_doc_id")).filter("n_forms > 1")


def rescan_only_new(docs: DataFrame, done: DataFrame) -> DataFrame:
    """J4: (doc_id, content_hash) of documents not in `done` (doc_id, content_hash) with this content."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.join(done.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def type_mismatch(files: DataFrame) -> DataFrame:
    """B1: files (path, content) whose leading bytes are those of another type than the extension says."""
    spark = files.sparkSession
    known = F.broadcast(spark.createDataFrame(list(P.SIGNATURES.items()), "actual string, magic string"))  # a fixed list
    head = F.hex(F.substring("content", 1, 8))
    named = files.select("path", extension(F.col("path")).alias("extension"), head.alias("head"))
    typed = named.join(known, F.expr("startswith(head, magic)"), "left").drop("magic")
    return typed.select("path", "extension", "actual", wrong_type(F.col("extension"), F.col("actual")).alias("mismatch"))
