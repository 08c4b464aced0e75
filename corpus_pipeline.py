"""Corpus pipeline: from the table documents to packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written and read again as the next one's docs. All but the last return the columns of docs.

1. quality: rows that the pairwise ranking puts below its threshold go; it is fitted on all labelled rows.
2. near_duplicates: of each group of five-word shingle sets linked at 0.8 or more, the row of
   smallest doc_id stays. Rows that share a doc_id are one document, whose texts join their groups, and
   one of them stays (the first in order of texts). Rows without a doc_id or words stay.
3. secrets: spans found are replaced by their kind; n_chars follows.
4. mix: every row as often as the source targets take it (0 to 3 times).
5. packing: pieces of at most 2048 tokens with their sequence and offset.

Defined results, in every stage: a null text is empty (1 scores it as that; 2 and 3 keep it; 4 counts it
as size 0 and takes it as often as its source; 5 gives it a piece of the end id alone); whole texts are
read, however long; an empty table gives an empty one; equal scores and sizes are treated alike; columns
that a stage doesn't use come through, whatever their names, up to packing, which returns its own.

SQL can't express tokens, the ranking or the cube method, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import jaccard, mixing, packing, quality, secrets
from veilscan.llm._common import materialise, table
from veilscan.llm.queries import SEQUENCE_LENGTH, tokenizer_path
from veilscan.sources.tables import BATCH, others


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(BATCH, "4m")  # for the session, whose job this is: stages are planned when they are written
    ranker = quality.train_on(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, ranker)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.Join(k=5, num=80, den=100).run(docs)
    heads = materialise(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    alone, several = (heads.filter(x).select("doc_id") for x in ("n = 1", "n > 1"))
    if heads.count() <= BROADCAST_ROWS:
        alone, several = F.broadcast(alone), F.broadcast(several)
    kept = docs.join(alone, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    # Repeated rows: one stays, by partial minima, so that no task holds all rows of an id.
    rows = docs.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.struct(*others(docs)).alias("row"))
    order = F.struct(F.col("row.text").isNull(), F.col("row.text"))
    first = rows.groupBy("id").agg(F.min_by("row", order).alias("row")).select("row.*")
    return kept.unionByName(first).select(*others(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), SEQUENCE_LENGTH)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mix", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None
# Ids that may be broadcast (8 bytes each), counted before; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
