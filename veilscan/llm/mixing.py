"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words. A document is taken floor(f) times, f = target / source
size, and once more with the fractional part as inclusion probability. The cube method moves the
vector of probabilities through the null space of the constraints (documents and words of the
source) until at most two of them are fractional; these land so that the words come nearest.

At scale the flight runs in hashed blocks of a source; what stays fractional (at most two documents
of a block) meets in the next, far smaller round, until one block of a source is left.

Nothing passes the driver but sums and a number a partition: targets are found by levels in Spark.

Defined results: a null or empty text has size 0 and is taken 0 words; whole texts are counted, however
long; a null source is a source of its own, last in order; a null doc_id is a document like others;
repeated rows count once each, and equal rows may be taken unequally often (ties: which of them, depends on where
they lie, how many doesn't); an empty table gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import WORD_RE, materialise, ranked
from veilscan.sources.tables import others

WEIGHTS = (5, 2, 1)


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: keeps sum(p) and sum(p * size); at most two entries stay fractional."""
    p, size = p.astype(float).tolist(), size.astype(float).tolist()
    eps = 1e-9
    held: list[int] = []
    for i, x in enumerate(p):
        if eps < x < 1 - eps:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])  # null vector of the rows (1, 1, 1) and sizes
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        pairs = [(k, v) for k, v in zip(held, u, strict=True) if v]
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in pairs)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in pairs)
        step = up if rng.random() * (up + down) < down else -down  # a fair bet: every p keeps its mean
        for k, v in pairs:
            p[k] = min(1.0, max(0.0, p[k] + step * v))
        held = [k for k in held if eps < p[k] < 1 - eps]
    return np.array([0.0 if x <= eps else 1.0 if x >= 1 - eps else x for x in p])


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing phase: the few fractional entries become 0 or 1, words nearest to what they stood for."""
    loose = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[loose] * size[loose]).sum())
    best = min(range(1 << len(loose)), key=lambda m: (abs(sum(float(size[k]) for j, k in enumerate(loose) if m >> j & 1) - want), m))
    p = p.copy()
    for j, k in enumerate(loose):
        p[k] = best >> j & 1
    return p


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, place): sources in order of code points, null last, numbered from 0 without one task for all."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    # The id is the partition's number shifted by 33 bits, and the row's place in it.
    laid = materialise(total.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    starts, before = [], 0
    for key, n in sizes:
        starts.append((key, before - (key << 33)))
        before += n
    shift = F.broadcast(sized.sparkSession.createDataFrame(starts, "part long, shift long"))
    return laid.withColumn("part", part).join(shift, "part").select("source", "source_size", (F.col("at") + F.col("shift")).alias("place"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) of a table (source, size); only sums reach the driver.

    Targets are level * weight, none above cap * size. Each round fixes the sources that the level puts
    above their cap and shares the rest anew, until no more are fixed.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = materialise(ranked_sources(sized).withColumn("weight", weight))
    level, full = 0.0, -1
    while True:
        # A source is full once its cap is below the level; levels only rise.
        over = (F.lit(cap) * F.col("source_size") < F.lit(level) * F.col("weight")) | (F.col("source_size") == 0)
        got = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.lit(cap) * F.col("source_size"))).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("full")).first()
        if got["full"] == full or not got["weight"]:
            break
        level, full = (float(got["all"] or 0) - float(got["fixed"] or 0)) / got["weight"], got["full"]
    return rows.select("source", "source_size", F.least(F.lit(cap) * F.col("source_size"), F.lit(level) * F.col("weight")).alias("target"))


UNITS = "row_id long, doc_id long, mark long, salt long, source string, size long, source_size long, target double, base int, p double"


def _round(units: DataFrame, block: int) -> DataFrame:
    """One flight in blocks of about `block` units of a source; a source with one block lands as well."""
    n = units.groupBy("source").agg(F.count(F.lit(1)).alias("units_"))
    blocks = n.select(F.col("source").alias("source_"), F.ceil(F.col("units_") / block).cast("int").alias("blocks_"))
    dealt = units.join(blocks, units["source"].eqNullSafe(blocks["source_"])).drop("source_")
    dealt = dealt.withColumn("block_", F.pmod(F.xxhash64("mark", "salt"), F.col("blocks_")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "size", "p", "row_id"], kind="stable")
        seed = [int(pdf["block_"].iloc[0]), len(pdf), int(pdf["size"].sum())]
        p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy()
        p = fly(p, size, np.random.default_rng(seed))
        if pdf["blocks_"].iloc[0] == 1:
            p = land(p, size)
        return pdf.assign(p=p).drop(columns=["blocks_", "block_"])

    return materialise(dealt.groupBy("source", "block_").applyInPandas(run, UNITS))


def draw(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, block: int = 4000, broadcast_rows: int = 100_000) -> DataFrame:
    """How often each unit of `sized` (as `measured` gives it) is taken.

    Adds source_size, target, copies (0 to cap) and taken = copies * size.
    """
    targets = materialise(source_targets(sized, weights, cap).withColumnRenamed("source", "source_"))
    targets = F.broadcast(targets) if targets.count() <= broadcast_rows else targets
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(ratio + F.lit(1e-12)).cast("int")
    units = sized.join(targets, sized["source"].eqNullSafe(targets["source_"]))
    units = units.select("row_id", "doc_id", "mark", "salt", "source", "size", "source_size", "target", base.alias("base"), F.greatest(ratio - base, F.lit(0.0)).alias("p"))
    done, state = [], _round(units, block)
    while True:
        loose = state.filter((F.col("p") > 0) & (F.col("p") < 1))
        if loose.isEmpty():
            done.append(state)
            break
        done.append(state.filter((F.col("p") <= 0) | (F.col("p") >= 1)))
        state = _round(loose, block)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("base") + F.col("p").cast("int")).cast("int")
    return out.select("row_id", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def measured(docs: DataFrame, row_id: Column | None = None, often: int = 1000) -> DataFrame:
    """(row_id, doc_id, mark, salt, source, size) of `docs` (doc_id, text, source), written once.

    mark is a hash of the row's content, so that a draw doesn't depend on where rows lie. Equal rows
    share it; where there are more than `often`, salt numbers them from 0, so that no block holds them all:
    which of them has which number depends on where they lie, but they are equal.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    rows = docs.select((F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = materialise(rows)
    many = materialise(rows.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > often))
    if many.isEmpty():
        return rows.withColumn("salt", F.lit(0).cast("long"))
    buckets = F.least(F.ceil(F.col("rows") / 1000), F.lit(100_000))
    equal = ranked(rows.join(many, "mark"), "mark", buckets).select(*rows.columns, F.col("rank").cast("long").alias("salt"))
    few = rows.join(many.select("mark"), "mark", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("salt"))
    return materialise(few.unionByName(equal))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, block: int = 4000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with its own columns.

    Rows are written with a number; the draw works on numbers, and the texts meet it in one join.
    """
    numbered = materialise(docs.select(F.struct(*others(docs)).alias("row_"), F.monotonically_increasing_id().alias("id_")))
    sized = measured(numbered.select("row_.doc_id", "row_.source", "row_.text", "id_"), F.col("id_"))
    copies = materialise(draw(sized, weights, cap, block).filter("copies > 0").select("row_id", "copies"))
    copies = F.broadcast(copies) if copies.count() <= broadcast_rows else copies
    taken = numbered.join(copies, numbered["id_"] == copies["row_id"])
    return taken.select("row_", F.explode(F.sequence(F.lit(1), "copies"))).select("row_.*")
