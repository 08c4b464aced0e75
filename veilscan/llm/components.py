"""Connected components of a table of links, by contraction in Spark.

Defined results: links of an id with itself and links with a null end are left out, as are ids with no other
link; repeated links and both directions of one count once; a component is named by its smallest id, so ties don't
arise; an empty table gives no rows; extra columns are ignored, whatever their names. There are no texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in `edges` (a, b); component is the smallest id reachable.

    Every round each id joins the neighbour of smallest hash (or stays, if its own is smaller) and the
    links are drawn anew between what is left. Order by hash lets long chains shrink by a constant
    factor a round too. Hot ids are pre-aggregated, never gathered.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = materialise(both(edges).select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
    while not edges.isEmpty():
        moves = both(edges).groupBy("a").agg(F.min(ranked("b")).alias("best"))
        moves = materialise(moves.select(F.col("a").alias("from"), F.least(ranked("a"), F.col("best")).getField("id").alias("to")))
        roots = roots.join(moves, roots["root"] == moves["from"], "left").select("id", F.coalesce("to", "root").alias("root"))
        a, b = moves.select(F.col("from").alias("a"), F.col("to").alias("a2")), moves.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(a, "a").join(b, "b").filter("a2 <> b2")
        edges = materialise(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        roots = materialise(roots)
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(least, "root").select("id", "component")
