"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, of every node on an edge (a, b).

    Every round links nodes to the smallest neighbour known, so hubs need no list of neighbours: a minimum by node and a
    join suffice. Joins are sorted ones, as a written table's compressed size says little about what a broadcast would take. Self-links and repeated edges do no harm; rows with a null end are left out.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    known = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, now = now, written(linked.where("u <> v").distinct(), "edges")
        discard(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == known:
            break
        known = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
