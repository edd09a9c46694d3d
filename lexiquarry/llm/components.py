"""Connected components by randomised contraction, entirely as DataFrames.

In each round every vertex points to the neighbour with the lowest hash under
that round's salt (or stays, if its own is lower); the graph is contracted along
the pointers. A constant share of the vertices disappears per round whatever
the shape of the graph, so chains and stars alike take a logarithmic number of
rounds. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiquarry.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(id, component)`` for each id in an edge.

    ``component`` is the smallest id reachable. Self-loops, repeated edges and
    edges with a null end are ignored; without edges the result is empty.
    """
    left = scratch.keep(
        edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    steps: list[DataFrame] = []
    while left.take(1):
        salt = F.lit(len(steps))
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", salt).alias("h"), "v")).alias("m"))
        own = F.struct(F.xxhash64("u", salt).alias("h"), F.col("u").alias("v"))
        step = scratch.keep(low.select(F.col("u").alias("id"), F.least("m", own)["v"].alias("to")))
        steps.append(step)
        right = step.select(F.col("id").alias("v"), F.col("to").alias("tv"))
        after = (
            left.join(step.withColumnRenamed("id", "u"), "u")
            .join(right, "v")
            .select(F.least("to", "tv").alias("u"), F.greatest("to", "tv").alias("v"))
            .where("u <> v")
            .distinct()
        )
        done, left = left, scratch.keep(after)
        scratch.drop(done)
    if not steps:
        return left.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = steps[0]
    for step in steps[1:]:
        nxt = step.select(F.col("id").alias("to"), F.col("to").alias("further"))
        roots = roots.join(nxt, "to", "left").select("id", F.coalesce("further", "to").alias("to"))
    roots = scratch.keep(roots)
    least = roots.groupBy("to").agg(F.min("id").alias("component"))
    # a root may be the least id of its group and still point to itself: it is in steps[0] as well
    out = scratch.keep(roots.join(least, "to").select("id", "component"))
    scratch.drop(roots, *steps)
    return out
