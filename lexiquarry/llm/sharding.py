"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``NODES`` points of a ring, each the start of an arc. A row
goes to the owner of the arc that its text's hash falls in. A shard has room
for its even share of all rows; rows beyond it continue clockwise, to the
owners of the next arcs. The law is ``rows``: counts differ by one at most.

Only the number of rows per arc, a fixed number of figures, meets on the
driver, where the overflow is worked out. A row then needs its rank in its arc,
by hash order of doc_id and text; arcs are cut into blocks of about ``ROWS``
rows, so an arc that holds a third of all rows, as a large group of equal texts
does, spreads over as many tasks as its size asks for. Rows equal in doc_id and
text are counted before and dealt in pieces of at most ``ROWS``.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexiquarry.llm.scratch import Scratch

NODES, ROWS = 64, 4096
_CELLS = 1 << 12


def ring(shards: int) -> list[tuple[int, int]]:
    """(point, shard), clockwise; points are unsigned 32-bit."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(NODES))


def flows(demand: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): where the rows of each arc go.

    In round k, arcs send what is left to the owner of the k-th arc clockwise,
    until that shard is full; arcs go in ring order.
    """
    total = sum(demand.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, sent = [0] * shards, {a: 0 for a in demand}
    out: list[tuple[int, int, int, int, int]] = []
    left = sorted(a for a, n in demand.items() if n)
    for k in range(len(owners)):
        for a in left:
            s = owners[(a + k) % len(owners)]
            take = min(demand[a] - sent[a], room[s] - used[s])
            if take > 0:
                out.append((a, sent[a], sent[a] + take, s, used[s]))
                sent[a] += take
                used[s] += take
        left = [a for a in left if sent[a] < demand[a]]
        if not left:
            break
    return out


def assign(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text, none if it is null, plus 8. text_crc32 of a
    null text is that of the empty one. slot: gapless from 0 in each shard.
    grown_shard is null: under this law another shard takes an even share of
    all others. Equal texts share a place on the ring and so a shard, until
    it is full. Rows that repeat a doc_id get slots of their own; a null doc_id
    is a row like others. Other columns
    are ignored; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    scratch = Scratch(spark)
    points = ring(shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.expr("pmod(xxhash64(coalesce(cast(text as string), '')), 4294967296L)").alias("place"),
    )
    # the arc of a place: the last point at or before it (the last arc runs over 0)
    starts = [p for p, _ in points]
    span = (1 << 32) // _CELLS
    near = []
    for k in range(_CELLS):
        a, b = bisect.bisect_right(starts, k * span) - 1, bisect.bisect_right(starts, (k + 1) * span - 1)
        near.append((k, [(k * span, a % len(points)), *((starts[x], x) for x in range(a + 1, b))]))
    cells = spark.createDataFrame(near, "cell long, near array<struct<start: long, arc: int>>")
    slim = slim.withColumn("cell", F.expr(f"place div {span}")).join(F.broadcast(cells), "cell")
    slim = slim.withColumn("arc", F.expr("element_at(filter(near, x -> x.start <= place), -1).arc")).drop("near", "place", "cell")
    slim = slim.groupBy("doc_id", "size", "text_crc32", "arc").agg(F.count("*").alias("times"))
    slim = slim.withColumn("piece", F.explode(F.expr(f"sequence(0L, (times - 1) div {ROWS})")))
    slim = slim.withColumn("times", F.expr(f"least({ROWS}L, times - piece * {ROWS})")).withColumn("h", F.xxhash64("doc_id", "text_crc32", "size", "piece"))
    slim = scratch.keep(slim)
    demand = {r["arc"]: r["n"] for r in slim.groupBy("arc").agg(F.sum("times").alias("n")).collect()}  # shards * NODES at most
    parts = [(a, -(-n // ROWS)) for a, n in demand.items()]
    cut = spark.createDataFrame(parts, "arc int, parts long")
    rows = slim.join(F.broadcast(cut), "arc").withColumn("part", F.expr("pmod(h, parts)"))
    sums = rows.groupBy("arc", "part").agg(F.sum("times").alias("n"))
    sums = sums.select("arc", "part", (F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")).alias("before"))
    rows = rows.join(sums, ["arc", "part"])
    within = Window.partitionBy("arc", "part").orderBy("h", "doc_id", "text_crc32", "size", "piece").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rank", F.col("before") + F.sum("times").over(within) - F.col("times"))
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, times - 1)"))).withColumn("rank", F.col("rank") + F.col("copy"))
    flow = spark.createDataFrame(
        flows(demand, [s for _, s in points], shards),
        "arc int, from long, to long, shard int, first long",
    )
    flow = flow.groupBy("arc").agg(F.collect_list(F.struct("from", "to", "shard", "first")).alias("flow"))
    rows = rows.join(F.broadcast(flow), "arc").withColumn("f", F.expr("filter(flow, f -> rank >= f.from and rank < f.to)[0]"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("f.shard").alias("shard"),
        (F.col("f.first") + F.col("rank") - F.col("f.from")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
