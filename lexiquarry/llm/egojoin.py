"""Embedding near-dedup by an epsilon grid order join.

Cosine >= c between unit vectors is a distance of at most eps = sqrt(2 - 2c).
Equal vectors collapse to one with a multiplicity. Vectors are turned onto their
principal axes and sorted by their cells, of width eps, on the leading axes: the
epsilon grid order. The sequence is cut into intervals of at most ``INTERVAL``
vectors. Pairs of intervals are found by descending a tree of bounding boxes,
level by level and as joins, leaving out pairs whose boxes are farther apart
than eps. A task joins a tile of ``TILE`` intervals, which it holds, with as many
others, which pass by one at a time, so an interval is sent once a tile and not
once a partner. Two intervals are joined by halving both recursively under the
same test down to blocks of ``LEAF`` vectors, which are compared by a matrix
product; products near the threshold are computed again in double precision.

A task returns, for each vector, the number of its links there, and a spanning
forest of the links - never the links one by one. Vectors link only with
vectors of their own length (number of components).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lexiquarry.llm.components import components
from lexiquarry.llm.scratch import Scratch

INTERVAL, LEAF, AXES, FAN, TILE = 8192, 512, 6, 16, 16
#: Components in an interval, about: 1 MB of doubles.
_WEIGHT = 1 << 17
_MARGIN = 1e-4


def _matrix(column: pa.Array, d: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def _checked(kind: str):
    """vec_id, number of components (0: links with nothing) and the components, as ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                dims = pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                value = part.column(1).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                at = np.concatenate(([0], np.cumsum(dims)))
                good = np.zeros(len(dims), bool)
                full = np.flatnonzero(dims)
                if len(full):
                    good[full] = np.logical_and.reduceat(np.isfinite(value), at[full]) & np.logical_or.reduceat(value != 0, at[full])
                value = value.astype(kind)
                raw = [value[at[i] : at[i + 1]].tobytes() if good[i] else b"" for i in range(len(dims))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(good, dims, 0).astype(np.int32)), pa.array(raw, pa.binary())], ["vec_id", "dim", "x"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(d: int, kind: str):
    """Sums of products and of components and the number of vectors, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                u = _unit(_matrix(batch.column(0).slice(a, 4096), d, kind))
                m, s, n = m + u.T @ u, s + u.sum(axis=0), n + len(u)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((m.reshape(-1), s, [n])).tobytes()], pa.binary())], ["m"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            own = np.frombuffer(x.as_buffer(), np.float64)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


def _placed(d: int, kind: str, axes: np.ndarray, eps: float):
    k = min(AXES, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                p = _unit(_matrix(part.column(3), d, kind)) @ axes
                cells = [pa.array(np.floor(p[:, j] / eps).astype(np.int32)) for j in range(k)]
                # the order inside a cell: finer steps of the first axis keep intervals short along it
                yield pa.RecordBatch.from_arrays([*part.columns, *cells, pa.array(p[:, 0])], [*part.schema.names, *(f"c{j}" for j in range(k)), "fine"])

    return run


def _interval(d: int, kind: str, axes: np.ndarray):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        x = _matrix(table.column("x"), d, kind)
        p = _unit(x) @ axes
        whole = lambda name: pa.array([table.column(name).to_numpy().astype(np.int64).tobytes()], pa.binary())
        return pa.table(
            {
                "node": pa.array([key[0].as_py()], pa.int64()),
                "lo": pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())),
                "hi": pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64())),
                "hs": whole("h"),
                "ids": whole("id"),
                "times": whole("times"),
                "xs": pa.array([x.tobytes()], pa.binary()),
            }
        )

    return run


class Side:
    """An interval: vectors as they are and as units, and a box for each block of ``LEAF``."""

    def __init__(self, axes: np.ndarray, h: np.ndarray, ids: np.ndarray, times: np.ndarray, x: np.ndarray):
        self.h, self.ids, self.times, self.x = h, ids, times, x
        unit = _unit(x)
        p = unit @ axes
        self.unit, at = unit.astype(np.float32), range(0, len(x), LEAF)
        self.lo = np.array([p[k : k + LEAF].min(axis=0) for k in at])
        self.hi = np.array([p[k : k + LEAF].max(axis=0) for k in at])

    def __len__(self) -> int:
        return len(self.h)


class Tile:
    """Intervals that are held, and the links of those that pass by."""

    def __init__(self, cosine: float):
        self.cosine, self.eps2 = cosine, (2 - 2 * cosine) * (1 + 1e-9) + 1e-9
        self.held: dict[int, tuple[Side, int]] = {}
        self.size = 0
        self.count, self.label = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.edges: list[tuple[int, int]] = []

    def hold(self, node: int, side: Side) -> None:
        if node not in self.held:
            self.held[node] = side, self.size
            self.size += len(side)

    def meet(self, node: int, side: Side | None, partners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and numbers of links of a passing interval; those of a held one are counted where it is held."""
        if len(self.count) < self.size:
            self.count = np.zeros(self.size, np.int64)
            self.label = np.arange(self.size)
        right, shift = self.held.get(node, (side, self.size))
        passing = shift == self.size
        if passing:
            self.count = np.concatenate((self.count, np.zeros(len(right), np.int64)))
            self.label = np.concatenate((self.label, self.size + np.arange(len(right))))
        for a in partners:
            left, at = self.held[a]
            self._descend(left, at, right, shift, 0, len(left.lo), 0, len(right.lo), a == node)
        if not passing:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self.count[self.size :]
        self.count, self.label = self.count[: self.size], self.label[: self.size]
        hit = np.flatnonzero(own)
        return right.h[hit], own[hit]

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for side, at in self.held.values():
            own = self.count[at : at + len(side)]
            hit = np.flatnonzero(own)
            yield side.h[hit], own[hit]

    def _descend(self, left: Side, at: int, right: Side, shift: int, a0: int, a1: int, b0: int, b1: int, same: bool) -> None:
        """Ranges are in blocks."""
        if a0 >= a1 or b0 >= b1 or (same and b1 <= a0):
            return
        low, high = left.lo[a0:a1].min(axis=0), left.hi[a0:a1].max(axis=0)
        gap = np.maximum(0, np.maximum(low - right.hi[b0:b1].max(axis=0), right.lo[b0:b1].min(axis=0) - high))
        if float(gap @ gap) > self.eps2:
            return
        if a1 - a0 == 1 and b1 - b0 == 1:
            self._leaf(left, at, right, shift, a0, b0, same)
            return
        a = [(a0, a1)] if a1 - a0 == 1 else [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)]
        b = [(b0, b1)] if b1 - b0 == 1 else [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)]
        for x in a:
            for y in b:
                self._descend(left, at, right, shift, *x, *y, same)

    def _leaf(self, left: Side, at: int, right: Side, shift: int, a: int, b: int, same: bool) -> None:
        a, b = a * LEAF, b * LEAF
        product = left.unit[a : a + LEAF] @ right.unit[b : b + LEAF].T
        i, j = np.nonzero(product >= self.cosine - _MARGIN)
        near = product[i, j] < self.cosine + _MARGIN
        i, j = i + a, j + b
        if same:
            ok = j > i
            i, j, near = i[ok], j[ok], near[ok]
        if near.any():
            x, y = (z.astype(float) for z in (left.x[i[near]], right.x[j[near]]))
            x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
            ok = ~near
            ok[near] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= self.cosine
            i, j = i[ok], j[ok]
        if not len(i):
            return
        np.add.at(self.count, i + at, right.times[j])
        np.add.at(self.count, j + shift, left.times[i])
        label = self.label
        cut = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)]))
        for k in range(len(cut) - 1):
            # links come by their first vector; what is one tree already is passed over at once
            x, ys = int(i[cut[k]]), j[cut[k] : cut[k + 1]]
            new, first = np.unique(label[ys + shift], return_index=True)
            own = label[x + at]
            for z, y in zip(new.tolist(), ys[first].tolist(), strict=True):
                if z != own:
                    # a label of what is held is never given up for one of what passes by
                    label[label == z] = own
                    self.edges.append((int(left.ids[x]), int(right.ids[y])))


def _joined(d: int, kind: str, axes: np.ndarray, cosine: float):
    """Rows ordered by (ta, tb, side, node): the intervals of a tile (side 0), and those that it meets with their partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tile = None, Tile(cosine)

        def rows(counts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, n = (np.concatenate([c[k] for c in counts]) if counts else np.zeros(0, np.int64) for k in (0, 1))
            e = np.array(tile.edges, np.int64).reshape(-1, 2)
            tile.edges = []
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [(pa.array(h), none(len(e))), (pa.array(n), none(len(e))), (none(len(h)), pa.array(e[:, 0])), (none(len(h)), pa.array(e[:, 1]))]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["h", "n", "u", "v"])

        for batch in batches:
            for k in range(batch.num_rows):
                ta, tb, side, node = (batch.column(c)[k].as_py() for c in range(4))
                if (ta, tb) != task:
                    yield rows(list(tile.counted()))
                    task, tile = (ta, tb), Tile(cosine)
                longs = [np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in range(4, 7)]
                make = lambda z=longs, y=batch.column(7)[k]: Side(axes, *z, np.frombuffer(y.as_buffer(), kind).reshape(-1, d))
                if side == 0:
                    tile.hold(node, make())
                else:
                    yield rows([tile.meet(node, None if node in tile.held else make(), batch.column(8)[k].as_py())])
        yield rows(list(tile.counted()))

    return run


def _pairs(scratch: Scratch, nodes: DataFrame, eps2: float) -> DataFrame:
    """Pairs (a <= b) of intervals whose boxes are not farther apart than eps, from a tree with ``FAN`` children a node."""
    levels = [nodes.select("node", "lo", "hi")]
    while levels[-1].count() > FAN:
        up = levels[-1].select(F.expr(f"node div {FAN}").alias("node"), F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "z"))
        up = up.groupBy("node", "axis").agg(F.min("z.lo").alias("l"), F.max("z.hi").alias("h"))
        up = up.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("axis", "l", "h"))).alias("s"))
        levels.append(scratch.keep(up.select("node", F.col("s.l").alias("lo"), F.col("s.h").alias("hi"))))
    far = f"aggregate(zip_with(zip_with(al, bh, (x, y) -> x - y), zip_with(bl, ah, (x, y) -> x - y), (x, y) -> pow(greatest(0D, x, y), 2)), 0D, (s, x) -> s + x) <= {eps2!r}D"
    pairs = scratch.spark.range(1).selectExpr("id as pa", "id as pb")  # above the top level, whose nodes are numbered below FAN
    up = F.expr(f"node div {FAN}")
    for level in reversed(levels):
        left = level.select(F.col("node").alias("a"), F.col("lo").alias("al"), F.col("hi").alias("ah"), up.alias("pa"))
        right = level.select(F.col("node").alias("b"), F.col("lo").alias("bl"), F.col("hi").alias("bh"), up.alias("pb"))
        found = pairs.join(left, "pa").join(right, "pb").where("a <= b").where(far)
        pairs = scratch.keep(found.select(F.col("a").alias("pa"), F.col("b").alias("pb")))
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def _links(scratch: Scratch, vectors: DataFrame, d: int, kind: str, cosine: float) -> DataFrame:
    """(h, n): links of the vectors of a hash; (u, v): a spanning forest. ``vectors`` (h, id, times, x) have ``d`` components each and differ."""
    spark = scratch.spark
    sums = vectors.select("x").mapInArrow(_moments(d, kind), "m binary").repartition(8).mapInArrow(_summed, "m binary").collect()  # 8 at most
    value = np.sum([np.frombuffer(bytes(r["m"]), np.float64) for r in sums], axis=0)
    n, mean = int(round(value[-1])), value[d * d : d * d + d] / value[-1]
    _, axes = np.linalg.eigh(value[: d * d].reshape(d, d) / n - np.outer(mean, mean))
    axes = np.ascontiguousarray(axes[:, ::-1])
    eps = math.sqrt(2 - 2 * cosine)
    size = min(INTERVAL, max(64, _WEIGHT // d))
    keys = [f"c{j}" for j in range(min(AXES, d))]
    carry = ["h", "id", "times", "x"]
    placed = vectors.select(*carry).mapInArrow(_placed(d, kind, axes, eps), "h long, id long, times long, x binary, " + "".join(f"{c} int, " for c in keys) + "fine double")
    tasks = max(1, -(-n // (4 * INTERVAL)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = placed.repartitionByRange(tasks, *keys, "fine", "h").sortWithinPartitions(*keys, "fine", "h").select(*carry)
    line = scratch.keep(order.withColumn("at", F.monotonically_increasing_id()))
    part = line.withColumn("part", F.expr("shiftright(at, 33)")).withColumn("at", F.expr("at & 8589934591L"))
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = part.join(sizes, "part").select(*carry, (F.col("before") + F.col("at")).alias("pos")).withColumn("node", F.expr(f"pos div {size}"))
    made = numbered.groupBy("node").applyInArrow(_interval(d, kind, axes), "node long, lo array<double>, hi array<double>, hs binary, ids binary, times binary, xs binary")
    nodes = scratch.keep(made)
    pairs = _pairs(scratch, nodes, (2 - 2 * cosine) * (1 + 1e-9) + 1e-9).select(F.expr(f"a div {TILE}").alias("ta"), F.expr(f"b div {TILE}").alias("tb"), "a", "b")
    held = pairs.select("ta", "tb", F.lit(0).alias("side"), F.col("a").alias("node"), F.expr("cast(null as array<long>)").alias("partners")).distinct()
    passing = pairs.groupBy("ta", "tb", F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))  # TILE at most
    passing = passing.select("ta", "tb", F.lit(1).alias("side"), "node", "partners")
    work = held.unionByName(passing).join(nodes.drop("lo", "hi"), "node").select("ta", "tb", "side", "node", "hs", "ids", "times", "xs", "partners")
    work = work.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "side", "node")
    found = scratch.keep(work.mapInArrow(_joined(d, kind, axes, cosine), "h long, n long, u long, v long"))
    scratch.drop(line, nodes)
    return found


def near_duplicates(spark: SparkSession, embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Per row of ``embeddings``: vec_id, n_links, component_id and kept.

    Vectors with cosine >= ``cosine`` (above 0, below 1), in double precision,
    are linked. n_links counts the other vectors linked directly; component_id
    is the smallest vec_id reachable, itself included; kept is vec_id =
    component_id. Vectors that are null, empty or zero or that hold null or
    non-finite components link with nothing. Equal vectors are linked like
    others. Rows with a null vec_id link with nothing and are kept; rows that
    repeat a vec_id count as separate vectors of one id: each is counted as a
    link of the others, and the id's links are summed. Other columns are ignored; an empty
    table gives an empty result.
    """
    scratch = Scratch(spark)
    element = getattr(embeddings.schema["embedding"].dataType, "elementType", T.DoubleType())
    single = isinstance(element, (T.FloatType, T.ByteType, T.ShortType))
    kind, name = ("<f4", "float") if single else ("<f8", "double")
    rows = embeddings.selectExpr("cast(vec_id as long) as vec_id", f"cast(embedding as array<{name}>) as embedding")
    checked = rows.mapInArrow(_checked(kind), "vec_id long, dim int, x binary").withColumn("h", F.xxhash64("x"))
    vectors = scratch.keep(checked.withColumn("dim", F.when(F.col("vec_id").isNotNull(), F.col("dim")).otherwise(0)))
    distinct = scratch.keep(vectors.where("dim > 0").groupBy("h", "dim", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")))
    found = None
    for r in distinct.select("dim").distinct().collect():  # one, unless vectors of several models are mixed
        part = _links(scratch, distinct.where(F.col("dim") == r["dim"]), r["dim"], kind, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"))
    named = distinct.select("h", "id", "times").join(counts, "h", "left").select("h", "id", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    own = scratch.keep(vectors.where("dim > 0").select("vec_id", "h").join(named, "h").select("vec_id", "id", "n"))
    links = own.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    classes = components(scratch, found.where("u is not null").select("u", "v").union(own.select("vec_id", "id"))).withColumnRenamed("id", "vec_id")
    out = vectors.select("vec_id").join(links, "vec_id", "left").join(classes, "vec_id", "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
